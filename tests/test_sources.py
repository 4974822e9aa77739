import numpy as np
import pytest

from pairloom.functions import columns as C
from pairloom.operators import aggregates as A
from pairloom.operators import emissions as E
from pairloom.operators import identity9, relate
from pairloom.operators import rows as R
from pairloom.sources import readers, writers
from pyspark.sql import functions as F


def write(path, text):
    path.write_text(text)
    return str(path)


def test_similarity_table_by_name(spark, tmp_path):
    p = write(tmp_path / "a.tsv", "end\tstart\tgroup.b\tchrom\tgroup.a\testimated.identity\tgroup.a.length\n20\t11\tB#1#c\tR#0#chr2\tA#1#c\t0.5\t7\n30\tx\tB#1\tchr2\tA#1\t0.5\t7\n")
    rows = readers.similarity_table(spark, p).collect()
    assert [(r.chrom, r.start_bp, r.end_bp, r.group_a, r.identity, r.a_length) for r in rows] == [("R#0#chr2", 11, 20, "A#1#c", 0.5, 7)]
    loaded = R.load_pairs(readers.similarity_table(spark, p)).first()
    assert (loaded.chrom, loaded.hap_a, loaded.hap_b) == ("chr2", "A#1", "B#1")
    with pytest.raises(ValueError):
        readers.similarity_table(spark, write(tmp_path / "b.tsv", "chrom\tstart\n1\t2\n"))
    with pytest.raises(Exception):
        readers.similarity_table(spark, p, strict=True).collect()


def test_bed_lists_maps_and_gold(spark, tmp_path):
    p = write(tmp_path / "m.bed", "# c\nchr1\t10\t20\n\nchr2\tx\t30\n")
    assert [tuple(r) for r in readers.bed(spark, p, lenient=True).collect()] == [("chr1", 11, 20), ("chr2", 1, 30)]
    with pytest.raises(Exception):
        readers.bed(spark, write(tmp_path / "n.bed", "chr1\t1\n")).collect()
    assert sorted(r.id for r in readers.id_list(spark, write(tmp_path / "i.txt", " a \n#x\n\nb\na\n")).collect()) == ["a", "b"]
    assert [tuple(r) for r in readers.populations(spark, write(tmp_path / "p.tsv", "EUR\tH1#1\nAFR\tH2#1\n")).collect()] == [("EUR", "H1#1"), ("AFR", "H2#1")]
    d = tmp_path / "pops"
    d.mkdir()
    (d / "AFR.txt").write_text("s1\ns2\n")
    assert sorted(tuple(r) for r in readers.populations_folder(spark, str(d)).collect()) == [("AFR", "s1"), ("AFR", "s2")]
    assert [tuple(r) for r in readers.genetic_map(spark, write(tmp_path / "g.map", "chr1 100 1.0 0.1\nchr2 5 1 9\nchr1 200 1.0 0.3\n"), "1").collect()] == [("1", 100, 0.1), ("1", 200, 0.3)]
    g = readers.gold_segments(spark, write(tmp_path / "h.txt", "A 1 B 2 chr1 5 9 3.5\nbad line\nA x B 2 chr1 5 9 3.5\n")).collect()
    assert [(r.sample1, r.hap2, r.end_bp, r.lod) for r in g] == [("A", 2, 9, 3.5)]
    msp = write(tmp_path / "q.msp", "#Subpopulation order/codes: AFR=0 EUR=1\n#chm\tspos\tepos\tsgpos\tegpos\tn snps\tS.0\tS.1\nchr1\t1\t50\t0\t1\t9\t0\t1\n")
    assert sorted((r.haplotype, r.population) for r in readers.gold_painting(spark, msp).collect()) == [("S.0", "AFR"), ("S.1", "EUR")]
    assert readers.painting_header("#Order: B A") == ["B", "A"]
    for bad in ("no header", "#x: A=0 B=2", "#x:"):
        with pytest.raises(ValueError):
            readers.painting_header(bad)


def test_parameters_round_trip(tmp_path):
    p = readers.LearnedParameters(["A", "B"], 0.01, 0.002, transitions=[[0.9, 0.1], [0.2, 0.8]], initial_probs=[0.3, 0.7])
    p.save(str(tmp_path / "p.json"))
    q = readers.LearnedParameters.load(str(tmp_path / "p.json"))
    assert q == p and q.reordered(["B", "A"]).transitions == [[0.8, 0.2], [0.1, 0.9]] and q.reordered(["B", "A"]).initial_probs == [0.7, 0.3]
    with pytest.raises(ValueError):
        q.reordered(["A", "C"])
    (tmp_path / "n.json").write_text('{"version": 9, "population_names": [], "temperature": 1, "switch_prob": 0}')
    with pytest.raises(ValueError):
        readers.LearnedParameters.load(str(tmp_path / "n.json"))


def test_sinks(spark, tmp_path):
    m = spark.createDataFrame([("A#1", "A#2", 0.5, 2), ("A#1", "B#1", 0.25, 4)], "hap_a string, hap_b string, average double, n long")
    assert writers.matrix_files(m, str(tmp_path / "g")) == ["A#1", "A#2", "B#1"]
    assert np.fromfile(tmp_path / "g.grm.bin", "<f4").tolist() == [0, 0.5, 0, 0.25, 0, 0] and np.fromfile(tmp_path / "g.grm.N.bin", "<f4").tolist() == [0, 2, 0, 4, 0, 0]
    assert (tmp_path / "g.grm.id").read_text() == "A\tA#1\nA\tA#2\nB\tB#1\n"
    s = spark.createDataFrame([("chr1", 11, 20, "A#1", "B#1", 3.456)], "chrom string, start_bp long, end_bp long, hap_a string, hap_b string, lod_score double")
    assert writers.segment_bed(s).first().value == "chr1\t10\t20\tA#1_B#1\t346\t."
    e = spark.createDataFrame([("chr1", 1, 10, 3, 1, 1 / 3)], "chrom string, start_bp long, end_bp long, n_pairs long, n_ibs long, frac_ibs double")
    writers.table(e.coalesce(1), writers.ENRICHMENT, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv")) == "chrom\tstart\tend\tn_pairs\tn_ibs\tfrac_ibs\nchr1\t1\t10\t3\t1\t0.333333\n"


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_columns(spark):
    L = F.lit
    r = one(spark, a=C.coverage_ratio(L(50), L(100)), b=C.coverage_ratio(L(0), L(0)), c=C.logit(L(1.0)), d=C.inv_logit(L(0.0)), e=C.haplotype_index(L("S#2#x")), f=C.haplotype_index(L("S")), g=C.strip_coordinates(L("S#1#c:1-9")), h=C.short_chrom(L("R#0#chr7")), i=C.short_chrom(L("R#0#x")), j=C.f1_score(L(0.0), L(0.0)), k=C.quality_score(L(1.0), L(1.0), L(50.0), L(20)), m=C.overlap_bp(L(1), L(5), L(7), L(9)))
    assert tuple(r) == (0.5, 0.0, 12.0, 0.5, 2, None, "S#1#c", "chr7", "R#0#x", 0.0, 100.0, 0)
    ok = spark.createDataFrame([("chr1:5-9",)], "t string").select(R.parse_region("t").alias("r")).first().r
    assert tuple(ok) == ("chr1", 5, 9)
    whole = spark.createDataFrame([("chr1",)], "t string").select(R.parse_region("t", 77).alias("r")).first().r
    assert tuple(whole) == ("chr1", 1, 77)
    for bad in ("chr1:0-5", "chr1:9-5", "chr1"):
        with pytest.raises(Exception):
            spark.createDataFrame([(bad,)], "t string").select(R.parse_region("t").alias("r")).collect()


def test_emission_arrays(spark):
    A_ = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    e = A_(-1, -2, float("-inf"))
    r = one(spark, s=E.log_softmax(A_(0.9, 0.8, 0), 0.1), one=E.log_softmax(A_(0, 0.8, 0), 0.1), c=E.contrast(e), m=E.margin(e), am=E.argmax(A_(1, 3, 3)), b=E.blend(e, A_(-3, -1, -2), 0.5), ag=E.blend_agreement(A_(-1, -2), A_(-1, -3), 0.5), dis=E.blend_agreement(A_(-1, -2), A_(-3, -1), 0.5), sp=E.sparsify(A_(-1, -2, -3), 2), rk=E.ranks(A_(-1, -2, -3)), am2=E.amplify(A_(-1, -3), 2), sm=E.softmax_renormalize(A_(0, 0), 1), sh=E.sharpen(A_(0.8, 0.2), 0.5), fo=E.focus(A_(-1, -2, -3), A_(0.9, 0.08, 0.02), 0.1), lod=E.label_lod(A_(-1, -2), F.lit(0)))
    assert np.allclose(np.exp(r.s[:2]).sum(), 1) and r.s[2] == float("-inf") and r.one[1] == 0.0
    assert r.c[:2] == [0.5, -0.5] and r.c[2] == float("-inf") and r.m == 1.0 and r.am == 2
    assert r.b == [-2.0, -1.5, -2.0]
    assert np.allclose(r.ag, [-1.0, 0.25 * -2 + 0.75 * -3]) and np.allclose(r.dis, [0.9 * -1 + 0.1 * -3, 0.9 * -2 + 0.1 * -1])
    assert r.sp == [-1.0, -2.0, -100.0] and r.rk == [3.0, 2.0, 1.0] and r.am2 == [0.0, -4.0]
    assert np.allclose(np.exp(r.sm), 0.5) and np.allclose(r.sh, [0.64 / 0.68, 0.04 / 0.68]) and r.fo == [-1.0, -2.0, float("-inf")]
    assert np.isclose(r.lod, 1 / np.log(10))


def test_identity_classes(spark):
    assert len({c for _, c in identity9.class_table()}) == 9
    assert identity9.classify({(0, 1), (1, 2), (2, 3)}) == 1 and identity9.classify({(0, 2), (1, 3)}) == 7 and identity9.classify(set()) == 9
    H = ("A#1", "A#2", "B#1", "B#2")
    rows = [("c", 1, 10, "A#1", "B#1"), ("c", 1, 10, "A#2", "B#2"), ("c", 21, 30, "A#1", "B#2"), ("c", 31, 40, "A#1", "X#1")]
    df = spark.createDataFrame(rows, "chrom string, start_bp long, end_bp long, hap_a string, hap_b string")
    assert sorted((r.delta, r.n) for r in identity9.identity_classes(df, H).collect()) == [(7, 1), (8, 1), (9, 2)]


def test_matrices_and_filters(spark):
    m = spark.createDataFrame([("A#1", "A#2", 0.8, 1), ("A#1", "B#1", 0.6, 1)], "hap_a string, hap_b string, average double, n long")
    d = {(r.individual_a, r.individual_b): (r.average, r.n) for r in relate.diploid(m).collect()}
    assert np.isclose(d[("A", "A")][0], (0.8 * 2 + 2) / 4) and d[("A", "B")] == (0.6, 1) and d[("B", "B")] == (1.0, 1)
    s = spark.createDataFrame([("A#1", "B#1", 0, 100)], "hap_a string, hap_b string, start_bp long, end_bp long")
    p = spark.createDataFrame([("A", "B"), ("A", "C")], "individual_a string, individual_b string")
    assert {(r.individual_b, r.total_ibd_bp) for r in relate.kinship(s, 25, p).collect()} == {("B", 100), ("C", 0)}
    w = spark.createDataFrame([("g", 1.0, 1.0, 1.0), ("g", 3.0, 0.0, 0.0)], "g string, x double, w double, k double")
    assert tuple(A.weighted_emissions(w, ["g"], "x", "w").first())[1:] == (3.0, 0.0, 1.0, 0.0)
    assert tuple(A.indicator_rates(w, ["g"], "k", "w").first())[1:] == (0.001, 0.999)

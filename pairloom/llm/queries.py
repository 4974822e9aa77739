"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.bpe import round_trip
from pairloom.llm.common import table
from pairloom.llm.dedup import exact_dedup
from pairloom.llm.elias_fano import read_token_files, write_token_files
from pairloom.llm.lines import dedup_lines
from pairloom.llm.matroska import media_digests
from pairloom.llm.mixing import mix
from pairloom.llm.ngram_join import near_duplicates
from pairloom.llm.quality import quality_classifier
from pairloom.llm.secrets import scan_secrets
from pairloom.llm.token_counts import token_counts


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_files(write_token_files(table(spark, sf_dir, "documents")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op6_media_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_token_counts": op2_token_counts,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_files": op4_token_files,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_media_matroska": op6_media_matroska,
    "op7_mixing": op7_mixing,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_line_dedup": op9_line_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
}

#: A word of the contracts, for DuckDB.
WORD = r"'[^\x20\x09-\x0D]+'"

ORACLE: dict[str, str] = {
    "op5_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
               count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
               sha256(coalesce(text, '')) AS text_sha256,
               doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept
        FROM documents
    """,
    "op9_line_dedup": rf"""
        WITH t AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    p AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS k FROM t),
    w AS (SELECT doc_id, k, line, list_sort(list_distinct(regexp_extract_all(line, {WORD}))) AS w FROM p),
    own AS (SELECT w, min(struct_pack(d := doc_id, k := k)) AS f, len(w) AS n, row_number() OVER () AS id FROM w WHERE len(w) > 0 GROUP BY w),
    x AS (SELECT id, f, n, unnest(w) AS v FROM own),
    df AS (SELECT v, count(*) AS c FROM x GROUP BY 1),
    o AS (SELECT x.*, row_number() OVER (PARTITION BY id ORDER BY c, v) AS at FROM x JOIN df USING (v)),
    cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM o a JOIN o b ON a.v = b.v AND a.f < b.f AND a.at <= a.n - ceil(0.8 * a.n) + 1 AND b.at <= b.n - ceil(0.8 * b.n) + 1 AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
    later AS (SELECT DISTINCT cand.b AS id FROM cand JOIN own a ON a.id = cand.a JOIN own b ON b.id = cand.b WHERE 100 * len(list_intersect(a.w, b.w)) >= 80 * (a.n + b.n - len(list_intersect(a.w, b.w)))),
    gone AS (SELECT w.doc_id, w.k FROM w JOIN own ON own.w = w.w LEFT JOIN later USING (id) WHERE later.id IS NOT NULL OR own.f <> struct_pack(d := w.doc_id, k := w.k))
    SELECT t.doc_id, CASE WHEN t.text IS NULL THEN 0 ELSE len(l) END::bigint AS n_lines, count(gone.k)::bigint AS n_removed,
        sha256(coalesce(string_agg(p.line, chr(10) ORDER BY p.k) FILTER (gone.k IS NULL), '')) AS text_sha256
    FROM t JOIN p USING (doc_id) LEFT JOIN gone ON gone.doc_id = p.doc_id AND gone.k = p.k GROUP BY t.doc_id, t.text, l
    """,
    "op10_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORD}) AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM d),
    own AS (SELECT s, min(doc_id) AS rep, len(s) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM s) WHERE len(s) > 0 GROUP BY s),
    g AS (SELECT rep, n, unnest(s) AS x FROM own),
    l AS (SELECT a.rep AS a, b.rep AS b FROM g a JOIN g b ON a.x = b.x AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT rep AS a, rep AS b FROM own UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
    c AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY 1)
    SELECT s.doc_id, len(s.s)::bigint AS n_shingles, coalesce(component_id, s.doc_id) AS component_id FROM s LEFT JOIN own ON own.s = list_sort(s.s) LEFT JOIN c ON c.rep = own.rep
    """,
}

from generators import shared_pairs

from pairloom.operators.aggregates import enrichment
from pairloom.operators.rows import load_pairs
from pairloom.streaming.enrichment import start_enrichment

SCHEMA = "chrom string, start_bp long, end_bp long, group_a string, group_b string, identity double"


def test_stream_gives_the_batch_result(spark, tmp_path):
    rows = shared_pairs()
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):
        df.filter(f"start_bp % 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = start_enrichment(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, enrichment(load_pairs(df)).collect()))

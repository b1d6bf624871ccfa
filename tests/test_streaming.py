"""The row-local scorer on a Structured Streaming source."""

from toposim.plans import views as V
from toposim.operators.scoring import score_pairs
from toposim.streaming.scoring import start_scoring


def test_stream_scores_equal_batch(spark, sf_dir, tmp_path):
    src = tmp_path / "src"
    V.pairs(spark, sf_dir).select("idx", "Name1", "Name2").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).parquet(str(src))
    q = start_scoring(stream, "Name1", "Name2", str(tmp_path / "out"), str(tmp_path / "ckpt"),
                      trigger_once=True)
    q.awaitTermination(300)
    got = {r.idx: r.jaccard for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = score_pairs(spark.read.parquet(str(src)), "Name1", "Name2", ["jaccard"])
    want = {r.idx: r.jaccard for r in batch.collect()}
    assert got == want and len(got) > 0

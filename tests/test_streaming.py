from pyspark.sql import functions as F

from undula.operators import features as X
from undula.operators import segments as G
from undula.sources import tables as S
from undula.streaming.windows import window_energy


def test_stream_gives_the_batch_values(spark, sf, tmp_path):
    e = S.read(spark, sf, "events").select("event_id", "ts")
    samples = S.event_samples(spark, sf).join(e, F.col("seq") == F.col("event_id")).select("record", "n", F.col("ts").cast("timestamp").alias("ts"), "x")
    path = str(tmp_path / "in")
    samples.repartition(3).write.parquet(path)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = window_energy(stream, 16).writeStream.outputMode("update").format("memory").queryName("energy").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {(r["record"], r["segment_id"]): (r["DASDV"], r["LOG"], r["MTKE"]) for r in spark.table("energy").collect()}
    batch = X.energy(G.fixed_slices(samples.drop("ts"), 16), ["record", "segment_id"]).collect()
    assert got.keys() == {(r["record"], r["segment_id"]) for r in batch}
    for r in batch:
        assert all(abs(a - r[n]) < 1e-6 * max(1, abs(a)) for a, n in zip(got[(r["record"], r["segment_id"])], ("DASDV", "LOG", "MTKE"), strict=True))

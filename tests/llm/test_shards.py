"""Shards as they are written."""

from pyspark.sql import functions as F

from rasterel.llm import shard


def test_digest_is_read_from_shards_of_texts(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, F.repeat(F.lit("é "), F.col("id").cast("int"))).alias("text"))
    out = shard.digest(df)
    files = spark.read.parquet(*{f.rsplit("/shard=", 1)[0] for f in out.inputFiles()})
    assert sorted((r.doc_id, r.text) for r in files.where("text is not null").collect()) == sorted((r.doc_id, r.text) for r in df.where("text is not null").collect())
    assert {(r.doc_id, r.shard, r.slot) for r in files.collect()} == {(r.doc_id, r.shard, r.slot) for r in out.collect()}
    assert all(r.size == (1 + 3 * r.doc_id if r.doc_id % 7 else 1) for r in out.collect())


def test_parts_of_a_shard_are_in_order(spark, tmp_path):
    df = spark.range(3000).select((F.col("id") % 1500).alias("doc_id"), F.lit("same").alias("text"))
    shard.write_shards(df, str(tmp_path / "s"), n_shards=4, bucket_rows=200)
    for k in range(4):
        parts = spark.read.parquet(str(tmp_path / "s" / f"shard={k}"))
        slots = [r.slot for r in parts.orderBy("part", F.monotonically_increasing_id()).collect()]
        assert sorted(slots) == list(range(750))
        ends = parts.groupBy("part").agg(F.min("slot"), F.max("slot")).orderBy("part").collect()
        assert all(a[2] < b[1] for a, b in zip(ends, ends[1:]))

"""Sharding (operator 5), built from DataFrame functions only: a two-pass external shuffle.

Pass one scatters the records over buckets by a seeded hash and writes them to the shared folder; the
number of buckets follows from the bytes of the whole table, so that one bucket fits a task's memory. Where no row repeats another, the scatter is
the shuffle itself; nothing has to be kept for it.
For rows that repeat id, size and CRC the hash takes the row's place in the input as well, so that they
are spread like all others. Pass two
gives each bucket a Fisher-Yates permutation and puts its records in that order. The buckets one after another are
then a random order of the table; dealing that order out in turn gives shards whose row counts
are at most one apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cleaned_up, doc_order, fresh, shared_dir, written

#: Bytes of records meant for one bucket, and the most rows.
BUCKET_BYTES, BUCKET_ROWS = 32 << 20, 1 << 16
#: Buckets whose beginnings one task adds up.
RUN = 1024


def shuffle_into_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 8, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, bucket_rows: int = BUCKET_ROWS, with_text: bool = True, part_col: str | None = None) -> DataFrame:
    """``df`` plus ``size``, ``text_crc32``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    A null text has size 1 and the CRC of no bytes. Rows without an id take part as any other.
    The result depends on the rows, ``seed`` and the sizes; rows that repeat id, size and CRC are
    spread by their places in the input. Where there are such rows, places are written with the rows, once, so that all later
    steps see the same ones, also after a lost executor. ``part_col`` names a column for the bucket: in each shard the slots of a bucket
    follow those of the one before. An empty table gives no rows. Texts of any
    length are one record. Columns of ``df`` named as one of the four are replaced.
    """
    spark = df.sparkSession
    bucket, rank, salt, start, to, more, *same = fresh(df, "_bucket", "_rank", "_salt", "_start", "_to", "_more", "_same_id", "_same_crc", "_same_size")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = df.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)})
    if not with_text:
        sized = sized.drop(text_col)
    key = [doc_order(F.col(id_col)), F.col("text_crc32"), F.col("size")]
    n_rows, n_bytes = sized.agg(F.count("*"), F.sum("size")).first()
    n_buckets = max(1, -(-(n_bytes or 0) // bucket_bytes), -(-n_rows // bucket_rows))
    placed_in = F.pmod(F.xxhash64(F.lit(seed), *key, F.col(salt)), F.lit(n_buckets))
    again = written(sized.groupBy(*(k.alias(name) for k, name in zip(key, same))).agg(F.count("*").alias(more)).where(F.col(more) > 1))
    if again.isEmpty():
        rows = sized.withColumn(salt, F.lit(0).cast("long")).withColumn(bucket, placed_in)
    else:
        told = sized.join(again, reduce(Column.__and__, (k == F.col(name) for k, name in zip(key, same))), "left")
        salted = told.withColumn(salt, F.when(F.col(more) > 1, F.monotonically_increasing_id()).otherwise(F.lit(0))).drop(more, *same)
        rows = written(salted.withColumn(bucket, placed_in))
    counts = written(rows.groupBy(bucket).agg(F.count("*").alias("_rows")))
    largest = counts.agg(F.max("_rows")).first()[0] or 0
    # Where each bucket begins in the whole order: sums within runs of buckets, and over the runs.
    run = F.floor(F.col(bucket) / RUN)
    runs = counts.groupBy(run.alias("_run")).agg(F.sum("_rows").alias("_in_run"))
    runs = runs.select("_run", (F.sum("_in_run").over(Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in_run")).alias("_before"))
    within = F.sum("_rows").over(Window.partitionBy("_run").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_rows")
    starts = counts.withColumn("_run", run).withColumn("_within", within).join(runs, "_run").select(bucket, "_rows", (F.col("_before") + F.col("_within")).alias(start))
    # shuffle() is Fisher-Yates on an array. Range partitions fix its generator's state, so a rerun
    # task makes the same permutation. Those of 0..largest-1, less what is beyond the bucket's
    # rows, are uniform permutations of the bucket.
    perms = (
        spark.range(0, n_buckets, 1, min(n_buckets, 4096))
        .select(F.col("id").alias(bucket), F.shuffle(F.sequence(F.lit(0), F.lit(max(0, largest - 1))), F.lit(seed)).alias("_perm"))
        .join(starts, bucket)
        .select(bucket, start, F.filter("_perm", lambda i: i < F.col("_rows")).alias("_perm"))
        # The place of each rank: the permutation turned round.
        .select(bucket, start, F.transform(F.array_sort(F.arrays_zip("_perm", F.sequence(F.lit(0), F.size("_perm") - 1).alias("to"))), lambda e: e["to"]).alias(to))
    )
    ordered = Window.partitionBy(bucket).orderBy(*key, salt)
    # A bucket's permutation meets its rows as one array, by the bucket: texts move once.
    placed = rows.withColumn(rank, F.row_number().over(ordered) - 1).join(perms.hint("shuffle_hash"), bucket)
    at = F.col(start) + F.get(F.col(to), F.col(rank))
    parts = {part_col: F.col(bucket)} if part_col else {}
    return placed.withColumns({"shard": F.pmod(at, F.lit(n_shards)).cast("int"), "slot": F.floor(at / n_shards).cast("long"), **parts}).drop(bucket, rank, start, to, salt)


def write_shards(df: DataFrame, path: str, n_shards: int = 8, **options) -> None:
    """Writes ``shuffle_into_shards(df)`` below ``path``, a folder a shard, in it one a bucket (``part``), rows in slot order.

    A shard's parts in order of their numbers are the shard in order of slots, at any table size. A part is
    bounded as a bucket is. Each bucket is written by the task that has permuted it.
    """
    shards = shuffle_into_shards(df, n_shards=n_shards, part_col="part", **options)
    shards.sortWithinPartitions("shard", "part", "slot").write.partitionBy("shard", "part").parquet(path)


def digest(docs: DataFrame) -> DataFrame:
    """One row per document under the law ``rows``, read from the shards: texts are written into them and measured there."""
    path = shared_dir(docs.sparkSession)
    with cleaned_up(docs.sparkSession):
        write_shards(docs.select("doc_id", "text"), path)
    kept = docs.select("doc_id", "text").schema.add("slot", "long").add("shard", "integer").add("part", "long")
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text)
    return docs.sparkSession.read.schema(kept).parquet(path).select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

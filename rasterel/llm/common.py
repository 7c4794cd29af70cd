"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sorts a missing document id after every real one.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one of the tables under ``sf_dir`` (all, if none is named)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share.

    The cluster names the parent in ``spark.checkpoint.dir``. Where that is unset and Spark runs in
    one process (tests), a temporary folder is made once a session and remembered there; on a cluster it's an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("rasterel.scratch.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("on a cluster spark.checkpoint.dir has to name a folder that driver and executors share")
            root = "file://" + tempfile.mkdtemp(prefix="rasterel-")
            spark.conf.set("rasterel.scratch.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


#: Removes a query's shuffle files from the executors' disks when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def cleaned_up(spark: SparkSession):
    """Queries within leave no shuffle files."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    with cleaned_up(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


#: What a Python worker keeps from one task to the next, by operator.
_CACHES: dict[str, dict] = {}


def only_cache(operator: str) -> dict:
    """What this Python worker keeps for an operator's tasks; those of other operators are dropped, for workers outlive queries."""
    for other in [k for k in _CACHES if k != operator]:
        del _CACHES[other]
    return _CACHES.setdefault(operator, {})


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def doc_order(doc_id: Column) -> Column:
    """The id as an order key: a missing id comes after all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character unchanged."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def hash128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes of the columns, as one 128-bit key."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)]

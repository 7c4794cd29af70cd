"""Conversion of images as they arrive in a folder, by Structured Streaming.

An extra of this engine. Images are independent, so the stream keeps no state: each file that
arrives is one row, and a micro-batch that is run again writes the same files again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterel.functions.scalar import stem
from rasterel.plans import convert
from rasterel.plans.profile import Profile
from rasterel.sources.images import MAX_PIXELS, checked_files, decode
from rasterel.sources.sinks import write_files

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, folder: str, profile: Profile, out_dir: str, max_pixels: int = MAX_PIXELS, files_per_batch: int = 1000) -> DataFrame:
    """A streaming table of sprites and reports of the PNG and JPEG files that arrive in a folder.

    ``a.png`` becomes ``a.png`` in the output folder, ``a.jpg`` becomes ``a.jpg.png``: names stay apart.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.{[pP][nN][gG],[jJ][pP][gG],[jJ][pP][eE][gG]}").load(folder)
    tiles = decode(checked_files(files, max_pixels), max_pixels)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    kept = F.when(F.lower(name).endswith(".png"), stem(F.col("path"))).otherwise(name)
    output = F.concat(F.lit(out_dir.rstrip("/") + "/"), kept, F.lit(".png"))
    return convert.convert(tiles, profile, output).withColumn("output", output)


def run(spark: SparkSession, folder: str, profile: Profile, out_dir: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a stream that writes all files of each sprite; an image that fails writes none."""

    def write(batch: DataFrame, _: int) -> None:
        write_files(convert.files_of(batch, F.col("output"))).count()

    return arriving(spark, folder, profile, out_dir, **options).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

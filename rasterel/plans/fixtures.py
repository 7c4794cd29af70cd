"""Images made from the tables: one of 24 by 24 pixels for each part, by whole-number rules.

A disc with bands of colour, a soft rim, a patch of skin colour, a dark eye, and single pixels of
noise around; every rule is integer arithmetic, so that SQL engines agree on all pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterel.functions.color import packed
from rasterel.operators import pixels as px
from rasterel.sources.images import to_tiles

SIDE = 24
#: A palette for all images.
COLORS = ((30, 25, 20), (222, 170, 130), (40, 90, 160), (200, 60, 50), (90, 160, 70), (240, 240, 230), (128, 128, 128), (250, 200, 60))
#: (kind, x0, y0, x1, y1, confidence) in every image.
REGIONS = (("face", 6, 6, 18, 18, 0.6), ("eye", 10, 10, 14, 14, 0.5), ("other", 2, 2, 8, 20, 0.9))

#: The images in DuckDB's SQL.
SQL = f"""sprites AS (
  SELECT image_id, x, y,
    CASE WHEN d2 <= 4 THEN 30 WHEN band = 0 THEN 222 ELSE (image_id * 37 + band * 53) % 256 END AS r,
    CASE WHEN d2 <= 4 THEN 25 WHEN band = 0 THEN 170 ELSE (image_id * 59 + band * 31) % 256 END AS g,
    CASE WHEN d2 <= 4 THEN 20 WHEN band = 0 THEN 130 ELSE (image_id * 83 + band * 97) % 256 END AS b,
    CASE WHEN d2 <= rad * rad THEN 255 WHEN d2 <= (rad + 1) * (rad + 1) THEN 64 + (x * 31 + y * 17 + image_id) % 128
         WHEN (x * 31 + y * 17 + image_id * 7) % 97 = 0 THEN 255 ELSE 0 END AS a
  FROM (SELECT p_partkey AS image_id, gx.i AS x, gy.i AS y, (gx.i - 12) * (gx.i - 12) + (gy.i - 12) * (gy.i - 12) AS d2,
          5 + p_size % 5 AS rad, (gx.i + 2 * gy.i + p_size) % 7 AS band
        FROM part, (SELECT unnest(range(0, {SIDE})) AS i) gx, (SELECT unnest(range(0, {SIDE})) AS i) gy) t
)"""


def sprites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pixels of one image for each part.

    Parts are dealt out by image_id before they become pixels. Windows and aggregates within images
    then need no further exchange.
    """
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("image_id"), "p_size")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = F.sequence(F.lit(0), F.lit(SIDE - 1))
    cells = parts.repartition(n, "image_id").withColumn("x", F.explode(steps)).withColumn("y", F.explode(steps))
    x, y, i = F.col("x"), F.col("y"), F.col("image_id")
    cells = cells.withColumns({"d2": (x - 12) * (x - 12) + (y - 12) * (y - 12), "rad": 5 + F.col("p_size") % 5, "band": (x + 2 * y + F.col("p_size")) % 7})
    d2, rad, band = F.col("d2"), F.col("rad"), F.col("band")
    color = lambda eye, skin, p, q: F.when(d2 <= 4, eye).when(band == 0, skin).otherwise((i * p + band * q) % 256).cast("int")
    alpha = F.when(d2 <= rad * rad, 255).when(d2 <= (rad + 1) * (rad + 1), 64 + (x * 31 + y * 17 + i) % 128).when((x * 31 + y * 17 + i * 7) % 97 == 0, 255).otherwise(0).cast("int")
    return cells.select("image_id", "x", "y", color(30, 222, 37, 53).alias("r"), color(25, 170, 59, 31).alias("g"), color(20, 130, 83, 97).alias("b"), alpha.alias("a"))


def sizes(pixels: DataFrame, side: int = SIDE) -> DataFrame:
    return pixels.select("image_id").distinct().select("image_id", F.lit(side).alias("width"), F.lit(side).alias("height"))


def sheets(pixels: DataFrame) -> DataFrame:
    """Sheets of two by two images: images 4k to 4k + 3 make sheet k."""
    i = F.col("image_id")
    return pixels.select(F.floor(i / 4).alias("image_id"), (F.col("x") + SIDE * (i % 2)).cast("int").alias("x"), (F.col("y") + SIDE * F.floor((i % 4) / 2)).cast("int").alias("y"), *"rgba")


def regions(pixels: DataFrame) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(k).alias("kind"), *(F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), box)), F.lit(c).alias("confidence")) for k, *box, c in REGIONS))
    return pixels.select("image_id").distinct().select("image_id", F.inline(rows))


def palette(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(COLORS)], "idx int, r int, g int, b int")


def palette_per_image(pixels: DataFrame) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(i).alias("idx"), *(F.lit(v).alias(n) for n, v in zip("rgb", c))) for i, c in enumerate(COLORS)))
    return pixels.select("image_id").distinct().select("image_id", F.inline(rows))


def body(pixels: DataFrame) -> DataFrame:
    """Dense pixels with ``body``: solid foreground."""
    return pixels.withColumn("body", px.by_alpha(96))


def tiles(pixels: DataFrame) -> DataFrame:
    """Tile form with a path and a digest for each image."""
    t = to_tiles(pixels)
    return t.select("image_id", F.concat(F.lit("sprite-"), F.col("image_id").cast("string"), F.lit(".png")).alias("path"), F.sha2("data", 256).alias("sha256"), "width", "height", "data", F.lit(None).cast("string").alias("error"))


def code() -> Column:
    return packed(F.col("r"), F.col("g"), F.col("b")).cast("long")

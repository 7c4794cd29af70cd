"""Connected components of masks, in two forms, and what is read off them.

The kernel form holds images as a whole, many at once. The relational form cuts rows into runs and joins runs of
neighbouring rows; only runs take part in the rounds, so that an image may be larger than a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rasterel.functions.color import Lab, is_skin, with_oklab
from rasterel.sources.shared import written

from . import kernels
from .pixels import KEY, kept, per_key, place, whole


def labelled(points: DataFrame, connectivity: int = 8, method: str = "kernel") -> DataFrame:
    """(image_id, x, y, label) of a set of pixels; a label is the first pixel, row by row, as y << 32 | x."""
    own = _places(points)
    if method == "sql":
        return _by_runs(own, connectivity)

    def run(batches):
        for batch in batches:
            start, at = kernels.lists(batch.column("at"))
            x, y = kernels.places(at)
            label = np.empty(len(at), np.int64)
            for p, row, col, shape in kernels.canvases(x, y, start):
                mask = np.zeros(shape, bool)
                mask[row, col] = True
                first = kernels.label(mask, connectivity)[row, col].astype(np.int64)
                label[p] = (first // shape[1] + y[p] - row) << 32 | (first % shape[1] + x[p] - col)
            owner = pa.array(np.repeat(np.arange(len(start) - 1), np.diff(start)))
            yield pa.record_batch({"image_id": batch.column("image_id").take(owner), "x": pa.array(x.astype(np.int32)), "y": pa.array(y.astype(np.int32)), "label": pa.array(label)})

    images = own.groupBy("image_id").agg(F.collect_list(place()).alias("at")).where("size(at) > 0")
    return images.select(F.col("image_id").cast("long").alias("image_id"), "at").mapInArrow(run, "image_id long, x int, y int, label long")


def _places(points: DataFrame) -> DataFrame:
    return points.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))


def _marked(points: DataFrame) -> DataFrame:
    """points plus ``_i``, which the pixels of one run share."""
    return points.withColumn("_i", F.col("x") - F.row_number().over(Window.partitionBy("image_id", "y").orderBy("x")))


def _labelled_runs(marked: DataFrame, connectivity: int) -> DataFrame:
    """(image_id, y, _i, label) of each run."""
    runs = marked.groupBy("image_id", "y", "_i").agg(F.min("x").alias("b"), F.max("x").alias("e"))
    node = F.shiftleft(F.col("y").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    runs = written(runs.select("image_id", "y", "b", "e", "_i", node.alias("n")))
    below = runs.select("image_id", (F.col("y") - 1).alias("y"), F.col("b").alias("b2"), F.col("e").alias("e2"), F.col("n").alias("n2"))
    reach = int(connectivity == 8)
    edges = runs.join(whole(below), ["image_id", "y"]).where((F.col("b2") <= F.col("e") + reach) & (F.col("e2") >= F.col("b") - reach)).select("image_id", F.col("n2").alias("a"), F.col("n").alias("b"))
    roots = whole(_roots(edges).withColumnRenamed("node", "n"))
    return runs.join(roots, ["image_id", "n"], "left").select("image_id", "y", "_i", F.coalesce("root", "n").alias("label"))


def _by_runs(points: DataFrame, connectivity: int) -> DataFrame:
    marked = _marked(points)
    return marked.join(whole(_labelled_runs(marked, connectivity)), ["image_id", "y", "_i"]).select("image_id", "x", "y", "label")


def _roots(edges: DataFrame) -> DataFrame:
    """(image_id, node, root) over edges a > b: alternating star rounds until nothing changes."""
    now, mark = written(edges.distinct()), F.struct(F.count("*"), F.sum(F.xxhash64("image_id", "a", "b") % F.lit(1 << 40)))
    before = now.agg(mark).first()[0]
    while before[0]:
        both = now.union(now.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("image_id", "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(whole(low), ["image_id", "a"]).select("image_id", F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("image_id", "a").agg(F.min("b").alias("m"))
        small = large.join(whole(low), ["image_id", "a"]).select("image_id", F.explode(F.array("a", "b")).alias("n"), "m").where("n <> m")
        now = written(small.select("image_id", F.col("n").alias("a"), F.col("m").alias("b")).distinct())
        after = now.agg(mark).first()[0]
        if after == before:
            break
        before = after
    return now.select("image_id", F.col("a").alias("node"), F.col("b").alias("root"))


def component_boxes(labels: DataFrame) -> DataFrame:
    """(image_id, label, size, x0, y0, x1, y1) of each component."""
    return labels.groupBy("image_id", "label").agg(F.count("*").alias("size"), F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def component_count(points: DataFrame, connectivity: int = 8, method: str = "kernel") -> DataFrame:
    """(image_id, components) of images with any set pixel."""
    # The runs of a row and their components say as much as all their pixels.
    named = _labelled_runs(_marked(_places(points)), connectivity) if method == "sql" else labelled(points, connectivity, method)
    return named.groupBy(KEY).agg(F.count_distinct("label").alias("components"))


def without_small(points: DataFrame, least: int, method: str = "kernel") -> DataFrame:
    """(image_id, x, y) of pixels in 8-connected components of a size or more."""
    if least <= 1:
        return points.select("image_id", "x", "y")
    size = F.count("*").over(Window.partitionBy("image_id", "label"))
    return labelled(points, 8, method).withColumn("_n", size).where(F.col("_n") >= least).select("image_id", "x", "y")


def skin(pixels: DataFrame) -> DataFrame:
    """The pixels of skin colour that are solid enough."""
    return kept(with_oklab(pixels.where("a >= 96")), is_skin(Lab.of("ok_"))).select(*pixels.columns)


def faces(pixels: DataFrame, sizes: DataFrame, method: str = "kernel") -> DataFrame:
    """(image_id, x0, y0, x1, y1): the largest 4-connected skin patch whose box is a third of the image at most."""
    boxes = component_boxes(labelled(skin(pixels), 4, method)).join(per_key(sizes), KEY)
    fits = boxes.where((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) <= F.floor(F.col("width").cast("long") * F.col("height") / 3))
    first = Window.partitionBy("image_id").orderBy(F.desc("size"), "label")
    return fits.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("image_id", "x0", "y0", "x1", "y1")


def eyes(pixels: DataFrame, face_boxes: DataFrame, method: str = "kernel") -> DataFrame:
    """(image_id, x0, y0, x1, y1) of small dark 4-connected blobs within faces."""
    face = face_boxes.select("image_id", *(F.col(c).alias(f"f{c}") for c in ("x0", "y0", "x1", "y1")))
    inside = pixels.join(per_key(face), KEY).where("x >= fx0 and x < fx1 and y >= fy0 and y < fy1 and a >= 96")
    dark = kept(with_oklab(inside), F.col("ok_l") < 0.45)
    boxes = component_boxes(labelled(dark, 4, method)).join(per_key(face), KEY)
    return boxes.where((F.col("size") >= 2) & (F.col("x1") - F.col("x0") <= F.floor((F.col("fx1") - F.col("fx0")) / 2))).select("image_id", "x0", "y0", "x1", "y1")


def feature_regions(pixels: DataFrame, sizes: DataFrame, method: str = "kernel") -> DataFrame:
    """(image_id, kind, x0, y0, x1, y1, confidence): faces and eyes by colour alone."""
    face = written(faces(pixels, sizes, method))  # read three times
    box = ["image_id", "x0", "y0", "x1", "y1"]
    tag = lambda df, kind, c: df.select("image_id", F.lit(kind).alias("kind"), *box[1:], F.lit(c).alias("confidence"))
    return tag(face, "face", 0.6).union(tag(eyes(pixels, face, method), "eye", 0.5))

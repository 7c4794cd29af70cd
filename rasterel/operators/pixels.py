"""Relational operators on pixels: masks, neighbourhoods, windows, cells and sets.

Dense form has a row for every pixel of an image; windows and neighbourhoods need it, for frames
count rows. Sets have a row where something holds. All operators work on many images at once and
group by ``image_id``; nothing else keys the shuffle, so that a table partitioned by image_id stays
so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterel.functions.color import linear_to_srgb, packed, srgb_to_linear, unpacked

KEY = ["image_id"]
XY = [*KEY, "x", "y"]


def whole(df: DataFrame) -> DataFrame:
    """The right side of a join with a row for each pixel, run or pair: never sent to the driver and to all tasks.

    Spark takes the exploded pixels of a table for as many bytes as the table's rows; by that it would broadcast them.
    """
    return df.hint("merge")


def kept(df: DataFrame, condition: Column) -> DataFrame:
    """The rows where a condition on computed columns holds, each column computed once a row.

    A plain filter is moved below the projections that make its columns, which become one expression without
    shared parts. A column that depends on the partition holds it back.
    """
    return df.withColumn("_kept", F.when(condition, F.spark_partition_id())).where("_kept is not null").drop("_kept")


def place() -> Column:
    """A pixel's place as one number, y << 32 plus x."""
    return F.shiftleft(F.col("y").cast("long"), 32) + F.col("x").cast("long")


def per_key(df: DataFrame) -> DataFrame:
    """The right side of a join with pixels that has a row for each image: a hash table in each partition, so that pixels aren't sorted."""
    return df.hint("shuffle_hash")


# Masks -----------------------------------------------------------------------------------------


def by_alpha(threshold: int) -> Column:
    return F.col("a") >= threshold


def transparent_share(pixels: DataFrame) -> DataFrame:
    """(image_id, alpha_coverage): the share of pixels that aren't fully opaque."""
    return pixels.groupBy(KEY).agg(F.avg((F.col("a") < 255).cast("double")).alias("alpha_coverage"))


def sizes(pixels: DataFrame) -> DataFrame:
    """(image_id, width, height) of dense images."""
    return pixels.groupBy(KEY).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


def _corners() -> list[Column]:
    """Aggregates bg_r, bg_g, bg_b: per channel the upper median of an image's four corners.

    A corner is the pixel that is first or last by rows, and in its row: no size has to be known.
    """
    # Whole numbers instead of structs, which a hash aggregate can't hold: it would sort all pixels.
    rgb, x, y = packed(F.col("r"), F.col("g"), F.col("b")), F.col("x").cast("long"), F.col("y").cast("long")
    four = [unpacked(F.min_by(rgb, sy * y * (1 << 32) + sx * x)) for sy in (1, -1) for sx in (1, -1)]
    return [F.get(F.array_sort(F.array(*(c[k] for c in four))), F.lit(2)).alias(f"bg_{n}") for k, n in enumerate("rgb")]


def corner_colors(pixels: DataFrame) -> DataFrame:
    """(image_id, bg_r, bg_g, bg_b) of dense images."""
    return pixels.groupBy(KEY).agg(*_corners())


def foreground(pixels: DataFrame, threshold: int = 96, tolerance: int = 24) -> DataFrame:
    """pixels plus ``fg`` and ``mask_source``.

    Alpha decides in images of which more than a hundredth isn't opaque; elsewhere the distance
    from the corners' colour does. One aggregate and one join.
    """
    summary = pixels.groupBy(KEY).agg(F.avg((F.col("a") < 255).cast("double")).alias("_share"), *_corners())
    apart = sum((F.abs(F.col(c) - F.col(f"bg_{c}")) for c in "rgb"), F.lit(0)) > 3 * tolerance
    use_alpha = F.col("_share") > 0.01
    marked = pixels.join(per_key(summary), KEY)
    return marked.select(*pixels.columns, F.when(use_alpha, by_alpha(threshold)).otherwise(apart).alias("fg"), F.when(use_alpha, "alpha").otherwise("corner-background").alias("mask_source"))


def bounding_box(marked: DataFrame, mask: str = "fg") -> DataFrame:
    """(image_id, x0, y0, x1, y1) around set pixels, upper bounds exclusive; images without any have no row."""
    return marked.where(mask).groupBy(KEY).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


# Neighbourhoods ----------------------------------------------------------------------------------

OFFSETS = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
SIDES = [(-1, 0), (0, -1), (0, 1), (1, 0)]


def with_neighbours(dense: DataFrame, value: Column, prefix: str = "n") -> DataFrame:
    """dense plus a column for each of the eight neighbours' values, null beyond the edge.

    Two window passes: one takes left and right within rows, the other the rows above and below.
    Both sort within images; no join is needed.
    """
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    flat = dense.withColumn("_v", value).withColumn("_h", F.struct(F.lag("_v").over(row).alias("m"), F.col("_v").alias("z"), F.lead("_v").over(row).alias("p")))
    tall = flat.withColumns({"_up": F.lag("_h").over(column), "_down": F.lead("_h").over(column)})
    part = {-1: "m", 0: "z", 1: "p"}
    source = {-1: "_up", 0: "_h", 1: "_down"}
    return tall.select(*dense.columns, *(F.col(source[dy])[part[dx]].alias(neighbour(dy, dx, prefix)) for dy, dx in OFFSETS))


def neighbour(dy: int, dx: int, prefix: str = "n") -> str:
    """The name of a neighbour's column."""
    return prefix + {-1: "u", 0: "m", 1: "d"}[dy] + {-1: "l", 0: "c", 1: "r"}[dx]


def neighbour_pairs(points: DataFrame, offsets: list[tuple[int, int]] = OFFSETS) -> DataFrame:
    """(image_id, x, y, nx, ny) of all pairs of a point and a neighbour that is a point as well.

    The sparse form: each point goes to the places around it and, marked, to its own; a window over a place tells whether
    a point is there. Unlike a join by places this needs no exchange where points are partitioned by image_id.
    """
    steps = [F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(own).alias("own")) for dy, dx, own in [*((*o, False) for o in offsets), (0, 0, True)]]
    reach = points.where("image_id is not null and x is not null and y is not null").select(*XY, F.explode(F.array(*steps)).alias("s")).select(*XY, (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.dy")).alias("ny"), F.col("s.own").alias("_own"))
    there = reach.withColumn("_there", F.count_if("_own").over(Window.partitionBy("image_id", "nx", "ny"))).where("not _own and _there > 0")
    return there.select(*XY, "nx", "ny", F.explode(F.array_repeat(F.lit(0), F.col("_there").cast("int"))).alias("_k")).drop("_k")


# Windows -----------------------------------------------------------------------------------------


def square_extremum(dense: DataFrame, value: str, radius: int, largest: bool, name: str) -> DataFrame:
    """dense plus the extreme value in the clamped square window: rows first, then columns."""
    best = F.max if largest else F.min
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)
    column = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)
    return dense.withColumn("_line", best(value).over(row)).withColumn(name, best("_line").over(column)).drop("_line")


def square_median(dense: DataFrame, value: str, radius: int, name: str) -> DataFrame:
    """dense plus the upper median in the clamped square window of values in 256 bins, as bin / 255."""
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-radius, radius)
    column = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-radius, radius)
    bins = F.round(F.greatest(F.least(F.col(value), F.lit(1.0)), F.lit(0.0)) * 255).cast("int")
    lines = dense.withColumn("_bin", bins).withColumn("_line", F.collect_list("_bin").over(row)).withColumn("_all", F.sort_array(F.flatten(F.collect_list("_line").over(column))))
    return lines.withColumn(name, F.get("_all", F.floor(F.size("_all") / 2).cast("int")) / F.lit(255.0)).drop("_bin", "_line", "_all")


def morphology(dense: DataFrame, value: str, radius: int, iterations: int, largest: bool, name: str) -> DataFrame:
    """Repeated erosion or dilation; clamped square windows add up, so one pass does."""
    return square_extremum(dense, value, radius * max(iterations, 1), largest, name)


# Cells -------------------------------------------------------------------------------------------


def cells_of(position: Column, begin: Column, length: Column, parts: Column) -> Column:
    """The array of cells, out of ``parts`` over ``length`` pixels from ``begin``, that hold a pixel.

    Cell t covers floor(t * length / parts) to floor((t + 1) * length / parts), a pixel at least: one
    cell a pixel where there are fewer cells than pixels, else several. In closed form, no join.
    """
    p, f, s = (position - begin).cast("long"), parts.cast("long"), length.cast("long")
    last = F.ceil((p + 1) * f / s).cast("long") - 1
    first = F.when(f > s, F.ceil(p * f / s).cast("long")).otherwise(last)
    return F.when((p >= 0) & (p < s), F.sequence(first, last))


def grid_cell(position: Column, extent: Column, count: int) -> Column:
    """The row or column of a grid of ``count`` that a position falls in; remainders are spread."""
    return (F.floor(((position.cast("long") + 1) * count - 1) / extent)).cast("int")


def crop(pixels: DataFrame, x0: int, y0: int, width: int, height: int) -> DataFrame:
    """The rectangle, clipped to the image, with coordinates of its own."""
    inside = pixels.where(F.col("x").between(x0, x0 + width - 1) & F.col("y").between(y0, y0 + height - 1))
    return inside.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def upscale(pixels: DataFrame, factor: int) -> DataFrame:
    """Each pixel becomes factor by factor pixels."""
    steps = F.sequence(F.lit(0), F.lit(max(factor, 1) - 1))
    wide = pixels.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.withColumns({"x": F.col("x") * factor + F.col("_dx"), "y": F.col("y") * factor + F.col("_dy")}).drop("_dx", "_dy")


def placed(cells: DataFrame, canvas: DataFrame, anchor: str = "bottom-center") -> DataFrame:
    """Cells (image_id, tx, ty, ...) moved onto the canvas.

    canvas: (image_id, fit_w, fit_h, body_w, body_h, reserved).
    """
    at = cells.join(canvas, KEY)
    x = F.col("reserved") + F.floor((F.col("body_w") - F.col("fit_w")) / 2) + F.col("tx")
    gap = F.col("body_h") - F.col("fit_h")
    y = F.col("reserved") + (F.floor(gap / 2) if anchor == "center" else gap) + F.col("ty")
    return at.withColumns({"x": x.cast("int"), "y": y.cast("int")}).select("image_id", "x", "y", *(c for c in cells.columns if c not in ("image_id", "tx", "ty")))


def fitted(boxes: DataFrame, body_w: int, body_h: int, reserved: int) -> DataFrame:
    """boxes plus fit_w, fit_h (the box's shape within the body region), body_w, body_h, reserved."""
    w, h = F.greatest(F.col("x1") - F.col("x0"), F.lit(1)), F.greatest(F.col("y1") - F.col("y0"), F.lit(1))
    scale = F.least(F.lit(float(body_w)) / w, F.lit(float(body_h)) / h)
    fit = lambda size, most: F.greatest(F.least(F.round(size * scale), F.lit(float(most))), F.lit(1.0)).cast("int")
    return boxes.withColumns({"fit_w": fit(w, body_w), "fit_h": fit(h, body_h), "body_w": F.lit(body_w), "body_h": F.lit(body_h), "reserved": F.lit(reserved)})


# Features ----------------------------------------------------------------------------------------

CRITICAL = ("face", "eye", "sunglasses")


def inside_regions(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """pixels plus ``critical`` and ``weight`` (the highest confidence of any region around, else 0).

    An image's regions, few by nature, meet its pixels as one array: an equality join and no range join.
    """
    listed = regions.groupBy(KEY).agg(F.collect_list(F.struct("kind", "x0", "y0", "x1", "y1", F.col("confidence").cast("double").alias("confidence"))).alias("_regions"))
    holds = lambda r: (F.col("x") >= r.x0) & (F.col("x") < r.x1) & (F.col("y") >= r.y0) & (F.col("y") < r.y1)
    joined = pixels.join(listed, KEY, "left")
    weight = F.aggregate("_regions", F.lit(0.0), lambda s, r: F.when(holds(r), F.greatest(s, r.confidence)).otherwise(s))
    critical = F.exists("_regions", lambda r: holds(r) & r.kind.isin(*CRITICAL))
    return joined.withColumns({"critical": F.coalesce(critical, F.lit(False)), "weight": F.coalesce(weight, F.lit(0.0))}).drop("_regions")


def cells_with_critical(cells: DataFrame, regions: DataFrame) -> DataFrame:
    """The rows (image_id, tx, ty, rx0, ry0, rx1, ry1) of cells that share a pixel with a critical region."""
    own = regions.where(F.col("kind").isin(*CRITICAL)).groupBy(KEY).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_regions"))
    meets = F.exists("_regions", lambda r: (r.x0 < F.col("rx1")) & (F.col("rx0") < r.x1) & (r.y0 < F.col("ry1")) & (F.col("ry0") < r.y1))
    return cells.join(own, KEY).where(meets).drop("_regions")


# Sampling ----------------------------------------------------------------------------------------


def in_cells(marked: DataFrame, boxes: DataFrame) -> DataFrame:
    """marked pixels inside the fitted boxes plus their cells tx, ty (several rows where cells overlap)."""
    at = marked.join(per_key(boxes), KEY)
    xs = cells_of(F.col("x"), F.col("x0"), F.col("x1") - F.col("x0"), F.col("fit_w"))
    ys = cells_of(F.col("y"), F.col("y0"), F.col("y1") - F.col("y0"), F.col("fit_h"))
    return at.withColumn("tx", F.explode(xs)).withColumn("ty", F.explode(ys)).select(*marked.columns, F.col("tx").cast("int").alias("tx"), F.col("ty").cast("int").alias("ty"))


def _weight(saliency: float) -> Column:
    return F.col("a") / F.lit(255.0) * (1 + (saliency - 1) * F.col("weight") if saliency > 1 else F.lit(1.0))


def sample_mode(celled: DataFrame, saliency: float = 1.0) -> DataFrame:
    """(image_id, tx, ty, r, g, b, a, coverage): each cell's heaviest exact colour, the lowest of equals.

    celled: pixels with fg, tx, ty and, for saliency over 1, weight. Two aggregates; both combine
    before they shuffle.
    """
    votes = celled.withColumn("_w", F.when(F.col("fg"), _weight(saliency)).otherwise(0.0)).groupBy(*KEY, "tx", "ty", packed(F.col("r"), F.col("g"), F.col("b")).alias("_c")).agg(F.sum("_w").alias("_w"), F.count_if("fg").alias("_fg"), F.count("*").alias("_n"))
    best = F.max_by(F.when(F.col("_w") > 0, F.col("_c")), F.when(F.col("_w") > 0, F.struct(F.round("_w", 9), -F.col("_c"))))
    cells = votes.groupBy(*KEY, "tx", "ty").agg(best.alias("_c"), (F.sum("_fg") / F.sum("_n")).alias("coverage"))
    return cells.select(*KEY, "tx", "ty", *(F.coalesce(c, F.lit(0)).alias(n) for c, n in zip(unpacked(F.col("_c")), "rgb")), F.when(F.col("_c").isNull(), 0).otherwise(255).alias("a"), "coverage")


def sample_area(celled: DataFrame, saliency: float = 1.0) -> DataFrame:
    """(image_id, tx, ty, r, g, b, a, coverage): each cell's weighted mean in linear light."""
    w = F.when(F.col("fg"), _weight(saliency)).otherwise(0.0)
    sums = celled.withColumn("_w", w).withColumns({f"_l{c}": srgb_to_linear(F.col(c)) for c in "rgb"}).groupBy(*KEY, "tx", "ty").agg(F.sum("_w").alias("_w"), *(F.sum(F.col("_w") * F.col(f"_l{c}")).alias(f"_{c}") for c in "rgb"), (F.count_if("fg") / F.count("*")).alias("coverage"))
    some = F.col("_w") > 0
    return sums.select(*KEY, "tx", "ty", *(F.when(some, linear_to_srgb(F.col(f"_{c}") / F.col("_w"))).otherwise(0).alias(c) for c in "rgb"), F.when(some, 255).otherwise(0).alias("a"), "coverage")


# Sets and outlines -------------------------------------------------------------------------------


def dilated(dense: DataFrame, mask: str, width: int, connectivity: int, name: str = "dilated") -> DataFrame:
    """dense plus the mask grown by ``width`` steps to its 8 or 4 neighbours."""
    if connectivity == 8:
        return square_extremum(dense.withColumn("_m", F.col(mask).cast("int")), "_m", width, True, "_d").withColumn(name, F.col("_d") == 1).drop("_m", "_d")
    row, column = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(-1, 1), Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(-1, 1)
    out = dense.withColumn(name, F.col(mask).cast("int"))
    for _ in range(width):
        out = out.withColumns({"_h": F.max(name).over(row), "_v": F.max(name).over(column)}).withColumn(name, F.greatest("_h", "_v")).drop("_h", "_v")
    return out.withColumn(name, F.col(name) == 1)


def outlined(dense: DataFrame, mask: str = "body", width: int = 1, connectivity: int = 8, corner_rule: str = "pixel-art") -> DataFrame:
    """dense plus ``outline``: the grown mask without the mask itself.

    The corner rule drops pixels that touch the mask at exactly one corner and on no side.
    """
    grown = dilated(dense, mask, max(width, 1), connectivity).withColumn("_ring", F.col("dilated") & ~F.col(mask)).drop("dilated")
    if corner_rule != "pixel-art" or connectivity != 8:
        return grown.withColumnRenamed("_ring", "outline")
    near = with_neighbours(grown, F.col(mask).cast("int"), "_n")
    held = lambda d: F.coalesce(F.col(neighbour(*d, "_n")), F.lit(0))
    sides = sum((held(d) for d in SIDES), F.lit(0))
    corners = sum((held(d) for d in OFFSETS if d not in SIDES), F.lit(0))
    return near.select(*dense.columns, (F.col("_ring") & ((sides > 0) | (corners != 1))).alias("outline"))


def internal_edges(dense: DataFrame, mask: str = "body", threshold: float = 0.1) -> DataFrame:
    """dense plus ``edge``: the darker of two masked neighbours whose colours are further apart.

    dense has the Oklab columns ok_l, ok_a, ok_b. Each pair is looked at from both of its ends: the
    upper or left end is marked where it is as dark or darker, the other where it is darker.
    """
    if threshold <= 0:
        return dense.withColumn("edge", F.lit(False))
    row, column = Window.partitionBy("image_id", "y").orderBy("x"), Window.partitionBy("image_id", "x").orderBy("y")
    own = F.struct("ok_l", "ok_a", "ok_b")
    seen = dense.withColumn("_c", F.when(F.col(mask), own)).withColumns({"_r": F.lead("_c").over(row), "_l": F.lag("_c").over(row), "_d": F.lead("_c").over(column), "_u": F.lag("_c").over(column)})

    def border(name: str) -> Column:
        d = [F.col("_c")[c] - F.col(name)[c] for c in ("ok_l", "ok_a", "ok_b")]
        return d[0] * d[0] + d[1] * d[1] + d[2] * d[2] > threshold * threshold

    hits = [border(n) & (F.col("ok_l") <= F.col(n)["ok_l"]) for n in ("_r", "_d")] + [border(n) & (F.col("ok_l") < F.col(n)["ok_l"]) for n in ("_l", "_u")]
    edge = F.lit(False)
    for h in hits:
        edge = edge | F.coalesce(h, F.lit(False))
    return seen.select(*dense.columns, (F.col(mask) & edge).alias("edge"))


def composed(dense: DataFrame, mask: str, outline: str, color: tuple[int, int, int, int]) -> DataFrame:
    """The final image: the outline's colour over the body, transparent elsewhere."""
    pick = lambda c, k: F.when(F.col(outline), F.lit(color[k])).when(F.col(mask), F.col(c)).otherwise(0).alias(c)
    return dense.select(*XY, *(pick(c, k) for k, c in enumerate("rgba")))


def mask_image(dense: DataFrame, mask: str, color: tuple[int, int, int, int] = (255, 255, 255, 255)) -> DataFrame:
    """A mask drawn in one colour on transparent ground."""
    return dense.select(*XY, *(F.when(F.col(mask), F.lit(color[k])).otherwise(0).alias(c) for k, c in enumerate("rgba")))


def outline_difference(actual: DataFrame, expected: DataFrame, color: tuple[int, int, int, int]) -> DataFrame:
    """(image_id, extra, missing, mismatch) between two sets of outline pixels; actual has colours."""
    both = actual.select(*XY, *"rgba", F.lit(True).alias("_a")).join(expected.select(*XY, F.lit(True).alias("_e")), XY, "full")
    a, e = F.coalesce("_a", F.lit(False)), F.coalesce("_e", F.lit(False))
    other = F.lit(False)
    for c, v in zip("rgba", color):
        other = other | (F.col(c) != v)
    return both.groupBy(KEY).agg(F.count_if(a & ~e).alias("extra"), F.count_if(e & ~a).alias("missing"), F.count_if(a & e & other).alias("mismatch"))

"""Registered queries of the raster engine: each runs operators over images of the whole part table.

Results are plain columns: whole numbers as long, real numbers rounded to six digits. The SQL that
they are held against is in ``oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterel.functions import color, scalar
from rasterel.operators import components, quality, sheets
from rasterel.operators import palettes as pal
from rasterel.operators import pixels as px
from rasterel.sources import images, records

from . import convert, fixtures, oracle, tools
from .profile import preset
from .provider import HeuristicProvider

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.queries().items() if k in _QUERIES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sprites to foreground, box, cells, most frequent colours: body size and main colour of each image."""
    return mode_sample_summary(spark, sf_dir)


def rounded(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)  # no negative zero


def longs(df: DataFrame, *names: str) -> DataFrame:
    """df with all whole numbers as long, in the order named."""
    kinds = dict(df.dtypes)
    return df.select(*(F.col(n).cast("long").alias(n) if kinds[n] in ("int", "smallint", "tinyint") else F.col(n) for n in names or df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checksum(*names: str) -> Column:
    """A sum that changes with any pixel: weights are small primes."""
    primes = (3, 5, 7, 11, 13, 17, 19)
    return F.sum(sum((F.col(n).cast("long") * p for n, p in zip(names, primes)), F.lit(0).cast("long"))).alias("checksum")


# Sources ---------------------------------------------------------------------------------------------


@query
def raster_allocation(spark, sf_dir):
    """A3: empty images of the parts' sizes."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") % 7).alias("width"), (F.col("p_size") % 5).alias("height"))
    return images.blank(sizes).groupBy("image_id").agg(F.count("*").alias("pixels"), F.sum("x").alias("sum_x"), F.sum("y").alias("sum_y"), F.max("a").cast("long").alias("max_a"))


@query
def pixel_limit_guard(spark, sf_dir):
    """A2: sizes read from PNG headers, before any decoding."""
    hex8 = lambda c: F.lpad(F.hex(c.cast("long")), 8, "0")
    w, h = F.col("p_size") * 997, F.col("p_partkey") % 3000
    head = table(spark, sf_dir, "part").select("p_partkey", F.unhex(F.concat(F.lit(images.PNG + "0000000D49484452"), hex8(w), hex8(h), F.lit("0806000000"))).alias("content"))
    size = images.png_size(F.col("content"))
    return head.select("p_partkey", size.width.alias("width"), size.height.alias("height"), (size.width * size.height > images.MAX_PIXELS).alias("too_large"))


@query
def task_list_parse(spark, sf_dir):
    """Task lines with nulls and blank lines."""
    line = F.when(F.col("c_custkey") % 10 == 0, F.lit("  ")).otherwise(F.to_json(F.struct(F.col("c_name").alias("id"), F.concat("c_mktsegment", F.lit(".png")).alias("input"), F.when(F.col("c_custkey") % 3 == 0, F.lit("48x32")).alias("size"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_nationkey")).alias("max_colors"))))
    lines = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_no"), line.alias("line"))
    return longs(records.parse_tasks(lines), "line_no", "id", "input", "size", "max_colors")


@query
def resume_join(spark, sf_dir):
    """Tasks whose earlier reports can be taken up."""
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("line_no"), F.concat(F.lit("r"), F.col("c_custkey").cast("string")).alias("report_path"))
    old = F.struct(F.lit("pass").alias("status"), F.when(F.col("s_suppkey") % 2 == 0, "a").otherwise("b").alias("profile_sha256"), F.lit(False).alias("cached"))
    reports = table(spark, sf_dir, "supplier").select(F.concat(F.lit("r"), F.col("s_suppkey").cast("string")).alias("report_path"), old.alias("report"))
    todo, done = records.resume(tasks, reports, F.lit("a"))
    return todo.select("line_no", F.lit(False).alias("cached")).union(done.select("line_no", F.col("report.cached").alias("cached")))


@query
def artifact_names(spark, sf_dir):
    """The names of all files that go with an output."""
    out = F.concat(F.lit("out/"), F.translate("p_name", " ", "_"), F.when(F.col("p_partkey") % 3 == 0, ".v1.png").when(F.col("p_partkey") % 3 == 1, ".png").otherwise(""))
    rows = table(spark, sf_dir, "part").select("p_partkey", out.alias("o"))
    return rows.select("p_partkey", *(v.alias(k) for k, v in scalar.artifact_paths(F.col("o")).items()), scalar.cell_path(F.col("o"), F.col("p_partkey") % 4, F.col("p_partkey") % 6).alias("cell"))


@query
def palette_file_text(spark, sf_dir):
    """Palette files of all images."""
    colors = pal.color_set(fixtures.sprites(spark, sf_dir)).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("r", "g", "b"))).alias("c"))
    return colors.select("image_id", scalar.palette_text(F.col("c"), F.lit("character-48"), F.concat(F.lit("s"), F.col("image_id").cast("string"))).alias("content"))


@query
def mask_from_sprite(spark, sf_dir):
    """Bodies read from mask images and from sprites alone."""
    p = fixtures.sprites(spark, sf_dir)
    is_mask = (F.col("a") == 255) & ((F.col("r") > 0) | (F.col("g") > 0) | (F.col("b") > 0))
    dark = (F.col("r") == 30) & (F.col("g") == 25) & (F.col("b") == 20) & (F.col("a") == 255)
    return p.groupBy("image_id").agg(F.count_if(is_mask).alias("mask_pixels"), F.count_if((F.col("a") == 255) & ~dark).alias("body_pixels"))


# Scalars ---------------------------------------------------------------------------------------------


@query
def hex_colors(spark, sf_dir):
    """B1, B2: parsing with bad input, and printing."""
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.format_string("#%06x", k * 7919 % 16777216)).when(k % 5 == 1, F.format_string("%08X", k * 104729 % 4294967296)).when(k % 5 == 2, F.lit("#12345")).when(k % 5 == 3, F.lit("zz0011")).otherwise(F.format_string("%06X", k * 31 % 16777216))
    rows = table(spark, sf_dir, "part").select("p_partkey", color.parse_hex_color(text).alias("c"))
    return longs(rows.select("p_partkey", F.col("c.r").alias("r"), F.col("c.g").alias("g"), F.col("c.b").alias("b"), F.col("c.a").alias("a"), color.to_hex_rgb(F.col("c.r"), F.col("c.g"), F.col("c.b")).alias("text")).withColumn("text", F.when(F.col("r").isNotNull(), F.col("text"))))


@query
def size_texts(spark, sf_dir):
    """Sizes and grids."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.format_string("%dx%d", k % 70, k % 9)).when(k % 4 == 1, F.format_string(" %d X %d", k % 31, k % 11)).when(k % 4 == 2, F.lit("12")).otherwise(F.lit("3x4x5"))
    rows = table(spark, sf_dir, "part").select("p_partkey", scalar.parse_pair(text).alias("p"))
    return rows.select("p_partkey", F.col("p.first").alias("first"), F.col("p.second").alias("second"))


@query
def content_hashes(spark, sf_dir):
    """Digests of content, cache keys, cells."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.sha256_hex(F.col("p_name")).alias("content"), scalar.cell_hash(scalar.sha256_hex(F.col("p_name")), k % 5, k % 3).alias("cell"), scalar.cache_key([F.col(c) for c in ("p_name", "p_brand", "p_type")] + [F.lit("a"), F.lit("")], k * 7).alias("key"))


@query
def target_arithmetic(spark, sf_dir):
    """Preview factor, body region, palette budget."""
    k, s = F.col("p_partkey").cast("int"), F.col("p_size")
    body = lambda c: F.greatest(c - 2 * (s % 3 + 1), F.lit(0)).cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", scalar.preview_factor(k % 300, s).cast("long").alias("preview"), body(k % 60).alias("body_w"), body(s).alias("body_h"), F.greatest(k % 16 - F.when(k % 2 == 0, 1).otherwise(0), F.lit(1)).cast("long").alias("budget"))


@query
def status_merge(spark, sf_dir):
    """The worst status of each type of part, and its exit code."""
    status = F.when(F.col("p_partkey") % 11 == 0, "fail").when(F.col("p_partkey") % 3 == 0, "review").otherwise("pass")
    out = quality.worst(table(spark, sf_dir, "part").select("p_type", status.alias("status")), ["p_type"])
    return out.select("p_type", "status", scalar.exit_code(F.col("status")).cast("long").alias("exit_code"))


@query
def oklab_projection(spark, sf_dir):
    """Oklab of all colours, and the squared distance from grey."""
    colors = fixtures.sprites(spark, sf_dir).select("r", "g", "b").distinct()
    lab = color.with_oklab(colors)
    grey = color.rgb_to_oklab(F.lit(128), F.lit(128), F.lit(128))
    return longs(lab.select("r", "g", "b", *(rounded(c).alias(c) for c in ("ok_l", "ok_a", "ok_b")), rounded(color.distance_sq(color.Lab.of("ok_"), grey)).alias("d2")))


@query
def oklab_roundtrip(spark, sf_dir):
    """To Oklab and back, as it is and with the lightness shifted."""
    lab = color.Lab.of("ok_")
    both = color.with_rgb(color.with_oklab(fixtures.sprites(spark, sf_dir).select("r", "g", "b").distinct()), lab, ("r1", "g1", "b1"))
    lit = color.with_rgb(both, color.with_lightness(lab, lab.l * 0.5 + 0.6), ("r2", "g2", "b2"))
    return longs(lit.drop("ok_l", "ok_a", "ok_b"))


@query
def posterize_bands(spark, sf_dir):
    """Lightness in four steps."""
    p = pal.posterized(fixtures.body(fixtures.sprites(spark, sf_dir)), "body", 4)
    return p.where("body").groupBy("image_id").agg(F.count_distinct(fixtures.code()).alias("colors"), checksum("r", "g", "b", "x", "y"))


@query
def flat_bands(spark, sf_dir):
    """One hue for each step of lightness."""
    p = pal.flat_bands(fixtures.body(fixtures.sprites(spark, sf_dir)), "body", 4)
    return p.where("body").groupBy("image_id").agg(F.count_distinct(fixtures.code()).alias("colors"), checksum("r", "g", "b"))


# Masks and aggregates ----------------------------------------------------------------------------------


@query
def fg_mask_count(spark, sf_dir):
    """Foreground pixels."""
    return fixtures.sprites(spark, sf_dir).where(px.by_alpha(96)).groupBy("image_id").agg(F.count("*").alias("fg_pixels"))


@query
def alpha_coverage(spark, sf_dir):
    """The share of pixels that aren't opaque and the foreground's source."""
    out = px.transparent_share(fixtures.sprites(spark, sf_dir))
    return out.select("image_id", rounded("alpha_coverage").alias("alpha_coverage"), F.when(F.col("alpha_coverage") > 0.01, "alpha").otherwise("corner-background").alias("mask_source"))


@query
def fg_bbox(spark, sf_dir):
    """Boxes around the foreground."""
    return longs(px.bounding_box(fixtures.sprites(spark, sf_dir).withColumn("fg", px.by_alpha(96))))


@query
def corner_background_mask(spark, sf_dir):
    """Foreground by the corners' colour, in images that are opaque."""
    opaque = fixtures.sprites(spark, sf_dir).withColumn("a", F.lit(255))
    fg = px.foreground(opaque).groupBy("image_id").agg(F.count_if("fg").alias("fg_pixels"), F.max("mask_source").alias("mask_source"))
    return longs(px.corner_colors(opaque).join(px.whole(fg), "image_id"))


@query
def alpha_binary(spark, sf_dir):
    """Whether alpha is all or nothing, and whether there is any."""
    return fixtures.sprites(spark, sf_dir).groupBy("image_id").agg(F.bool_and(F.col("a").isin(0, 255)).alias("is_binary"), F.bool_and(F.col("a") == 0).alias("is_empty"))


@query
def line_occupancy(spark, sf_dir):
    """Which columns have any pixel."""
    return fixtures.sprites(spark, sf_dir).groupBy("image_id", F.col("x").cast("long").alias("x")).agg(F.bool_or(F.col("a") != 0).alias("occupied"))


@query
def reserved_border(spark, sf_dir):
    """Pixels in the border, along the edges, and their shares."""
    fg, x, y = F.col("a") >= 96, F.col("x"), F.col("y")
    on = lambda c: F.when(c, 1).otherwise(0)
    edge = on(y == 0) + on(y == 23) + on(x == 0) + on(x == 23)
    return fixtures.sprites(spark, sf_dir).groupBy("image_id").agg(F.count_if(fg & ((x < 4) | (y < 4) | (x >= 20) | (y >= 20))).alias("border_pixels"), F.sum(F.when(fg, edge).otherwise(0)).alias("edge_pixels"), rounded(F.avg(fg.cast("double"))).alias("foreground_ratio"), rounded(F.sum(F.when(fg, edge).otherwise(0)) / 96).alias("edge_ratio"))


@query
def distinct_colors(spark, sf_dir):
    """Colours of the body."""
    return pal.distinct_colors(fixtures.body(fixtures.sprites(spark, sf_dir)), "body")


@query
def final_color_union(spark, sf_dir):
    """Colours of sheets, without repeats."""
    p = fixtures.sheets(fixtures.sprites(spark, sf_dir))
    return longs(pal.color_set(p).groupBy("image_id").agg(F.count("*").alias("colors"), F.min(F.struct("r", "g", "b")).alias("f")).select("image_id", "colors", "f.*"))


@query
def dominant_color(spark, sf_dir):
    """The most frequent colour."""
    return longs(pal.dominant_color(fixtures.sprites(spark, sf_dir).where("a > 0"), ["image_id"]))


@query
def oklab_means(spark, sf_dir):
    """The widest channel and the weighted mean colour."""
    p = color.with_oklab(fixtures.sprites(spark, sf_dir).where("a > 0"))
    w = F.col("a") / F.lit(255.0)
    agg = p.groupBy("image_id").agg(*((F.max(f"ok_{c}") - F.min(f"ok_{c}")).alias(f"s{c}") for c in "lab"), *((F.sum(w * F.col(f"ok_{c}")) / F.sum(w)).alias(f"m{c}") for c in "lab"))
    best = F.greatest("sl", "sa", "sb")
    named = agg.withColumns({"channel": F.when(F.col("sl") == best, "l").when(F.col("sa") == best, "a").otherwise("b"), "span": rounded(best)})
    return longs(color.with_rgb(named, color.Lab.of("m")), "image_id", "channel", "span", "r", "g", "b")


@query
def color_histogram(spark, sf_dir):
    """Weighted histograms of critical and other pixels."""
    p = fixtures.sprites(spark, sf_dir).withColumn("fg", px.by_alpha(96))
    h = pal.histogram(px.inside_regions(p, fixtures.regions(p)), 4.0)
    return h.groupBy("image_id", "critical").agg(F.count("*").alias("entries"), F.sum("n").alias("pixels"), rounded(F.sum(F.col("weight") * F.col("n"))).alias("weight"))


@query
def sheet_histogram(spark, sf_dir):
    """The histogram of all images of a sheet together."""
    p = fixtures.sheets(fixtures.sprites(spark, sf_dir)).withColumn("fg", px.by_alpha(96))
    return pal.histogram(p).groupBy("image_id").agg(F.count_distinct("rgb").alias("colors"), F.sum("n").alias("pixels"), rounded(F.sum(F.col("weight") * F.col("n"))).alias("weight"))


# Cells and samples ---------------------------------------------------------------------------------------


def _celled(spark, sf_dir, side: int, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    p = fixtures.sprites(spark, sf_dir).withColumn("fg", px.by_alpha(96))
    if weighted:
        p = px.inside_regions(p, fixtures.regions(p))
    boxes = px.fitted(px.bounding_box(p), side, side, 2)
    return px.in_cells(p, boxes), boxes


@query
def mode_sample_cells(spark, sf_dir):
    """Most frequent colours in cells, here larger than a pixel of the source and smaller."""
    celled, _ = _celled(spark, sf_dir, 9, True)
    out = px.sample_mode(celled, 4.0)
    return longs(out.withColumn("coverage", rounded("coverage")))


@query
def mode_sample_upscaled(spark, sf_dir):
    """Cells that overlap, for the target is larger than the source."""
    celled, _ = _celled(spark, sf_dir, 30)
    return px.sample_mode(celled).groupBy("image_id").agg(F.count("*").alias("cells"), F.count_if(F.expr("coverage >= 0.5")).alias("solid"), checksum("r", "g", "b", "a", "tx", "ty"))


@query
def area_sample_cells(spark, sf_dir):
    """Mean colours of cells in linear light."""
    celled, _ = _celled(spark, sf_dir, 8)
    return longs(px.sample_area(celled).withColumn("coverage", rounded("coverage")))


@query
def reconstructed_body(spark, sf_dir):
    """Solid cells on the target canvas."""
    celled, boxes = _celled(spark, sf_dir, 20)
    cells = px.sample_mode(celled).where("coverage >= 0.5")
    placed = px.placed(cells, boxes.select("image_id", "fit_w", "fit_h", "body_w", "body_h", "reserved"))
    return longs(placed.groupBy("image_id").agg(F.count("*").alias("body_pixels"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), checksum("r", "g", "b", "x", "y")))


@query
def mode_sample_summary(spark, sf_dir):
    """Body size and main colour of each sampled image."""
    celled, _ = _celled(spark, sf_dir, 16)
    solid = px.sample_mode(celled).where("coverage >= 0.5")
    return longs(pal.dominant_color(solid, ["image_id"], "body_pixels"))


@query
def feature_weights(spark, sf_dir):
    """Regions around pixels."""
    p = fixtures.sprites(spark, sf_dir)
    return px.inside_regions(p, fixtures.regions(p)).groupBy("image_id").agg(F.count_if("critical").alias("critical"), rounded(F.sum("weight")).alias("weight"))


@query
def critical_cells(spark, sf_dir):
    """Cells of the source grid that share a pixel with a critical region."""
    p = fixtures.sprites(spark, sf_dir)
    box = p.select("image_id", F.floor(F.col("x") / 5).cast("int").alias("tx"), F.floor(F.col("y") / 5).cast("int").alias("ty")).distinct()
    cells = box.select("*", (F.col("tx") * 5).alias("rx0"), (F.col("ty") * 5).alias("ry0"), (F.col("tx") * 5 + 5).alias("rx1"), (F.col("ty") * 5 + 5).alias("ry1"))
    return longs(px.cells_with_critical(cells, fixtures.regions(p)).select("image_id", "tx", "ty"))


@query
def sheet_slice_grid(spark, sf_dir):
    """Cells of a grid that doesn't divide the sheet evenly."""
    p = fixtures.sheets(fixtures.sprites(spark, sf_dir))
    out = sheets.slice_sheets(p, fixtures.sizes(p, 48), sheets.Grid(5, 7))
    return longs(out.groupBy("image_id", "cell_row", "cell_col").agg(F.count("*").alias("pixels"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), checksum("r", "g", "b", "a", "x", "y")))


@query
def sheet_slice_cell(spark, sf_dir):
    """Cells of one size, clipped at the edge."""
    p = fixtures.sheets(fixtures.sprites(spark, sf_dir))
    out = sheets.slice_sheets(p, fixtures.sizes(p, 48), sheets.CellSize(13, 20))
    return longs(out.groupBy("image_id", "cell_row", "cell_col").agg(F.count("*").alias("pixels"), F.max("x").alias("max_x"), F.max("y").alias("max_y"), checksum("r", "g", "b", "a", "x", "y")))


@query
def detect_grid(spark, sf_dir):
    """Grids from gutters, where noise is left out."""
    p = fixtures.sheets(fixtures.sprites(spark, sf_dir)).withColumn("a", F.when(F.col("a") == 255, F.when(F.col("r") == 30, 0).otherwise(F.col("a"))).otherwise(0)).where("(x % 24 - 12) * (x % 24 - 12) + (y % 24 - 12) * (y % 24 - 12) <= 49")
    return longs(sheets.detect_grids(p, fixtures.sizes(p, 48)))


@query
def crop_region(spark, sf_dir):
    """A rectangle beyond the edge."""
    return px.crop(fixtures.sprites(spark, sf_dir), 15, 7, 30, 6).groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("r", "g", "b", "a", "x", "y"))


@query
def upscale_preview(spark, sf_dir):
    """Each pixel three times three."""
    return px.upscale(fixtures.sprites(spark, sf_dir).where("a > 0"), 3).groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("r", "g", "b", "a", "x", "y"))


@query
def row_major_order(spark, sf_dir):
    """Pixels numbered row by row; a sum over all numbers and places of each image."""
    w = Window.partitionBy("image_id").orderBy("y", "x")
    numbered = fixtures.sprites(spark, sf_dir).where("a = 255").withColumn("n", F.row_number().over(w).cast("long"))
    return numbered.groupBy("image_id").agg(F.max("n").alias("pixels"), F.sum(F.col("n") * (F.col("x") + 31 * F.col("y"))).alias("checksum"))


# Windows -------------------------------------------------------------------------------------------------


@query
def window_min_max(spark, sf_dir):
    """Extremes in square windows, once and twice over."""
    p = fixtures.sprites(spark, sf_dir)
    out = px.morphology(px.square_extremum(px.square_extremum(p, "r", 2, False, "low"), "r", 2, True, "high"), "g", 1, 3, True, "grown")
    return out.groupBy("image_id").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("grown").alias("grown"), F.sum(F.col("low") * F.col("x") + F.col("high") * F.col("y")).alias("checksum"))


@query
def window_median(spark, sf_dir):
    """Upper medians of lightness in square windows."""
    p = color.with_oklab(fixtures.sprites(spark, sf_dir))
    return px.square_median(p, "ok_l", 2, "m").groupBy("image_id").agg(F.sum(F.round(F.col("m") * 255).cast("long")).alias("bins"), F.sum(F.round(F.col("m") * 255).cast("long") * (F.col("x") + 3 * F.col("y"))).alias("checksum"))


@query
def preserve_details(spark, sf_dir):
    """Lightness moved toward local extremes."""
    p = color.with_oklab(fixtures.sprites(spark, sf_dir).withColumn("fg", px.by_alpha(96)))
    w = px.square_median(px.square_extremum(px.square_extremum(p, "ok_l", 2, False, "low"), "ok_l", 2, True, "high"), "ok_l", 2, "mid")
    weight = color.detail_weight(F.col("low"), F.col("high"), F.col("mid"))
    lab = color.with_lightness(color.Lab.of("ok_"), F.col("low") + (F.col("high") - F.col("low")) * weight)
    new = color.with_rgb(w.where("fg").withColumns(lab.columns("n")), color.Lab.of("n"))
    return new.groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("r", "g", "b", "x", "y"))


@query
def weighted_median_split(spark, sf_dir):
    """Where the cumulative weight in channel order passes the half."""
    p = fixtures.sprites(spark, sf_dir).where("a > 0")
    order = Window.partitionBy("image_id").orderBy("g", "r", "b", "a", "y", "x")
    run = p.withColumns({"acc": F.sum("a").over(order.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("a").over(Window.partitionBy("image_id")), "k": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("image_id"))})
    cut = run.groupBy("image_id").agg(F.min(F.when(2 * F.col("acc") >= F.col("total"), F.col("k"))).alias("k"), F.max("n").alias("n"))
    return longs(cut.select("image_id", F.greatest(F.least("k", F.col("n") - 1), F.lit(1)).alias("cut"), "n"))


# Outlines and clean-up -------------------------------------------------------------------------------------


def _ring(spark, sf_dir, **options) -> DataFrame:
    out = px.outlined(fixtures.body(fixtures.sprites(spark, sf_dir)), **options)
    return out.where("outline").groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("x", "y"))


@query
def dilate8(spark, sf_dir):
    """Growth by two steps to eight neighbours."""
    return px.dilated(fixtures.body(fixtures.sprites(spark, sf_dir)), "body", 2, 8).where("dilated").groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("x", "y"))


@query
def dilate4(spark, sf_dir):
    """Growth by two steps to four neighbours."""
    return px.dilated(fixtures.body(fixtures.sprites(spark, sf_dir)), "body", 2, 4).where("dilated").groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("x", "y"))


@query
def outline_ring(spark, sf_dir):
    """The ring without the corner rule."""
    return _ring(spark, sf_dir, corner_rule="none")


@query
def outline_corner_rule(spark, sf_dir):
    """P10, D3: the ring with the corner rule."""
    return _ring(spark, sf_dir)


@query
def internal_outline(spark, sf_dir):
    """Darker sides of colour borders."""
    p = color.with_oklab(fixtures.body(fixtures.sprites(spark, sf_dir)))
    return px.internal_edges(p, threshold=0.15).where("edge").groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("x", "y"))


@query
def orphan_merge(spark, sf_dir):
    """Lone pixels take the colour around."""
    p = fixtures.body(fixtures.sprites(spark, sf_dir)).withColumn("lock", (F.col("x") + F.col("y")) % 5 == 0)
    return pal.merge_orphans(p, lock="lock").groupBy("image_id").agg(checksum("r", "g", "b", "a", "x", "y"))


@query
def jaggy_cleanup(spark, sf_dir):
    """Pixels that stick out of flat edges."""
    bars = fixtures.sprites(spark, sf_dir).withColumns({"body": F.lit(True), "r": F.when(F.col("y") < 12, 10).when((F.col("y") == 12) & ((F.col("x") * 7 + F.col("image_id")) % 5 == 0), 10).otherwise(200).cast("int"), "g": F.lit(50), "b": F.lit(60), "a": F.lit(255)})
    return pal.smooth_jaggies(bars).groupBy("image_id").agg(checksum("r", "g", "b", "a", "x", "y"), F.count_if(F.expr("r = 10")).alias("dark"))


@query
def cleanup_converged(spark, sf_dir):
    """Four rounds of both rules."""
    p = fixtures.body(fixtures.sprites(spark, sf_dir))
    return pal.converged(p).groupBy("image_id").agg(checksum("r", "g", "b", "a", "x", "y"))


@query
def neighbour_pairs(spark, sf_dir):
    """Neighbours among sparse pixels."""
    p = fixtures.sprites(spark, sf_dir).where("a > 0 and a < 255")
    return px.neighbour_pairs(p).groupBy("image_id").agg(F.count("*").alias("pairs"), checksum("x", "y", "nx", "ny"))


@query
def outline_compare(spark, sf_dir):
    """An outline held against the one expected."""
    p = px.outlined(fixtures.body(fixtures.sprites(spark, sf_dir)))
    actual = p.where("a > 0 and not body")
    return px.outline_difference(actual, p.where("outline"), (30, 25, 20, 255))


@query
def compose_overlay(spark, sf_dir):
    """Outlines over bodies."""
    p = px.outlined(fixtures.body(fixtures.sprites(spark, sf_dir)))
    return px.composed(p, "body", "outline", (43, 16, 9, 255)).groupBy("image_id").agg(F.count_if(F.expr("a > 0")).alias("pixels"), checksum("r", "g", "b", "a", "x", "y"))


# Components and features -----------------------------------------------------------------------------------


@query
def component_count(spark, sf_dir):
    """G1: 8-connected components of the foreground."""
    return components.component_count(fixtures.sprites(spark, sf_dir).where(px.by_alpha(96)))


@query
def component_count_by_runs(spark, sf_dir):
    """G1: the same by rounds over runs of pixels, for images larger than a task."""
    return components.component_count(fixtures.sprites(spark, sf_dir).where(px.by_alpha(96)), method="sql")


@query
def small_component_filter(spark, sf_dir):
    """The foreground without specks."""
    return components.without_small(fixtures.sprites(spark, sf_dir).where(px.by_alpha(96)), 3).groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("x", "y"))


@query
def skin_face_bbox(spark, sf_dir):
    """The largest plausible patch of skin."""
    p = fixtures.sprites(spark, sf_dir)
    return longs(components.faces(p, fixtures.sizes(p)))


@query
def eye_blobs(spark, sf_dir):
    """Dark blobs in a box."""
    p = fixtures.sprites(spark, sf_dir)
    face = p.select("image_id").distinct().select("image_id", F.lit(4).alias("x0"), F.lit(4).alias("y0"), F.lit(20).alias("x1"), F.lit(20).alias("y1"))
    return longs(components.eyes(p, face))


@query
def heuristic_features(spark, sf_dir):
    """Faces and eyes together."""
    p = fixtures.sprites(spark, sf_dir)
    return longs(components.feature_regions(p, fixtures.sizes(p)))


@query
def provider_features(spark, sf_dir):
    """The same from image tiles, through the provider's interface."""
    return longs(HeuristicProvider().regions(fixtures.tiles(fixtures.sprites(spark, sf_dir))))


# Palettes --------------------------------------------------------------------------------------------------


@query
def nearest_palette_remap(spark, sf_dir):
    """Pixels in the nearest of fixed colours."""
    p = fixtures.body(fixtures.sprites(spark, sf_dir))
    return longs(pal.nearest_remap(p, fixtures.palette(spark), "body").where("body").groupBy("image_id", "r", "g", "b", "a").agg(F.count("*").alias("pixels")))


@query
def exact_palette(spark, sf_dir):
    """P5: colours as they are where they fit the budget."""
    h = pal.histogram(fixtures.sprites(spark, sf_dir).withColumn("fg", px.by_alpha(96)))
    return longs(pal.exact_palettes(h, 8))


@query
def lloyd_round(spark, sf_dir):
    """Centres moved once toward the colours nearest to them."""
    p = fixtures.sprites(spark, sf_dir).where(px.by_alpha(96))
    colors = color.with_oklab(p.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n")))
    centres = color.with_oklab(fixtures.palette_per_image(p)).select("image_id", "idx", *(F.col(f"ok_{c}").alias(c) for c in "lab"))
    return longs(pal.lloyd_round(colors, centres).select("image_id", "idx", *(rounded(c).alias(c) for c in "lab")))


@query
def lloyd_refine(spark, sf_dir):
    """Palettes after three rounds."""
    p = fixtures.sprites(spark, sf_dir).where(px.by_alpha(96))
    colors = color.with_oklab(p.groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("n")))
    return longs(pal.lloyd_refined(colors, fixtures.palette_per_image(p), 3))


@query
def median_cut_palette(spark, sf_dir):
    """Palettes of four colours."""
    h = pal.histogram(fixtures.sprites(spark, sf_dir).withColumn("fg", px.by_alpha(96)))
    return longs(pal.palettes(h, 4))


@query
def quantized(spark, sf_dir):
    """Pixels in the colours of their image's palette."""
    p = fixtures.body(fixtures.sprites(spark, sf_dir)).withColumn("fg", F.col("body"))
    return longs(pal.nearest_remap(p, pal.palettes(pal.histogram(p.withColumn("a", F.lit(255))), 4), "body").where("body").groupBy("image_id", "r", "g", "b").agg(F.count("*").alias("pixels")))


@query
def kcentroid_cells(spark, sf_dir):
    """The centres of the heaviest clusters of cells."""
    celled, _ = _celled(spark, sf_dir, 4)
    return longs(pal.kcentroid_cells(celled).withColumn("coverage", rounded("coverage")))


# Pipelines ---------------------------------------------------------------------------------------------------


@query
def qa_gate(spark, sf_dir):
    """Metrics and the gate, over images taken as sprites."""
    p = fixtures.body(fixtures.sprites(spark, sf_dir)).withColumn("a", F.when(F.col("image_id") % 3 == 0, F.col("a")).when(F.col("a") >= 96, 255).otherwise(0))
    p = p.withColumn("body", F.col("body") & (F.col("image_id") % 10 != 0))
    m = quality.sprite_metrics(p, fixtures.sizes(p), 24, 24, 9, 1)
    k = F.col("image_id")
    full = m.withColumns({"outline_extra_pixels": k % 2 * (k % 7), "outline_missing_pixels": F.when(k % 5 == 0, 2).otherwise(0), "outline_color_mismatch_pixels": F.lit(0), "body_components": k % 9, "mask_source": F.when(k % 4 == 0, "corner-background").otherwise("alpha")})
    out = quality.gate(full, 6)
    return longs(out.select("image_id", "body_pixels", "palette_colors", "body_pixels_in_reserved_border", "status", F.array_join(F.col("reasons.code"), ",").alias("reasons")))


@query
def inspect_sprites(spark, sf_dir):
    """Findings on all images."""
    p = fixtures.sprites(spark, sf_dir).withColumns({"fg": px.by_alpha(96), "width": F.lit(24), "height": F.lit(24)})
    out = quality.inspect(p, components.component_count(p.where("fg")), sheets.detect_grids(p, fixtures.sizes(p)))
    return longs(out.select("image_id", rounded("alpha_coverage").alias("alpha_coverage"), rounded("foreground_ratio").alias("foreground_ratio"), rounded("edge_foreground_ratio").alias("edge_ratio"), "component_estimate", "touches_border", "is_sprite_sheet", "suggested_mode", F.col("confidence").cast("double").alias("confidence"), F.size("warnings").alias("warnings")))


@query
def convert_sprites(spark, sf_dir):
    """All images to sprites of the 48 pixel profile, with features."""
    done = convert.convert(fixtures.tiles(fixtures.sprites(spark, sf_dir)), preset(48), F.col("path"), detect_features=True, sidecars=False)
    return done.select("image_id", "status", "body_pixels", "outline_pixels", "body_components", "palette_colors", F.sha2("final_png", 256).alias("png_sha256"), F.sha2(F.to_json("report"), 256).alias("report_sha256"))


@query
def convert_sheets(spark, sf_dir):
    """All cells of all sheets, each sheet with one palette."""
    t = fixtures.tiles(fixtures.sheets(fixtures.sprites(spark, sf_dir)))
    done = convert.convert_sheets(t, preset(32), F.col("path"), sheets.Grid(2, 2), sidecars=False)
    return longs(done.select("sheet_id", "cell_row", "cell_col", "status", "body_pixels", "palette_colors", F.sha2("final_png", 256).alias("png_sha256")))


@query
def validate_sprites(spark, sf_dir):
    """Findings on images taken as finished sprites."""
    out = tools.validate_pairs(fixtures.tiles(fixtures.sprites(spark, sf_dir)), preset(32))
    return out.select("path", "status", "body_pixels", "body_components", "palette_colors", "outline_extra_pixels", "outline_missing_pixels", "outline_color_mismatch_pixels", F.array_join(F.col("reasons.code"), ",").alias("reasons"))


@query
def tiles_roundtrip(spark, sf_dir):
    """A1, A3: pixels to tiles and back."""
    back = images.to_pixels(images.to_tiles(fixtures.sprites(spark, sf_dir)))
    return back.groupBy("image_id").agg(F.count("*").alias("pixels"), checksum("r", "g", "b", "a", "x", "y"))

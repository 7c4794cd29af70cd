"""The four entry points over files: inspect, convert, validate, batch."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterel.functions.scalar import EXIT_CODE
from rasterel.operators import components, kernels, sheets
from rasterel.operators.quality import gate, inspect, worst
from rasterel.sources import images, records
from rasterel.sources.sinks import write_files

from . import convert as conversion
from .convert import hex_color
from .profile import Profile, parse_pair, resolve

#: Tasks of a list that are converted one after another, and parts of a list at most.
TASKS_A_PART, MOST_PARTS = 32, 65536


def inspect_images(spark: SparkSession, path: str, max_pixels: int = images.MAX_PIXELS) -> DataFrame:
    """A row of findings per readable image under a path."""
    tiles = images.scan(spark, path, max_pixels)
    pixels = images.to_pixels(tiles)
    sizes = tiles.where("data is not null").select("image_id", "width", "height")
    marked = pixels.join(sizes, "image_id").withColumn("fg", F.col("a") >= 96)
    found = inspect(marked, components.component_count(marked.where("fg")), sheets.detect_grids(pixels, sizes))
    names = tiles.select("image_id", F.col("path").alias("input"), F.col("sha256").alias("input_sha256"))
    return names.join(found, "image_id").drop("image_id")


def sheet_spec(grid: str | None = None, cell: str | None = None, auto_grid: bool = False) -> tuple[bool, sheets.Grid | sheets.CellSize | None]:
    """(whether the input is a sheet, how to slice it; None looks for a grid) from at most one option."""
    if (grid is not None) + (cell is not None) + auto_grid > 1:
        raise ValueError("grid, cell and auto_grid exclude each other")
    if grid is not None:
        return True, sheets.Grid(*parse_pair(grid, "grid"))
    if cell is not None:
        return True, sheets.CellSize(*parse_pair(cell, "cell"))
    return auto_grid, None


def convert_file(spark: SparkSession, path: str, output: str, profile: str = "character-48", *, size: str | None = None, max_colors: int | None = None, outline_color: str | None = None, max_pixels: int = images.MAX_PIXELS,
                 sidecars: bool = True, detect_features: bool = False, emit_palette: bool = False, grid: str | None = None, cell: str | None = None, auto_grid: bool = False) -> tuple[list[str], int]:
    """Converts one file, or each cell of one sheet, and writes everything; returns report lines and exit code.

    Nothing is written if the file can't be converted: an error is raised.
    """
    own = resolve(profile).with_overrides(size, max_colors, outline_color)
    is_sheet, spec = sheet_spec(grid, cell, auto_grid)
    tiles = images.scan(spark, path, max_pixels)
    out = F.lit(output)
    if is_sheet:
        done = conversion.convert_sheets(tiles, own, out, spec, detect_features, sidecars)
        own_out = F.col("cell_output")
    else:
        done, own_out = conversion.convert(tiles, own, out, detect_features, sidecars), out
    if emit_palette:
        palette = conversion.artifact_paths(out)["palette"]
        done = done.withColumn("report", F.col("report").withField("artifacts", F.col("report.artifacts").withField("palette", palette)))
    done = done.persist()
    try:
        rows = done.select("status", "error", F.to_json("report").alias("line"), *(["cell_row", "cell_col"] if is_sheet else [])).orderBy(*(["cell_row", "cell_col"] if is_sheet else ["status"])).collect()  # one file's
        if not rows or any(r.error for r in rows):
            raise ValueError(next((r.error for r in rows if r.error), f"no image at {path}"))
        write_files(conversion.files_of(done, own_out, sidecars)).count()
        if emit_palette:
            write_files(conversion.palette_file(done, own, out)).count()
    finally:
        done.unpersist()
    return [r.line for r in rows], max(EXIT_CODE[r.status] for r in rows)


def validate_pairs(sprites: DataFrame, profile: Profile) -> DataFrame:
    """Findings on existing sprites: (path, sha256, width, height, data, error[, mask[, mask_width, mask_height]]) tiles, mask being RGBA as well.

    Without a mask, the body is what is opaque and hasn't the outline's colour. A mask of another size
    than its sprite is an error.
    """
    color = hex_color(profile.outline.color)
    schema = "path string, sha256 string, width int, height int, mask_source string, dimension_valid boolean, alpha_binary boolean, body_pixels long, outline_pixels long, body_components long, palette_colors long, palette_limit long, outline_extra_pixels long, outline_missing_pixels long, outline_color_mismatch_pixels long, body_pixels_in_reserved_border long, error string"

    def one(path, sha, w, h, data, error, mask, mask_width, mask_height) -> tuple:
        if error is None and mask is not None and (len(mask) != len(data) or (mask_width or w, mask_height or h) != (w, h)):
            error = "the mask's size isn't the sprite's"
        if error is not None:
            return (path, sha, w, h, *[None] * 12, error)
        image = np.frombuffer(data, np.uint8).reshape(h, w, 4)
        solid = image[..., 3] == 255
        if mask is None:
            body = solid & (image != color).any(axis=-1)
        else:
            m = np.frombuffer(mask, np.uint8).reshape(h, w, 4)
            body = (m[..., 3] == 255) & (m[..., :3] > 0).any(axis=-1)
        expected = kernels.outline(body, profile.outline.width, profile.outline.connectivity, profile.outline.corner_rule)
        actual = solid & ~body
        wrong = actual & expected & (image != color).any(axis=-1)
        return (path, sha, w, h, "alpha", (w, h) == (profile.target.width, profile.target.height), bool(np.isin(image[..., 3], (0, 255)).all()), int(body.sum()), 0, len(kernels.components(body)),
                len(np.unique(kernels.packed(image[body]))), profile.palette.max_colors, int((actual & ~expected).sum()), int((expected & ~actual).sum()), int(wrong.sum()), 0, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), *[pa.int64()] * 9, pa.string())
        for batch in batches:
            rows = [one(*r) for r in zip(*(c.to_pylist() for c in batch.columns))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[x.split()[0] for x in schema.split(", ")])

    masks = [(F.col(n) if n in sprites.columns else F.lit(None).cast(t)).alias(n) for n, t in (("mask", "binary"), ("mask_width", "int"), ("mask_height", "int"))]
    found = sprites.select("path", "sha256", "width", "height", "data", "error", *masks).mapInArrow(run, schema)
    gated = gate(found, profile.cleanup.max_body_components)
    return gated.withColumn("status", F.when(F.col("error").isNotNull(), "fail").otherwise(F.col("status")))


def validate_reports(found: DataFrame, profile: Profile) -> DataFrame:
    """(path, status, error, line): findings as lines of report, without files."""
    none = F.lit(None).cast("string")
    report = F.struct(
        F.lit(records.SCHEMA_VERSION).alias("schema_version"), F.lit(records.TOOL_VERSION).alias("tool_version"), "status", F.col("path").alias("input"), F.lit(profile.name).alias("profile"),
        F.lit(profile.sha256).alias("profile_sha256"), F.col("sha256").alias("input_sha256"), F.struct("width", "height").alias("canvas"),
        "mask_source", F.lit(False).alias("cached"), F.struct(*conversion.METRICS).alias("qa"), "reasons", F.array().cast("array<string>").alias("warnings"), F.struct(none.alias("final_png")).alias("artifacts"),
    )
    return found.select("path", "status", "error", F.to_json(report).alias("line"))


def validate_file(spark: SparkSession, path: str, profile: str = "character-48", mask_path: str | None = None, max_pixels: int = images.MAX_PIXELS) -> DataFrame:
    """Findings on the sprites under a path, with one mask file if named."""
    tiles = images.scan(spark, path, max_pixels)
    if mask_path:
        mask = images.scan(spark, mask_path, max_pixels).select(F.col("data").alias("mask"), F.col("width").alias("mask_width"), F.col("height").alias("mask_height"), F.col("error").alias("_unread")).limit(1)
        tiles = tiles.crossJoin(F.broadcast(mask))  # one row, of max_pixels at most
        tiles = tiles.withColumn("error", F.coalesce("error", F.concat(F.lit("mask: "), "_unread"))).drop("_unread")
    return validate_pairs(tiles, resolve(profile))


def run_batch(spark: SparkSession, manifest: str, out_dir: str, profile: str = "character-48", resume: bool = False, check_profile: bool = False, max_pixels: int = images.MAX_PIXELS) -> tuple[DataFrame, str]:
    """Runs the tasks of a list; returns (line_no, id, status, line) in the list's order, and the worst status.

    A task that fails is a line with its error; no tasks give no lines and pass. Settings are
    columns, so that all tasks are one pass over their images, whatever profiles they name; a
    task's profile is read by the task that converts it. With resume, a readable report of an
    earlier run stands for its task.
    """
    tasks = records.read_tasks(spark, manifest)
    default = resolve(profile)
    output = F.coalesce("output", F.concat(F.lit(out_dir.rstrip("/") + "/"), "id", F.lit(".png")))
    tasks = tasks.withColumns({"output": output, "report_path": conversion.artifact_paths(output)["report"]})
    done = None
    if resume:
        try:
            earlier = records.earlier_reports(spark, f"{out_dir.rstrip('/')}/*.report.json")
        except Exception as e:  # no report yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            earlier = None
        if earlier is not None:
            same = F.lit(default.sha256) if check_profile else None
            tasks, done = records.resume(tasks, earlier, same)

    def chosen(name: str | None, size: str | None, max_colors: int | None, outline_color: str | None) -> Profile:
        return (default if name is None else resolve(name)).with_overrides(size, max_colors, outline_color)

    parts = max(1, min(MOST_PARTS, -(-tasks.count() // TASKS_A_PART)))
    settings = ("profile", "size", "max_colors", "outline_color")
    tiles = read_named(tasks.select("line_no", "id", "input", "output", *(F.col(c).alias(f"own_{c}") for c in settings)).repartition(parts, "line_no"), max_pixels)
    made = conversion.sprites(tiles, chosen, settings=[f"own_{c}" for c in settings])
    made = conversion.reports(made, None, F.col("sha256"), F.col("output"), F.col("id")).persist()
    write_files(conversion.files_of(made, F.col("output"))).count()
    lines = made.select("line_no", "id", "status", conversion.result_line(F.col("id")).alias("line"))
    if done is not None:
        lines = lines.union(done.select("line_no", "id", F.col("report.status").alias("status"), F.to_json("report").alias("line")))
    lines = lines.persist()
    status = worst(lines).first()
    made.unpersist()
    return records.in_order(lines), status.status if status and status.status else "pass"


def read_named(tasks: DataFrame, max_pixels: int = images.MAX_PIXELS) -> DataFrame:
    """Tiles of the files that tasks (line_no, input and any others) name, with all columns but input; each task reads its own file."""
    passed = [c for c in tasks.columns if c != "input"]
    schema = ", ".join(f"`{c}` {tasks.schema[c].dataType.simpleString()}" for c in passed) + ", " + images.TILES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            line_no, named = (batch.column(batch.schema.get_field_index(c)) for c in ("line_no", "input"))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in passed]
            for k in range(batch.num_rows):
                path, image, sha, error = named[k].as_py(), None, None, None
                try:
                    fs, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
                    with fs.open_input_file(name) as f:
                        content = f.read()
                    sha = hashlib.sha256(content).hexdigest()
                    image = images.read_image(content, max_pixels)
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                tile = images.tile_batch([(line_no[k].as_py(), path, sha, *((image.shape[1], image.shape[0], image.tobytes()) if image is not None else (None,) * 3), error)])
                yield pa.record_batch([*(c.slice(k, 1) for c in kept), *tile.columns], names=[*passed, *tile.schema.names])

    return tasks.mapInArrow(run, schema)

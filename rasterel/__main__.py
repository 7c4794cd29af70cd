"""Command line: inspect, convert, validate, batch.

Standard output is JSON only. The exit code follows the worst status (pass 0, review 2, fail 3);
1 means that nothing could be done.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from rasterel.functions.scalar import EXIT_CODE
from rasterel.plans import tools
from rasterel.sources.images import MAX_PIXELS


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="rasterel", description="Compiles illustrations into small sprites.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, what: str, pretty: bool = True) -> argparse.ArgumentParser:
        c = commands.add_parser(name, help=what)
        c.add_argument("input")
        c.add_argument("--max-pixels", type=int, default=MAX_PIXELS)
        if pretty:
            c.add_argument("--pretty", action="store_true")
        return c

    command("inspect", "look at an image and suggest how to convert it")
    c = command("convert", "convert an image, or each cell of a sheet")
    c.add_argument("-o", "--output", required=True)
    c.add_argument("-p", "--profile", default="character-48")
    for option in ("--size", "--outline-color"):
        c.add_argument(option)
    c.add_argument("--max-colors", type=int)
    how = c.add_mutually_exclusive_group()
    how.add_argument("--grid")
    how.add_argument("--cell")
    how.add_argument("--auto-grid", action="store_true")
    for option in ("--no-sidecars", "--detect-features", "--emit-palette"):
        c.add_argument(option, action="store_true")
    v = command("validate", "check a finished sprite")
    v.add_argument("-p", "--profile", default="character-48")
    v.add_argument("--body-mask")
    b = command("batch", "convert the tasks of a list", pretty=False)
    b.add_argument("-p", "--profile", default="character-48")
    b.add_argument("--out-dir", default=".")
    b.add_argument("--jobs", type=int, help="tasks at a time; all cores if not given")
    b.add_argument("--resume", action="store_true")
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> tuple[list[str], int]:
    """(lines of output, exit code)."""
    if args.command == "batch":
        lines, worst = tools.run_batch(spark, args.input, args.out_dir, args.profile, args.resume, max_pixels=args.max_pixels)
        return [r.line for r in lines.select("line").toLocalIterator()], EXIT_CODE[worst]
    if args.command == "convert":
        lines, code = tools.convert_file(
            spark, args.input, args.output, args.profile, size=args.size, max_colors=args.max_colors, outline_color=args.outline_color, max_pixels=args.max_pixels,
            sidecars=not args.no_sidecars, detect_features=args.detect_features, emit_palette=args.emit_palette, grid=args.grid, cell=args.cell, auto_grid=args.auto_grid,
        )
    elif args.command == "inspect":
        found = tools.inspect_images(spark, args.input, args.max_pixels)
        lines, code = [r.line for r in found.select(F.to_json(F.struct("*")).alias("line")).collect()], 0
    else:
        found = tools.validate_reports(tools.validate_file(spark, args.input, args.profile, args.body_mask, args.max_pixels), tools.resolve(args.profile)).collect()
        errors = [r.error for r in found if r.error]
        if errors:
            raise ValueError(errors[0])
        lines, code = [r.line for r in found], max((EXIT_CODE[r.status] for r in found), default=1)
    if not lines:
        raise ValueError(f"no image at {args.input}")
    return [json.dumps(json.loads(x), indent=2, ensure_ascii=False) if args.pretty else x for x in lines], code


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("rasterel").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.master(f"local[{getattr(args, 'jobs', None) or '*'}]").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    try:
        lines, code = run(spark, args)
    except Exception as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print("\n".join(lines))
    return code


if __name__ == "__main__":
    sys.exit(main())

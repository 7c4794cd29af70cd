"""Colour functions as Column expressions: hex, sRGB, Oklab and what is built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The published Oklab matrices, and their inverses' signs and order.
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_LAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


@dataclass(frozen=True)
class Lab:
    """An Oklab colour as three columns."""

    l: Column  # noqa: E741
    a: Column
    b: Column

    @classmethod
    def of(cls, prefix: str) -> Lab:
        return cls(F.col(f"{prefix}l"), F.col(f"{prefix}a"), F.col(f"{prefix}b"))

    def columns(self, prefix: str) -> dict[str, Column]:
        return {f"{prefix}l": self.l, f"{prefix}a": self.a, f"{prefix}b": self.b}


def _times(matrix, values: list[Column]) -> list[Column]:
    return [F.lit(row[0]) * values[0] + F.lit(row[1]) * values[1] + F.lit(row[2]) * values[2] for row in matrix]


def parse_hex_color(text: Column) -> Column:
    """struct(r, g, b, a) of "#rrggbb" or "#rrggbbaa", the # may be left out; null for anything else."""
    digits = F.regexp_replace(text, "^#", "")
    part = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("int")
    alpha = F.when(F.length(digits) == 8, part(3)).otherwise(F.lit(255))
    return F.when(text.rlike("^#?([0-9a-fA-F]{6}|[0-9a-fA-F]{8})$"), F.struct(part(0).alias("r"), part(1).alias("g"), part(2).alias("b"), alpha.alias("a")))


def to_hex_rgb(r: Column, g: Column, b: Column) -> Column:
    """The colour as "#RRGGBB"."""
    return F.format_string("#%02X%02X%02X", r, g, b)


def srgb_to_linear(channel: Column) -> Column:
    """Linear light, 0 to 1, of an 8-bit channel: looked up, for there are only 256 values."""
    table = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in (c / 255 for c in range(256))]
    return F.get(F.array(*map(F.lit, table)), channel)


def linear_to_srgb(light: Column) -> Column:
    """The 8-bit channel of linear light, which is clamped to 0 to 1."""
    x = F.greatest(F.least(light, F.lit(1.0)), F.lit(0.0))
    s = F.when(x <= 0.0031308, x * 12.92).otherwise(F.lit(1.055) * F.pow(x, F.lit(1 / 2.4)) - 0.055)
    return F.greatest(F.least(F.round(s * 255), F.lit(255.0)), F.lit(0.0)).cast("int")


def linear_to_oklab(r: Column, g: Column, b: Column) -> Lab:
    return Lab(*_times(TO_LAB, [F.cbrt(x) for x in _times(TO_LMS, [r, g, b])]))


def rgb_to_oklab(r: Column, g: Column, b: Column) -> Lab:
    return linear_to_oklab(srgb_to_linear(r), srgb_to_linear(g), srgb_to_linear(b))


def oklab_to_linear(lab: Lab) -> list[Column]:
    """Linear r, g, b, clamped to 0 to 1."""
    cubes = [x * x * x for x in _times(FROM_LAB, [lab.l, lab.a, lab.b])]
    return [F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) for x in _times(FROM_LMS, cubes)]


def oklab_to_rgb(lab: Lab) -> list[Column]:
    return [linear_to_srgb(x) for x in oklab_to_linear(lab)]


def distance_sq(one: Lab, other: Lab) -> Column:
    """The squared distance of two Oklab colours."""
    parts = [one.l - other.l, one.a - other.a, one.b - other.b]
    return parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2]


def with_oklab(df: DataFrame, prefix: str = "ok_", channels: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """``df`` plus the Oklab columns of its colour columns.

    Each step is a projection of its own: what a later one uses several times is computed once.
    """
    light = df.withColumns({f"_q{k}": srgb_to_linear(F.col(c)) for k, c in enumerate(channels)})
    roots = light.withColumns({f"_q{k}": F.cbrt(x) for k, x in enumerate(_times(TO_LMS, _steps()))})
    return roots.withColumns(dict(zip((f"{prefix}{c}" for c in "lab"), _times(TO_LAB, _steps())))).drop("_q0", "_q1", "_q2")


def with_rgb(df: DataFrame, lab: Lab, names: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """``df`` plus the 8-bit channels of an Oklab colour, in projections as above."""
    out = df.withColumns({f"_q{k}": x for k, x in enumerate(_times(FROM_LAB, [lab.l, lab.a, lab.b]))})
    out = out.withColumns({f"_q{k}": x * x * x for k, x in enumerate(_steps())})
    out = out.withColumns({f"_q{k}": F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)) for k, x in enumerate(_times(FROM_LMS, _steps()))})
    return out.withColumns({n: linear_to_srgb(x) for n, x in zip(names, _steps())}).drop("_q0", "_q1", "_q2")


def _steps() -> list[Column]:
    return [F.col(f"_q{k}") for k in range(3)]


def posterized(lab: Lab, levels: int) -> Lab:
    """Lightness rounded to one of ``levels`` even steps; hue and chroma stay. No change below two levels."""
    return lab if levels < 2 else Lab(F.round(lab.l * (levels - 1)) / (levels - 1), lab.a, lab.b)


def with_lightness(lab: Lab, lightness: Column) -> Lab:
    """The colour with another lightness, clamped to 0 to 1."""
    return Lab(F.greatest(F.least(lightness, F.lit(1.0)), F.lit(0.0)), lab.a, lab.b)


def detail_weight(low: Column, high: Column, median: Column) -> Column:
    """How far bright detail is favoured, 0 to 1, from the extremes and the median around a pixel."""
    spread = F.greatest(high - median, F.lit(0.0)) - F.greatest(median - low, F.lit(0.0))
    return 1 / (1 + F.exp(-4 * ((1 - median) + spread)))


def is_skin(lab: Lab) -> Column:
    """A warm hue of middle to high lightness and moderate chroma."""
    return (lab.l > 0.5) & (lab.l < 0.92) & (lab.a > 0.035) & (lab.b > 0.05) & (lab.b < 0.2)


def packed(r: Column, g: Column, b: Column) -> Column:
    """The colour as one number that sorts as (r, g, b) does."""
    return F.shiftleft(r, 16).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def unpacked(rgb: Column) -> list[Column]:
    return [F.shiftright(rgb, 16).bitwiseAND(255), F.shiftright(rgb, 8).bitwiseAND(255), rgb.bitwiseAND(255)]

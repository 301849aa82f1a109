"""Values to colours, as arithmetic on columns. Colours are arrays of 0..255 integers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.numbers import clamp, finite, half_up, number

#: Words for a missing value, the default ramp, the fill of a missing value.
MISSING_WORDS = ("na", "n/a", "nan", "none", "null", "unassigned", "unknown")
RAMP = ((0, 64, 255), (255, 220, 0))
MISSING_FILL = (128, 128, 128, 255)
GOLDEN = 0.6180339887498949
LIGHTNESS, CHROMA = 0.72, 0.32
GREY = 128


def cell(v: Column, of_text: bool) -> Column:
    """A value as text: null and non-finite numbers are '', text stays as it is."""
    return F.coalesce(v, F.lit("")) if of_text else F.when(finite(v), v.cast("string")).otherwise("")


def missing(text: Column, words: Sequence[str] = MISSING_WORDS) -> Column:
    return (F.trim(text) == "") | F.lower(F.trim(text)).isin(list(words))


def mode(kind: str | None, explicit: str | None = None, all_numbers: bool = False) -> str:
    if explicit:
        return explicit
    if kind is not None:
        return "continuous" if kind == "numeric" else "categorical"
    return "continuous" if all_numbers else "categorical"


def symlog(v: Column) -> Column:
    return F.signum(v) * F.log1p(F.abs(v))


def position(v: Column, low: Column, high: Column, log: bool = False) -> Column:
    """Where a value stands between the ends, 0.5 if they are one."""
    f = symlog if log else (lambda c: c)
    return F.when(f(high) == f(low), F.lit(0.5)).otherwise((f(v) - f(low)) / F.nullif(f(high) - f(low), F.lit(0.0)))


def ramp(t: Column, stops: Sequence[Sequence[int]] = RAMP) -> Column:
    """Linear between equally spaced stops; t is clipped and channels are rounded half up."""
    n = len(stops)
    t = clamp(t, 0.0, 1.0)
    if n == 1:
        return F.array(*[F.lit(int(c)) for c in stops[0]])
    at = F.least(F.floor(t * (n - 1)), F.lit(n - 2)).cast("int")
    part = t * (n - 1) - at

    def channel(k: int) -> Column:
        v = F.array(*[F.lit(float(s[k])) for s in stops])
        a, b = F.get(v, at), F.get(v, at + 1)
        return half_up(a + (b - a) * part).cast("int")

    return F.array(*[channel(k) for k in range(len(stops[0]))])


def golden_hue(code: Column) -> Column:
    return F.pmod(code * F.lit(GOLDEN), F.lit(1.0)) * (2 * math.pi)


def oklab(code: Column) -> Column:
    """The code's colour at equal lightness, hues a golden ratio apart; negative codes are grey.

    The matrices are those of the published OKLab colour space.
    """
    hue = golden_hue(code)
    a, b = F.lit(CHROMA) * F.cos(hue), F.lit(CHROMA) * F.sin(hue)
    cube = lambda c: c * c * c
    long = cube(F.lit(LIGHTNESS) + 0.3963377774 * a + 0.2158037573 * b)
    mid = cube(F.lit(LIGHTNESS) - 0.1055613458 * a - 0.0638541728 * b)
    short = cube(F.lit(LIGHTNESS) - 0.0894841775 * a - 1.2914855480 * b)
    linear = (
        4.0767416621 * long - 3.3077115913 * mid + 0.2309699292 * short,
        -1.2684380046 * long + 2.6097574011 * mid - 0.3413193965 * short,
        -0.0041960863 * long - 0.7034186147 * mid + 1.7076147010 * short,
    )
    gamma = lambda c: F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) - 0.055)
    rgb = [half_up(clamp(gamma(c), 0.0, 1.0) * 255).cast("int") for c in linear]
    return F.when(code < 0, F.array(*[F.lit(GREY)] * 3)).otherwise(F.array(*rgb))


def palette(index: Column, colours: Sequence[Sequence[int]] | None) -> Column:
    """The colour of an index: OKLab without a list, else the list over and over."""
    if not colours:
        return oklab(index)
    return F.get(F.array(*[F.array(*map(F.lit, c)) for c in colours]), F.pmod(index, F.lit(len(colours))).cast("int"))


def palette_by_value(value: Column, given: dict[str, Sequence[int]], fallback: Sequence[int] = MISSING_FILL) -> Column:
    """The colour that a value is given by name, else the fallback."""
    rest = F.array(*map(F.lit, fallback))
    if not given:
        return rest
    table = F.create_map(*[x for k, c in given.items() for x in (F.lit(k), F.array(*map(F.lit, c)))])
    return F.coalesce(table[value], rest)


def categories(df: DataFrame, value: str) -> DataFrame:
    """value, index: distinct values, numbers by size before text by code point."""
    n = number(F.col(value), True)
    return df.select(value).distinct().withColumn("index", F.row_number().over(W.orderBy(n.isNull(), n, F.col(value))) - 1)


def extent(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.alias("v")).where(finite(F.col("v"))).agg(F.min("v").alias("lo"), F.max("v").alias("hi"))


def assign(df: DataFrame, value: str, *, kind: str | None = None, explicit: str | None = None, log: bool = False, stops=RAMP, colours=None, fill=MISSING_FILL) -> DataFrame:
    """The rows with ``colour``: missing values get the fill, others the ramp or the palette."""
    of_text = dict(df.dtypes)[value] == "string"
    text = cell(F.col(value), of_text)
    rows = df.withColumn("_text", text).withColumn("_miss", missing(text))
    numbers = False
    if kind is None and explicit is None:
        numbers = bool(rows.where("not _miss").agg(F.coalesce(F.min(number(F.col("_text"), True).isNotNull()), F.lit(False)).alias("all")).first()["all"])
    absent = F.array(*map(F.lit, fill))
    if mode(kind, explicit, numbers) == "continuous":
        v = F.when(~F.col("_miss"), number(F.col("_text"), True))
        ends = extent(rows, v)
        out = rows.crossJoin(F.broadcast(ends)).withColumn("_v", v)  # one row
        colour = F.concat(ramp(position(F.col("_v"), F.col("lo"), F.col("hi"), log), stops), F.array(F.lit(255)))
        return out.withColumn("colour", F.when(F.col("_v").isNull(), absent).otherwise(colour)).drop("_text", "_miss", "_v", "lo", "hi")
    found = categories(rows.where("not _miss").select(F.col("_text").alias("_category")), "_category")
    out = rows.join(found, (F.col("_text") == F.col("_category")) & ~F.col("_miss"), "left")
    colour = F.concat(palette(F.col("index"), colours), F.array(F.lit(255)))
    return out.withColumn("colour", F.when(F.col("index").isNull(), absent).otherwise(colour)).drop("_text", "_miss", "_category", "index")


def label_id(text: Column) -> Column:
    """Digits alone, as an integer that a double can hold."""
    return F.when(text.rlike(r"^\d+$"), F.when(text.try_cast("decimal(38,0)") <= F.lit(2**53 - 1), text.try_cast("bigint")))


def label_table(spark, state: DataFrame, fill=(255, 255, 255, 255), fade: float = 0.25, top: int | None = None) -> DataFrame:
    """id, colour for 0..top: a state's colour, faded before hidden (alpha 0).

    ``state``: id bigint, colour array<int>, hidden, faded booleans; ids that aren't integers are null.
    """
    if top is None:
        top = state.agg(F.max("id")).first()[0]
    ids = spark.range(0, (top if top is not None else -1) + 1)
    rows = ids.join(state.where("id is not null"), "id", "left")
    base = F.coalesce("colour", F.array(*map(F.lit, fill)))
    alpha = F.get(base, 3)
    alpha = F.when(F.coalesce("hidden", F.lit(False)), 0).when(F.coalesce("faded", F.lit(False)), half_up(alpha * fade).cast("int")).otherwise(alpha)
    return rows.select("id", F.concat(F.slice(base, 1, 3), F.array(alpha.cast("int"))).alias("colour"))


def label_visible(alphas: Column, index: Column) -> Column:
    """Alpha over 0; ids outside the table and no table at all are visible."""
    return F.coalesce(F.get(alphas, index) > 0, F.lit(True))


def stroke(fill: Column, lift: float = 0.45, more: int = 55) -> Column:
    """A lighter line: channels lifted towards white, alpha raised up to 255."""
    up = lambda k: half_up(F.get(fill, k) + (255 - F.get(fill, k)) * lift).cast("int")
    return F.array(up(0), up(1), up(2), F.least(F.get(fill, 3) + more, F.lit(255)))


def fade(alpha: Column, factor: float) -> Column:
    return clamp(half_up(alpha * factor), 0, 255).cast("int")


def hex_colour(text: Column) -> Column:
    """#rrggbb, the # optional; else null."""
    digits = F.regexp_extract(text, r"^#?([0-9a-fA-F]{6})$", 1)
    part = lambda k: F.conv(F.substring(digits, k, 2), 16, 10).cast("int")
    return F.when(digits != "", F.array(part(1), part(3), part(5)))


def colour_at(buffer: Column, index: Column, size: int | None = None) -> Column:
    """The channel at a place of a colour buffer; null beyond its end, or beyond ``size`` bytes of it."""
    value = F.get(buffer, index)
    return value if size is None else F.when((index >= 0) & (index < size), value)


def palette_table(spark, top: int, overrides: DataFrame | None = None, least: int = 4096) -> DataFrame:
    """code, colour for 0 to the greatest of ``top`` and ``least`` - 1: an override's colour, else OKLab's."""
    ids = spark.range(0, max(top + 1, least)).select(F.col("id").alias("code"))
    own = oklab(F.col("code"))
    if overrides is None:
        return ids.select("code", own.alias("colour"))
    given = overrides.select("code", F.col("colour").alias("_own"))
    return ids.join(F.broadcast(given) if given.count() <= 100_000 else given, "code", "left").select("code", F.coalesce("_own", own).alias("colour"))


def picked_label(value: Column, alphas: Column | None = None) -> Column:
    """The label of a picked pixel: a finite value over 0 that its table doesn't hide; else null."""
    seen = finite(value) & (value > 0)
    whole = value.cast("bigint")
    return F.when(seen if alphas is None else seen & label_visible(alphas, whole.cast("int")), whole)


def highlight_id(value: Column, alphas: Column | None = None) -> Column:
    """The rounded id to light up: finite, over 0 and visible; else null."""
    whole = half_up(F.when(finite(value) & (value > 0), value)).cast("bigint")
    return whole if alphas is None else F.when(label_visible(alphas, whole.cast("int")), whole)


def signature(*parts: Column) -> Column:
    """What a colouring is kept by: its parts, arrays joined, in order."""
    return F.concat_ws(":", *parts)


class SharedColours:
    """Colourings by signature: equal settings give the same object, so what depends on it isn't made again."""

    def __init__(self, make):
        self.make, self.held = make, {}

    def get(self, *settings):
        key = repr(settings)
        if key not in self.held:
            self.held[key] = self.make(*settings)
        return self.held[key]

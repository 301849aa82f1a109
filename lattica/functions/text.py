"""Paths, ids, labels and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = r"^[A-Za-z0-9_.-]+$"


def dirname(p: Column) -> Column:
    return F.regexp_extract(p, r"^(.*)/[^/]*$", 1)


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def depth(p: Column) -> Column:
    return F.size(F.split(p, "/"))


def element_key(p: Column, kind: str) -> Column:
    """The element of a path; its collection may be written in the singular."""
    return F.regexp_extract(p, rf"(?:^|/){kind}s?/([^/]+)", 1)


def layer_id(kind: Column, key: Column) -> Column:
    return F.concat_ws(":", kind, key)


def layer_parts(layer: Column) -> tuple[Column, Column]:
    return F.substring_index(layer, ":", 1), F.regexp_extract(layer, r"^[^:]*:(.*)$", 1)


def label(kind: Column, key: Column) -> Column:
    return F.concat(F.initcap(kind), F.lit(": "), key)


def cap_message(shown: Column, total: Column) -> Column:
    return F.when(shown < total, F.concat(F.lit("Showing "), F.format_number(shown, 0), F.lit(" of "), F.format_number(total, 0), F.lit(" points")))


def percent(part: Column, total: Column) -> Column:
    """Whole percents; what isn't nothing or all is never 0 or 100."""
    p = part * 100.0 / F.nullif(total, F.lit(0))
    return F.when((part > 0) & (p < 1), "<1%").when((part < total) & (p > 99), ">99%").otherwise(F.concat(F.floor(F.coalesce(p, F.lit(0.0)) + 0.5).cast("string"), F.lit("%")))


def shorten(number: Column, length: int) -> Column:
    """A decimal cut to a length, without a point at its end."""
    return F.rtrim(F.substring(number, 1, length), F.lit("."))


def query_value(url: Column, key: str) -> Column:
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(key))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def json_value(document: Column, key: str) -> Column:
    """A key's own value in a JSON object; names of the language's prototype aren't keys."""
    if key in ("__proto__", "constructor", "prototype"):
        return F.lit(None).cast("string")
    return F.get_json_object(document, f"$.{key}")


def points_key(key: Column) -> Column:
    """Whether a name, trimmed, can be the key of a point element: one part of a path, none of '.' and '..'."""
    name = F.trim(key)
    return (name != "") & ~F.contains(name, F.lit("/")) & ~name.isin(".", "..")


def merged(base: dict, over: dict) -> dict:
    """Settings with others on top: objects are merged key by key, everything else is replaced."""
    both = lambda k: isinstance(base.get(k), dict) and isinstance(over.get(k), dict)
    return {k: merged(base[k], over[k]) if both(k) else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}


def settings_for(config: dict, key: str) -> dict:
    """The settings of one element: the config's own ``elements`` entry over its defaults."""
    return merged({k: v for k, v in config.items() if k != "elements"}, config.get("elements", {}).get(key, {}))


def description(**inputs: Column) -> Column:
    """A hash of all inputs by name, to keep what was resolved from them."""
    return F.xxhash64(F.to_json(F.struct(*[v.alias(k) for k, v in sorted(inputs.items())])))

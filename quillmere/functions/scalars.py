"""Small column helpers: keys, tags, JSON, maps, time."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

CACHE_PREFIX = "rag_query:"  # fixed value


def cache_key(query: Column, *parts: Column) -> Column:
    """Digest key of a question; extra parts (result count, threshold,
    filters) keep answers to different requests apart."""
    text = F.concat_ws("\u0001", query, *[p.cast("string") for p in parts]) if parts else query
    return F.concat(F.lit(CACHE_PREFIX), F.md5(text.cast("binary")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the
    body uses it inside another lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_map(values: dict[str, str]) -> Column:
    """A constant map, as one parsed expression instead of many columns."""
    return F.expr(f"map({', '.join(_quoted(x) for pair in values.items() for x in pair)})")


def literal_array(values: Iterable[str]) -> Column:
    return F.expr(f"array({', '.join(map(_quoted, values))})")


def split_tags(tags: Column) -> Column:
    return F.when(F.length(tags) > 0, F.split(tags, ",")).otherwise(F.array().cast("array<string>"))


def join_tags(tags: Column) -> Column:
    return F.array_join(tags, ",")


def merge_maps(base: Column, override: Column) -> Column:
    """Map union in which ``override`` wins, whatever the session's
    duplicate-key policy is."""
    empty = F.create_map().cast("map<string,string>")
    base = F.coalesce(base, empty)

    def merge(new: Column) -> Column:
        return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(new, k)), new)

    return let(F.coalesce(override, empty), merge)


def megabytes(size: Column) -> Column:
    return F.bround(size / F.lit(1024 * 1024), 2)


def before(moment: Column, **interval: int) -> Column:
    """``moment`` minus an interval, e.g. ``before(t, hours=24)``."""
    parts = {name: F.lit(value) for name, value in interval.items()}
    return moment - F.make_dt_interval(**parts)


def hour_of(moment: Column) -> Column:
    return F.date_trunc("hour", moment).cast("timestamp_ntz")

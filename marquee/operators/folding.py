"""Flat rows of query answers folded to one record for each item.

All lists of a record are sets of one aggregate: rows are read and dealt once,
nothing multiplies, and an item that very many rows repeat is reduced before
the shuffle, to its distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def listed(*parts: str) -> Column:
    """The distinct values, or structs of several columns, in order; rows where
    one is null bring nothing."""
    value = F.col(parts[0]) if len(parts) == 1 else F.struct(*parts)
    there = F.expr(" and ".join(f"`{p}` is not null" for p in parts))
    return F.array_sort(F.collect_set(F.when(there, value)))


def folded_records(rows: DataFrame, item: str, order: list[str], last: list[str], lists: dict[str, tuple[str, ...]], release: str | None = None, places: str | None = None) -> DataFrame:
    """One record for each item: the ``last`` columns of its last row, the
    ``lists``, null where they are empty, and with ``release`` its earliest date
    and, with ``places``, the places of each date."""
    sets = {name: listed(*parts) for name, parts in lists.items()}
    if release and places:
        sets["__dated"] = F.array_sort(F.collect_set(F.when(F.col(release).isNotNull(), F.struct(release, places))))
    out = rows.groupBy(item).agg(F.max_by(F.struct(*last), F.struct(*order)).alias("__last"), *([F.min(release).alias("first_release")] if release else []), *[c.alias(n) for n, c in sets.items()])
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    out = out.select(item, *[F.col(f"__last.{c}").alias(c) for c in last], *(["first_release"] if release else []), *[some(n) for n in sets])
    if release and places:
        out = out.withColumn("releases", by_date(F.col("__dated"), release, places)).drop("__dated")
    return out


def by_date(pairs: Column, release: str, place: str) -> Column:
    """Pairs in order -> (release, places): a place for each pair of the date,
    in order, without nulls. One pass: a pair is added to the last date or begins
    another one."""
    kind = f"array<struct<{release}:string,places:array<string>>>"
    one = lambda x: F.filter(F.array(x[place].cast("string")), lambda v: v.isNotNull())
    fresh = lambda x: F.struct(x[release].cast("string").alias(release), one(x).alias("places"))

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        more = F.struct(last[release].alias(release), F.concat(last["places"], one(x)).alias("places"))
        same = (F.size(done) > 0) & F.coalesce(F.try_element_at(done, F.lit(-1))[release] == x[release].cast("string"), F.lit(False))
        return F.when(same, F.array_append(F.slice(done, 1, F.size(done) - 1), more)).otherwise(F.array_append(done, fresh(x)))

    return F.when(pairs.isNotNull(), F.aggregate(pairs, F.array().cast(kind), add))


def release_places(rows: DataFrame, key: list[str], place: str) -> DataFrame:
    """The places of each item and date, in order; a date without any keeps an
    empty list."""
    return rows.groupBy(*key).agg(F.array_sort(F.collect_set(place)).alias("places"))


def multimap(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, targets): the distinct values of each key, in order."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias("targets"))


def facts(rows: DataFrame, item: str, sets: dict[str, Column]) -> DataFrame:
    """Several sets of each item in one pass; a null adds nothing to a set."""
    return rows.groupBy(item).agg(*[F.array_sort(F.collect_set(c)).alias(n) for n, c in sets.items()])


def best_kind(rows: DataFrame, item: str, kind: str, priority: tuple[str, ...]) -> DataFrame:
    """The kind of each item that stands first in ``priority``; of others the
    first by name."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(kind)), F.lit(0)), F.lit(len(priority) + 1))
    return rows.groupBy(item).agg(F.min_by(kind, F.struct(rank.alias("a"), F.col(kind).alias("b"))).alias(kind))


def most_and_any(rows: DataFrame, item: str, most: str, any_: str) -> DataFrame:
    """The largest of one column and, of the other, the smallest value, which is
    the same in every run."""
    return rows.groupBy(item).agg(F.max(most).alias(most), F.min(any_).alias(any_))


def merged_rows(header: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each detail row with its header; of columns that both have, the row's
    value counts, unless the row has none at all for it."""
    both = [c for c in header.columns if c in rows.columns and c != key]
    h = header.select(*[F.col(c).alias(f"__{c}") if c in both else F.col(c) for c in header.columns])
    joined = h.join(rows, key)
    return joined.select(key, *[c for c in header.columns if c not in (*both, key)], *[F.coalesce(c, f"__{c}").alias(c) for c in both], *[c for c in rows.columns if c not in (*both, key)])


def kept_first(values: Column) -> Column:
    """A list without later copies, in its order."""
    return F.array_distinct(values)


def ordered_list(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): the values of each key by ``order``, each where it comes
    first. A value is reduced to its first place before the lists are made."""
    first = rows.groupBy(key, value).agg(F.min(order).alias("__at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda x: x[value]).alias("values"))


def numbered_pages(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """The page, from 0, that each row stands on; pages are numbered within each
    ``by``, whose groups are numbered apart."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("page", F.floor((turn - 1) / size))


def keyset_page(rows: DataFrame, key: str, after: str | int | None, size: int) -> DataFrame:
    """The next ``size`` rows behind the key ``after``; a filter that reaches
    the scan and a top-k, whatever came before."""
    rest = rows if after is None else rows.where(F.col(key) > after)
    return rest.orderBy(key).limit(size)


def offset_page(rows: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """A page by offset, of rows that are ordered first, so that pages neither
    overlap nor leave rows out."""
    return rows.orderBy(*order).offset(offset).limit(size)


def with_optional(rows: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """Rows with what there is for them in ``more``, and nulls otherwise."""
    return rows.join(more, key, "left")


def with_values(rows: DataFrame, values: DataFrame, *key: str) -> DataFrame:
    """The rows whose key is among the given values, single ones or tuples; the
    list may be of any length and hold a value twice."""
    return rows.join(values.select(*key).distinct(), list(key), "left_semi")

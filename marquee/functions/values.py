"""Dates, numbers, arrays and JSON as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_date(c: Column) -> Column:
    """The date in the first ten characters, if they are one in full."""
    head = F.substring(c, 1, 10)
    return F.when(head.rlike(r"^\d{4}-\d{2}-\d{2}$"), head.try_cast("date"))


def signed_year(c: Column) -> Column:
    """The year of a signed time stamp such as +1999-03-31T00:00:00Z."""
    return F.nullif(F.regexp_extract(c, r"^[+-](\d{4})-", 1), F.lit("")).cast("int")


def truncated(c: Column) -> Column:
    """int(float(x)), null for what is no number."""
    return c.try_cast("double").try_cast("int")


def era_points(first: Column, second: Column) -> Column:
    """20 points for the same year, 2 less for each year between, null beyond
    ten years."""
    gap = F.abs(F.year(first) - F.year(second))
    return F.when(gap <= 10, (20 - 2 * gap).cast("double"))


def filled(c: Column, kind: T.DataType) -> Column:
    """The value, or null where it counts as none: zero, empty or null."""
    if isinstance(kind, T.NumericType):
        return F.when(c != 0, c)
    if isinstance(kind, T.StringType):
        return F.nullif(c, F.lit(""))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.when(F.size(c) > 0, c)
    return F.when(c, c) if isinstance(kind, T.BooleanType) else c


def map_labels(c: Column) -> Column:
    """Values of a JSON object, sorted; nothing for bad JSON."""
    return F.coalesce(F.array_sort(F.map_values(F.from_json(c, "map<string,string>"))), F.array().cast("array<string>"))


def canonical_json(*fields: str) -> Column:
    """Compact JSON with sorted keys that keeps nulls."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def snak_id(c: Column) -> Column:
    return F.get_json_object(c, "$.datavalue.value.id")


def snak_year(c: Column) -> Column:
    return signed_year(F.get_json_object(c, "$.datavalue.value.time"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def inverted(words: Column) -> Column:
    """The inverted index word -> positions of an array of words: these are
    sorted, and each run of one word is an entry."""
    placed = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("at"))))
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["w"] != F.get(s, i - 1)["w"]), i)), lambda i: i.isNotNull())
    run = lambda s, b, e: F.struct(F.get(s, b)["w"].alias("key"), F.transform(F.slice(s, b + 1, e - b), lambda x: x["at"]).alias("value"))
    runs = lambda s, b: F.transform(b, lambda at, k: run(s, at, F.coalesce(F.get(b, k + 1), F.size(s))))
    return F.map_from_entries(F.get(F.transform(F.array(placed), lambda s: F.get(F.transform(F.array(begins(s)), lambda b: runs(s, b)), 0)), 0))


def rebuilt_text(index: Column) -> Column:
    """Text of an inverted index word -> positions; where words collide the
    last one of the map stays."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e, i: F.transform(e["value"], lambda p: F.struct(p.alias("p"), (-i).alias("i"), e["key"].alias("w")))))
    first = lambda s: F.filter(s, lambda x, i: x["p"].isNotNull() & ((i == 0) | ~x["p"].eqNullSafe(F.get(s, i - 1)["p"])))
    kept = F.get(F.transform(F.array(F.sort_array(pairs)), lambda s: F.transform(first(s), lambda x: x["w"])), 0)
    return F.coalesce(F.array_join(kept, " "), F.lit(""))


def rounded(x: Column) -> Column:
    """A double of less than 2**40 with two decimals, by its binary value and
    half to even, as Python rounds: 2.675 is a little less than that and gives
    2.67. In whole numbers: the fraction is the sum of a / 2**30 and b / 2**70,
    which holds it in full (what lies below 2**-70 is far from any half)."""
    size = F.abs(x)
    whole = F.floor(size)
    scaled = (size - whole) * float(1 << 30)
    a = F.floor(scaled)
    b = F.floor((scaled - a) * float(1 << 40))
    cents = (a.cast("decimal(20,0)") * F.lit(1 << 40).cast("decimal(13,0)")).cast("decimal(32,0)") + b.cast("decimal(13,0)")
    unit = F.lit(str(1 << 70)).cast("decimal(22,0)")
    hundred = (cents * F.lit(100).cast("decimal(3,0)")).cast("decimal(36,0)")
    rest = hundred % unit
    down = F.floor((hundred - rest) / unit).cast("long")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (down % 2 == 1))
    return F.signum(x) * (whole * 100 + down + up.cast("long")).cast("double") / 100

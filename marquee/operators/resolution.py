"""Entity resolution: names that nearly agree, and the clusters that they form."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.checkpoints import cut
from marquee.operators.graph import components

GRAM = 3


def normal(name: Column) -> Column:
    """Lower case, white space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(name), "[ \\t\\n]+", " "))


def grams(name: Column, q: int = GRAM) -> Column:
    """The distinct pieces of q characters; a shorter name is its own piece."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(name) - (q - 1), F.lit(1))), lambda i: F.substr(name, i, F.lit(q))))


#: Pieces that two names must share at once, by how many of one name's the other
#: may lack; from five on three.
TOGETHER = {0: 8, 1: 6, 2: 5, 3: 4, 4: 3}


def choices(q: int, edits: int) -> Column:
    """Of ``lacks`` the places, from 0, of each choice of ``together`` among the
    first ``together + lacks`` pieces."""
    sets = [(lacks, k) for lacks in range(q * edits + 1) for k in range(1, TOGETHER.get(lacks, 3) + 1)]
    table = [x for lacks, k in sets for x in (F.lit(f"{lacks}/{k}"), F.lit([list(c) for c in combinations(range(k + lacks), k)]))]
    return F.create_map(*table)[F.concat_ws("/", "lacks", "together")]


def near_names(names: DataFrame, per_mille: int = 800, edits: int = 2, q: int = GRAM) -> DataFrame:
    """Pairs of different names with a similarity of their pieces (Jaccard) of
    ``per_mille`` / 1000 or more and no more than ``edits`` edits between them:
    ``names (name)`` -> (a, b, shared, total, edits) with a < b.

    A set-similarity join by prefixes: pieces are ordered by how rare they are.
    For each pair of sizes that the threshold allows it is known how many pieces
    of one name the other may lack; an edit touches ``q`` pieces at most, so
    however many the threshold lets long names lack, never more than
    ``q * edits``. Of any ``together`` + lacks pieces of one name some
    ``together`` are then in the other, and they are among its first ones as
    well: each choice of so many is a key, with both sizes. Names of a numbered
    family have many pieces in common, but few names have several rare ones in
    common, so keys stay small. What meets at a key is compared exactly."""
    sized = names.select("name").where("name is not null").distinct().withColumn("pieces", grams(F.col("name"), q)).withColumn("size", F.size("pieces").cast("long"))
    sized = cut(sized, "names")
    each = sized.select("name", F.explode("pieces").alias("piece"))
    often = each.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
    rare = F.transform(F.sort_array(F.collect_list(F.struct("often", "piece"))), lambda x: x["piece"])
    ordered = each.join(often, "piece").groupBy("name").agg(rare.alias("rare")).withColumn("size", F.size("rare").cast("long"))
    met = F.expr(f"explode(sequence((size * {per_mille} + 999) div 1000, size * 1000 div {per_mille}))").alias("other")
    # shared >= per_mille / (1000 + per_mille) * (both sizes), and neither lacks more than the edits touch
    shared = F.expr(f"greatest(((size + other) * {per_mille} + {999 + per_mille}) div {1000 + per_mille}, size - {q * edits}, other - {q * edits})")
    sizes = sized.select("size").distinct()
    rules = sizes.select("size", met).join(sizes.select(F.col("size").alias("other")), "other").select("size", "other", shared.alias("shared"))
    rules = rules.where(F.col("shared") <= F.least("size", "other"))
    together = F.create_map(*[F.lit(x) for n in range(q * edits + 1) for x in (n, TOGETHER.get(n, 3))])[(F.greatest("size", "other") - F.col("shared")).cast("int")]
    rules = rules.withColumn("lacks", F.col("size") - F.col("shared")).withColumn("together", F.least(together, "shared")).select("size", "other", "lacks", "together")
    keys = F.transform(choices(q, edits), lambda c: F.xxhash64(F.least("size", "other"), F.greatest("size", "other"), F.array_sort(F.transform(c, lambda i: F.get("rare", i)))))
    posted = cut(ordered.join(F.broadcast(rules), "size").select("name", "size", "other", F.explode(keys).alias("key")), "posted")
    small, large = posted.where("size <= other"), posted.where("size >= other")
    meets = small.select("key", F.col("name").alias("x"), F.col("size").alias("s"), F.col("other").alias("o")).join(large.select("key", F.col("name").alias("y"), F.col("size").alias("o"), F.col("other").alias("s")), ["key", "s", "o"])
    near = meets.where("x <> y and (s < o or x < y)").where(F.abs(F.length("x") - F.length("y")) <= edits).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    # the exact comparison takes the pieces apart again rather than joining them
    out = near.distinct().withColumn("edits", F.levenshtein("a", "b", edits).cast("long")).where("edits >= 0")
    of_a, of_b = grams(F.col("a"), q), grams(F.col("b"), q)
    out = out.select("a", "b", "edits", F.size(F.array_intersect(of_a, of_b)).cast("long").alias("shared"), (F.size(of_a) + F.size(of_b)).cast("long").alias("sizes"))
    out = out.select("a", "b", "shared", (F.col("sizes") - F.col("shared")).alias("total"), "edits")
    return out.where(F.col("shared") * 1000 >= F.col("total") * per_mille)


def resolved(entities: DataFrame, per_mille: int = 800, edits: int = 2) -> DataFrame:
    """``entities (id, name)`` -> (id, name, cluster, members): entities whose
    normal names agree or are near, directly or through others, are one cluster,
    named by its smallest id. Null names stand alone."""
    rows = entities.select("id", F.col("name").alias("said"), normal(F.col("name")).alias("name"))
    pairs = near_names(rows, per_mille, edits)
    roots = components(pairs.select("a", "b")).select(F.col("id").alias("name"), "root")
    rows = rows.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
    size = rows.where("root is not null").groupBy("root").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("members"))
    return rows.join(size, "root", "left").select("id", F.col("said").alias("name"), F.coalesce("cluster", "id").alias("cluster"), F.coalesce("members", F.lit(1)).alias("members"))

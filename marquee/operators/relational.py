"""Patterns that the pipelines share: first wins, latest, strata, cardinality
splits, pending work, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.values import rounded


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("__turn", turn).where("__turn = 1").drop("__turn")


def latest(df: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    return first_wins(df, key, [F.desc_nulls_last(at), F.desc(tie)])


def numbered(df: DataFrame, key: list[str], order: list, name: str = "ordinal", start: int = 0) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1 + start)


def stratified(df: DataFrame, stratum: str, strata: list[int], limit: int, order: list, key: str) -> DataFrame:
    """The best of each stratum by unequal quotas: limit / strata each, one more
    for the first limit % strata of them. A key that several strata chose stays
    in the first; its place is not filled again."""
    base, more = divmod(limit, len(strata))
    quota = F.when(F.col(stratum).isin(*sorted(strata)[:more]), base + 1).otherwise(base) if more else F.lit(base)
    top = df.where(F.col(stratum).isin(*strata)).withColumn("__turn", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("__turn") <= base + 1).where(F.col("__turn") <= quota).drop("__turn")
    return first_wins(top, [key], [stratum])


def pending(entities: DataFrame, outcomes: DataFrame, key: str, final: tuple[str, ...], version: str) -> DataFrame:
    """Entities without a final outcome of this version; failed ones return."""
    done = outcomes.where(F.col("status").isin(*final) & (F.col("version") == version)).select(key)
    return entities.join(done, key, "left_anti")


def reconciled(records: DataFrame, mapping: DataFrame, external: str, target: str) -> DataFrame:
    """Match status by the number of targets that an external id has: none,
    one, several, or no external id at all."""
    n = mapping.where(F.col(target).isNotNull()).groupBy(external).agg(F.count_distinct(target).alias("n"), F.min(target).alias("only"))
    rows = records.join(n, external, "left")
    status = (
        F.when(F.col(external).isNull(), "unmatched_no_external_id")
        .when(F.col("n").isNull(), "unmatched_no_target")
        .when(F.col("n") == 1, "matched")
        .otherwise("review_required")
    )
    return rows.withColumn("match_status", status).withColumn("matched", F.when(F.col("n") == 1, F.col("only"))).drop("n", "only")


def overlaid(rows: DataFrame, patches: DataFrame, key: str, *fields: str) -> DataFrame:
    """Patched values where a patch has them; the originals stay as seed_*."""
    p = patches.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    out = rows.join(p, key, "left")
    for f in fields:
        out = out.withColumn(f"seed_{f}", F.col(f)).withColumn(f, F.coalesce(f"__{f}", f)).drop(f"__{f}")
    return out


def unpivoted(df: DataFrame, key: list[str], tags: dict[str, str], name: str, value: str) -> DataFrame:
    """One row for each set column, tagged."""
    pairs = F.array(*[F.struct(F.lit(tag).alias(name), F.col(c).cast("string").alias(value)) for c, tag in tags.items()])
    return df.select(*key, F.explode(pairs).alias("__p")).select(*key, F.col(f"__p.{name}"), F.col(f"__p.{value}")).where(F.col(value).isNotNull())


def histogram(df: DataFrame, by: list[str], column: str, keys: tuple[str, ...]) -> DataFrame:
    """Counts of fixed keys as columns, with zeros."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == k).alias(k) for k in keys])


def coverage(checked: DataFrame, ok: Column, key: str) -> DataFrame:
    """Number, verified, percent and duplicates of a key."""
    n = F.count(F.lit(1))
    return checked.agg(n.alias("entries"), F.count_if(ok).alias("verified"), F.when(n > 0, rounded(100 * F.count_if(ok) / n)).otherwise(0.0).alias("coverage_percent"), (F.count(key) - F.count_distinct(key)).alias("duplicates"))


def resolved_candidates(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """The best candidate of each entry: films of the entry's year, by title
    score, then route, place and item; a later route counts only for entries that the
    first one left open. Entries without any stay unresolved with a reason."""
    c = entries.join(candidates, "position").where(F.col("is_film") & F.array_contains("years", F.col("release_year")))
    c = c.withColumn("late", F.col("route") > 0)
    best = first_wins(c, ["position"], ["late", F.desc("title_score"), "route", "place", "qid"])
    out = entries.join(best.select("position", "qid", "enwiki"), "position", "left")
    # fixed texts of the catalogue
    reason = F.when(F.col("qid").isNull(), "no film QID with matching release year after Wikidata and Wikipedia fallback").when(F.col("enwiki").isNull(), "film QID has no English Wikipedia sitelink")
    return out.withColumn("reason", reason)


#: A short phrase is looked up by its first so many characters.
PIECE = 3


def phrase_matches(phrases: DataFrame, texts: DataFrame, item: str, phrase: str, key: str, text: str, words: int) -> DataFrame:
    """(item, key) of each phrase and each text that contains it, both
    normalised to words joined by blanks. Items and keys are unique.

    Containment is no equi-join. A phrase may begin and end within a word, but
    its inner words are whole words of the text: up to ``words`` of them are
    looked up, as a hash, among the hashed runs of each text, which is split once
    and gives its runs of all lengths in one pass. A phrase of one or two words
    has no inner word: its first characters are looked up among the pieces of as
    many characters of the distinct runs of one and two words that all texts
    have together. Only hashes and keys are exploded and joined; texts are read
    again once to verify."""
    size = F.size(F.split(phrase, " "))
    told = phrases.where(F.col(phrase) != "").select(item, F.col(phrase).alias("__p"), size.alias("__size"))
    long = told.where("__size > 2").select(item, F.xxhash64(F.expr(f"slice(split(__p, ' '), 2, least(__size - 2, {words}))")).alias("__run"))

    def runs(w: Column, n: int) -> Column:
        count = F.size(w) - (n - 1)
        return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<bigint>"))

    # one row: which kinds and lengths of phrases there are, so that texts are not taken apart for none
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    kinds = phrases.agg(F.sort_array(F.collect_set(F.when(size > 2, F.least(size - 2, F.lit(words))))).alias("long"), has((size <= 2) & (F.col(phrase) != "")).alias("short"), has(F.col(phrase) == "").alias("empty")).first()
    hits = []
    if kinds["long"]:
        # the words are a variable of their own, so that a text is split once
        every = F.transform(F.array(F.split(text, " ")), lambda w: F.array_distinct(F.concat(*[runs(w, n) for n in kinds["long"]])))[0]
        hits.append(texts.select(key, F.explode(every).alias("__run")).join(long, "__run").select(item, key))
    if kinds["short"]:
        short = told.where("__size <= 2").withColumn("__n", F.least(F.length("__p"), F.lit(PIECE))).withColumn("__piece", F.expr("substring(__p, 1, __n)"))
        grams = F.transform(F.array(F.split(text, " ")), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, 2), " "))))[0]
        of_text = texts.select(key, F.explode(grams).alias("__run"))
        pieces = F.expr(f"flatten(transform(sequence(1, {PIECE}), n -> if(length(__run) >= n, array_distinct(transform(sequence(1, length(__run) - n + 1), i -> substring(__run, i, n))), array())))")
        known = of_text.select("__run").distinct().select("__run", F.explode(pieces).alias("__piece"))
        known = known.join(short.select(item, "__p", "__piece"), "__piece").where(F.contains("__run", "__p")).select("__run", item).distinct()
        hits.append(of_text.join(known, "__run").select(item, key))
    found = []
    if hits:
        pairs = hits[0].union(hits[1]) if len(hits) > 1 else hits[0]
        pairs = pairs.distinct().join(told.select(item, "__p"), item)
        found.append(pairs.join(texts.select(key, F.col(text).alias("__t")), key).where(F.contains("__t", "__p")).select(item, key))
    if kinds["empty"] or not hits:  # an empty phrase is in every text
        found.append(phrases.where(F.col(phrase) == "").select(item).crossJoin(texts.where(F.col(text).isNotNull()).select(key)))
    return found[0].union(found[1]) if len(found) > 1 else found[0]


def union_in_order(routes: list[DataFrame], key: list[str], value: str) -> DataFrame:
    """Routes one after another; each value once, where it comes first."""
    rows = None
    for n, r in enumerate(routes):
        r = r.withColumn("route", F.lit(n))
        rows = r if rows is None else rows.unionByName(r)
    return first_wins(rows, [*key, value], ["route", "place"])


def set_sizes(a: str, b: str) -> tuple[Column, Column]:
    """How many values two arrays have in common, and together."""
    return F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))


def difference(rows: DataFrame, without: DataFrame) -> DataFrame:
    """The distinct rows that the others lack."""
    return rows.distinct().join(without, rows.columns, "left_anti")

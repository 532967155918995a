"""Passages to bounded chunks of whole sentences, with overlap, exact
deduplication and a readiness report."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marquee.functions.text import nfc_collapsed, word_count
from marquee.functions.values import rounded

#: A break is white space behind a full stop, question or exclamation mark.
BREAK = "(?<=[.?!]) "
TOKEN = r"(?U)\w+(?:['-]\w+)*|[^\w\s]"


@dataclass(frozen=True)
class Policy:
    """Chunk sizes in tokens."""

    target: int = 300
    maximum: int = 360
    overlap: int = 50
    minimum_words: int = 40

    def __post_init__(self) -> None:
        if not 0 < self.minimum_words <= self.target <= self.maximum or not 0 <= self.overlap < self.target:
            raise ValueError("chunk sizes must satisfy 0 < minimum_words <= target <= maximum and 0 <= overlap < target")


def spans(tokens: list[int], p: Policy) -> list[tuple[int, int]]:
    """The chunks of sentences with so many tokens each, as (start, end).

    A chunk from s ends where it has reached the target, or before the sentence
    that would take it above the maximum, but has one sentence at least. The
    next one starts with the last sentences of it that reach the overlap, if
    the following sentence fits behind them, and with that sentence otherwise;
    an overlap that is left over so behind a full chunk is a chunk as well."""
    total = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int64)
    out, s, least = [], 0, 1  # a chunk of at least so many sentences of all
    while s < len(tokens):
        reached = int(np.searchsorted(total, total[s] + p.target))
        within = int(np.searchsorted(total, total[s] + p.maximum, "right")) - 1
        e = min(max(least, min(reached, within)), len(tokens))
        out.append((s, e))
        if e == len(tokens):
            break
        back = max(s, int(np.searchsorted(total, total[e] - p.overlap, "right")) - 1) if p.overlap else e
        fits = total[e + 1] - total[back] <= p.maximum
        if not fits and back < e and total[e] - total[s] >= p.target:
            out.append((back, e))
        s, least = (back if fits else e), e + 1
    return out


def sentences(passages: DataFrame, key: list[str], text: str, language: str | None = None) -> DataFrame:
    """The sentences ``s`` of each passage in normal form and their numbers of
    tokens ``n``. There is a rule for English only: with the column
    ``language``, a passage in another one is an error."""
    flat = nfc_collapsed(F.col(text))
    if language:
        known = F.coalesce(F.col(language) == "en", F.lit(False))
        flat = F.when(known, flat).otherwise(F.raise_error(F.concat(F.lit("no sentence rule for the language "), F.coalesce(F.col(language), F.lit("null")))).cast("string"))
    rows = passages.select(*key, F.filter(F.split(flat, BREAK), lambda x: x != "").alias("s"))
    return rows.withColumn("n", F.transform("s", lambda x: F.regexp_count(x, F.lit(TOKEN))))


def chunks(passages: DataFrame, key: list[str], text: str, policy: Policy | None = None, language: str | None = None) -> DataFrame:
    """The chunks of each passage, one row each: sentences, their tokens, the
    contents and hashes are JVM expressions; only where chunks begin and end,
    and the normal form of the text, is Python's."""
    p = policy or Policy()

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def cut(tokens: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[{"start": a, "end": b} for a, b in spans(t.as_py() or [], p)] for t in tokens], kind)

    rows = sentences(passages, key, text, language)
    rows = rows.select(*key, "s", "n", F.posexplode(cut("n")).alias("ordinal", "at"))
    own = lambda c: F.slice(c, F.col("at.start") + 1, F.col("at.end") - F.col("at.start"))
    rows = rows.select(*key, "ordinal", F.array_join(own("s"), " ").alias("content"), own("n").alias("n"))
    words = word_count(F.col("content"))
    flags = F.array_compact(F.array(F.when(words < p.minimum_words, "below_minimum_words"), F.when(F.array_max("n") > p.maximum, "oversized_single_sentence")))
    rows = rows.select(*key, "ordinal", "content", F.sha2("content", 256).alias("content_hash"), words.alias("words"), F.aggregate("n", F.lit(0), lambda a, x: a + x).alias("tokens"), F.size("n").alias("sentences"), flags.alias("flags"))
    return rows.withColumn("status", F.when(F.size("flags") > 0, "excluded").otherwise("eligible"))


def deduplicated(rows: DataFrame, order: list[str]) -> DataFrame:
    """Eligible chunks with the content of an earlier eligible one become
    duplicates, with the flag and, as ``duplicate_of`` (a struct of ``order``),
    the first of these. Only hashes and keys are ranked; the contents join by their
    key, so that a content that very many chunks have is no hot key of theirs."""
    keys = rows.where("status = 'eligible'").select("content_hash", F.struct(*order).alias("key"))
    first = keys.groupBy("content_hash").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = keys.join(first, "content_hash").where(F.col("key") != F.col("first")).select("key.*", F.col("first").alias("duplicate_of"))
    again = F.col("duplicate_of").isNotNull()
    out = rows.join(later, order, "left")
    out = out.withColumn("status", F.when(again, "duplicate").otherwise(F.col("status")))
    return out.withColumn("flags", F.when(again, F.array_append("flags", F.lit("exact_duplicate_content"))).otherwise(F.col("flags")))


def licensed(passages: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    return passages.where(F.col("license").isin(*allowed) & F.col("attribution_url").isNotNull() & (F.col("attribution_url") != ""))


def report(rows: DataFrame, film: str) -> DataFrame:
    """One row: counts by status and flag, chunks a film, tokens a chunk; zeros
    where there is nothing."""
    eligible = F.col("status") == "eligible"
    per = rows.where(eligible).groupBy(film).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.min("n"), F.lit(0)).alias("film_min"), F.coalesce(F.max("n"), F.lit(0)).alias("film_max"), F.count(F.lit(1)).alias("films"))
    tokens = F.when(eligible, F.col("tokens"))
    all_ = rows.agg(
        F.count(F.lit(1)).alias("chunks"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("eligible", "duplicate", "excluded")],
        *[F.count_if(F.array_contains("flags", f)).alias(f) for f in ("below_minimum_words", "oversized_single_sentence")],
        F.coalesce(F.min(tokens), F.lit(0)).alias("tokens_min"),
        F.coalesce(F.max(tokens), F.lit(0)).alias("tokens_max"),
        F.coalesce(rounded(F.avg(tokens)), F.lit(0.0)).alias("tokens_average"),
    )
    return all_.crossJoin(per)  # one row each


def exact_copies(rows: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Each row with the first row of the same text: its rank and whether it is
    a duplicate."""
    w = Window.partitionBy("hash").orderBy(*order)
    return rows.withColumn("hash", F.sha2(F.col(text), 256)).drop(text).withColumn("rank", F.row_number().over(w)).withColumn("status", F.when(F.col("rank") > 1, "duplicate").otherwise("eligible"))

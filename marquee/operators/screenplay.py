"""Scripts as turns: scenes, runs of one speaker and their measures; sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marquee.checkpoints import cut

WORD = "[^\\x20\\x09-\\x0D]+"


def numbered(rows: DataFrame, key: str, order: str, starts: Column, name: str) -> DataFrame:
    """``rows`` with the number of the stretch, from 1 within each key, that each
    row belongs to: how many rows up to it, in order, start one.

    A running count over ranges: rows are dealt by ranges of (key, order) and
    written once, counted within their ranges, and the counts of a key's earlier
    ranges, a row for each key and range, are added; so a key with a third
    of all rows is counted by as many tasks as hold it."""
    ranged = cut(rows.withColumn("__start", starts.cast("int")).repartitionByRange(F.col(key), F.col(order)).withColumn("__part", F.spark_partition_id()), "ranges")
    within = F.sum("__start").over(Window.partitionBy("__part", key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    sums = ranged.groupBy(key, "__part").agg(F.sum("__start").alias("__n"))
    before = sums.select(key, "__part", (F.sum("__n").over(Window.partitionBy(key).orderBy("__part")) - F.col("__n")).alias("__before"))
    return ranged.withColumn("__within", within).join(before, [key, "__part"]).withColumn(name, F.col("__within") + F.col("__before")).drop("__start", "__part", "__within", "__before")


def scenes(turns: DataFrame) -> DataFrame:
    """``turns (script, turn, speaker, text)`` -> one row per turn with ``words``,
    ``scene`` (a new one wherever turn numbers have a gap) and ``run`` (a new one
    wherever the speaker or the scene changes), both from 1 within the script. A
    turn that comes twice counts once, its least (speaker, text); a null speaker
    is ``unknown``. The turn before is met by an equi-join, not by a window."""
    one = turns.where("script is not null and turn is not null").groupBy("script", "turn").agg(F.min(F.struct(F.coalesce("speaker", F.lit("unknown")).alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))).alias("t"))
    one = one.select("script", "turn", "t.speaker", F.size(F.regexp_extract_all("t.text", F.lit(WORD), F.lit(0))).cast("long").alias("words"), F.size(F.filter(F.split("t.text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("lines"))
    one = cut(one, "turns")
    before = one.select("script", (F.col("turn") + 1).alias("turn"), F.col("speaker").alias("before"))
    linked = one.join(before, ["script", "turn"], "left")
    rows = numbered(linked, "script", "turn", F.col("before").isNull(), "scene")
    return numbered(rows, "script", "turn", F.col("before").isNull() | (F.col("before") != F.col("speaker")), "run").drop("before")


def measures(turns: DataFrame, dialogue: tuple[str, ...] = ("user", "assistant")) -> DataFrame:
    """One row per script: ``scenes``, ``longest_scene``, ``turns``, ``runs``,
    ``longest_run`` (turns), ``speakers``, ``words``, ``dialogue_words`` (of the
    speakers of ``dialogue``), ``density_milli`` (those of all words; 0 without
    any), ``transition_milli`` (changes of speaker of all steps within scenes)."""
    rows = cut(scenes(turns), "scenes")
    by_run = rows.groupBy("script", "scene", "run").agg(F.count(F.lit(1)).alias("turns"), F.sum("words").alias("words"), F.sum(F.when(F.col("speaker").isin(*dialogue), F.col("words")).otherwise(0)).alias("spoken"), F.collect_set("speaker").alias("who"))
    by_scene = by_run.groupBy("script", "scene").agg(F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("runs"), F.max("turns").alias("longest"), F.sum("words").alias("words"), F.sum("spoken").alias("spoken"), F.array_distinct(F.flatten(F.collect_set("who"))).alias("who"))
    out = by_scene.groupBy("script").agg(
        F.count(F.lit(1)).alias("scenes"), F.max("turns").alias("longest_scene"), F.sum("turns").alias("turns"), F.sum("runs").alias("runs"), F.max("longest").alias("longest_run"), F.size(F.array_distinct(F.flatten(F.collect_set("who")))).cast("long").alias("speakers"), F.sum("words").alias("words"), F.sum("spoken").alias("dialogue_words")
    )
    return out.withColumn("density_milli", F.expr("case when words > 0 then 1000 * dialogue_words div words else 0L end")).withColumn("transition_milli", F.expr("case when turns > scenes then 1000 * (runs - scenes) div (turns - scenes) else 0L end"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """``events (visitor, ts)`` -> (visitor, start, end, events): sessions that end
    when ``gap`` passes without an event; ``end`` is the last event."""
    window = F.session_window("ts", gap)
    return events.where("visitor is not null and ts is not null").groupBy("visitor", window.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("events")).drop("w")

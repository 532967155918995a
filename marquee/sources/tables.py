"""The driver's tables seen as the catalogue model.

Each function is a projection without actions; whatever a query does not use is
pruned from the scan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Model:
    """Catalogue tables over a folder of the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str) -> DataFrame:
        """A statement over the driver's tables, named in braces."""
        return self.spark.sql(text, **{n: self.raw(n) for n in set(re.findall(r"\{(\w+)\}", text))})

    def films(self) -> DataFrame:
        k = F.col("p_partkey")
        date = F.make_date(1970 + F.col("p_size"), (1 + k % 12).cast("int"), (1 + k % 28).cast("int"))
        return self.raw("part").select(k.alias("id"), F.col("p_name").alias("title"), F.col("p_size").alias("runtime"), F.when(F.col("p_size") % 17 != 0, date).alias("release_date"), F.when(k % 10 != 0, "published").otherwise("review").alias("status"))

    def genres(self) -> DataFrame:
        p = self.raw("part")
        return p.select(F.col("p_partkey").alias("film_id"), F.explode(F.array_distinct(F.array("p_type", "p_brand"))).alias("label"))

    def people(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))

    def credits(self) -> DataFrame:
        role = F.when(F.col("l_returnflag") == "A", "director").when(F.col("l_returnflag") == "N", "writer").otherwise("cast")
        return self.raw("lineitem").select(F.col("l_partkey").alias("film_id"), F.col("l_suppkey").alias("person_id"), role.alias("role")).distinct()

    def aliases(self) -> DataFrame:
        p = self.raw("part")
        return p.select(F.col("p_partkey").alias("film_id"), F.explode(F.array(F.upper("p_name"), F.concat_ws(" ", "p_brand", "p_name"))).alias("value"))

    def entities(self) -> DataFrame:
        o = self.raw("orders").select(F.concat(F.lit("order:"), "o_orderkey").alias("entity_id"), F.concat(F.lit("Work "), "o_orderkey").alias("label"), F.lit("film").alias("kind"))
        c = self.raw("customer").select(F.concat(F.lit("series:"), "c_custkey").alias("entity_id"), F.col("c_name").alias("label"), F.lit("series").alias("kind"))
        return o.union(c)

    def assertions(self) -> DataFrame:
        """Each order is part of its customer's series and follows, or is
        followed by, the customer's next one."""
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
        status = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "O", "resolved").otherwise("review_required")
        o = o.withColumn("next", nxt).withColumn("status", status)
        own, other = F.concat(F.lit("order:"), "o_orderkey"), F.concat(F.lit("order:"), "next")
        even = F.col("o_orderkey") % 2 == 0
        edge = o.where("next is not null").select(F.concat(F.lit("e"), "o_orderkey").alias("assertion_id"), F.when(even, own).otherwise(other).alias("subject"), F.when(even, "followed_by").otherwise("follows").alias("predicate"), F.when(even, other).otherwise(own).alias("object"), "status")
        series = o.select(F.concat(F.lit("s"), "o_orderkey").alias("assertion_id"), own.alias("subject"), F.lit("part_of_series").alias("predicate"), F.concat(F.lit("series:"), "o_custkey").alias("object"), "status")
        return edge.union(series)

    def passages(self) -> DataFrame:
        """Documents as passages: those labelled of quality have the licence."""
        d, q = self.raw("documents"), self.raw("labels").select("doc_id", "quality")
        licence = F.when(F.col("quality") == 1, "CC BY-SA 4.0").otherwise("unknown")
        return d.join(q, "doc_id", "left").select("doc_id", F.col("source").alias("film"), F.col("lang").alias("language"), F.col("text").alias("content"), licence.alias("license"), F.concat(F.lit("https://example.org/"), "doc_id").alias("attribution_url"))


#: The same projections for DuckDB, as common table expressions.
SQL = {
    "films": """films AS (SELECT p_partkey AS id, p_name AS title, p_size AS runtime, CASE WHEN p_size % 17 <> 0 THEN make_date((1970 + p_size)::BIGINT, 1 + p_partkey % 12, 1 + p_partkey % 28) END AS release_date, CASE WHEN p_partkey % 10 <> 0 THEN 'published' ELSE 'review' END AS status FROM part)""",
    "genres": """genres AS (SELECT p_partkey AS film_id, p_type AS label FROM part UNION SELECT p_partkey, p_brand FROM part)""",
    "people": """people AS (SELECT s_suppkey AS person_id, s_name AS name FROM supplier)""",
    "credits": """credits AS (SELECT DISTINCT l_partkey AS film_id, l_suppkey AS person_id, CASE l_returnflag WHEN 'A' THEN 'director' WHEN 'N' THEN 'writer' ELSE 'cast' END AS role FROM lineitem)""",
    "aliases": """aliases AS (SELECT p_partkey AS film_id, upper(p_name) AS value FROM part UNION ALL SELECT p_partkey, p_brand || ' ' || p_name FROM part)""",
    "entities": """entities AS (SELECT 'order:' || o_orderkey AS entity_id, 'Work ' || o_orderkey AS label, 'film' AS kind FROM orders UNION ALL SELECT 'series:' || c_custkey, c_name, 'series' FROM customer)""",
    "assertions": """chain AS (SELECT o_orderkey, o_custkey, CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'resolved' ELSE 'review_required' END AS status, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders),
assertions AS (SELECT 'e' || o_orderkey AS assertion_id, 'order:' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE next END AS subject, CASE WHEN o_orderkey % 2 = 0 THEN 'followed_by' ELSE 'follows' END AS predicate, 'order:' || CASE WHEN o_orderkey % 2 = 0 THEN next ELSE o_orderkey END AS object, status FROM chain WHERE next IS NOT NULL
UNION ALL SELECT 's' || o_orderkey, 'order:' || o_orderkey, 'part_of_series', 'series:' || o_custkey, status FROM chain)""",
    "passages": """passages AS (SELECT d.doc_id, d.source AS film, d.lang AS language, d.text AS content, CASE WHEN l.quality = 1 THEN 'CC BY-SA 4.0' ELSE 'unknown' END AS license, 'https://example.org/' || d.doc_id AS attribution_url FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
}


def with_model(names: str, query: str, more: str = "") -> str:
    """DuckDB SQL over the projections that ``names`` lists."""
    parts = [SQL[n] for n in names.split()] + ([more] if more else [])
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + query

"""Requests put together from table rows, and the requirements that they must be taken apart into."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import decomposition, gates
from tessera.plans.registry import register
from tessera.sources.tables import table


def _listed() -> Column:
    return F.array_join(F.transform("requirements", lambda r: F.concat_ws(":", r["kind"], r["value"])), "|").alias("requirements")


PARTS = """
WITH p AS (SELECT p_partkey, CASE split_part(p_name, ' ', 1) WHEN 'red' THEN '红色' WHEN 'blue' THEN '蓝色' END AS colour,
    CASE WHEN split_part(p_name, ' ', 1) IN ('red', 'blue') THEN split_part(p_name, ' ', 2) ELSE p_name END AS thing, lower(p_type) AS beside, p_size FROM part)
"""


def _part_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture request for every part."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat(F.lit("Show me "), F.col("p_name"), F.lit(" next to  "), F.col("p_type"), F.lit("!")).alias("query"))


@register(PARTS + """
SELECT p_partkey, concat(CASE WHEN colour IS NOT NULL THEN 'color:' || colour || '|' END, 'object:', thing, '|object:', beside, CASE WHEN colour IS NOT NULL THEN '|binding:' || colour || ' ' || thing END,
  '|relation:', thing, ' next to ', beside) AS requirements, true AS compositional FROM p
""")
def q89_visual_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, objects, bindings and the relation of every part's request."""
    return decomposition.plans(_part_requests(spark, sf_dir), "query").select("p_partkey", _listed(), "compositional")


@register("""
WITH i AS (SELECT *, CASE item_id % 3 WHEN 0 THEN '绿色' WHEN 1 THEN '橙红色' ELSE '' END AS colour FROM items)
SELECT item_id, concat(CASE WHEN colour <> '' THEN 'binding:' || colour || kind || '|' END, 'relation:', CASE WHEN colour = '橙红色' THEN '橙' ELSE '' END, kind, '位于中央',
  CASE WHEN kind IN ('office', 'garden') THEN '|scene:' || kind END, '|ocr:数量为', size, '件') AS requirements, true AS compositional FROM i WHERE kind IS NOT NULL AND size IS NOT NULL
""")
def q90_clause_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditions of every item's two clauses."""
    colour = F.when(F.col("item_id") % 3 == 0, "绿色").when(F.col("item_id") % 3 == 1, "橙红色").otherwise("")
    query = F.concat(colour, F.col("kind"), F.lit("位于中央，数量为"), F.col("size").cast("string"), F.lit("件。"))
    rows = table(spark, sf_dir, "items").select("item_id", query.alias("query")).where("query is not null")
    return decomposition.plans(rows, "query", parser="clauses").select("item_id", _listed(), "compositional")


@register(PARTS + """
SELECT p_partkey, p_size % 2 = 1 AS accepted, CASE WHEN p_size % 2 = 1 THEN 1.0 ELSE round(1 - 1 / (CASE WHEN colour IS NULL THEN 3.0 ELSE 5.0 END), 6) END AS ratio FROM p
""")
def q91_plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A good global score does not hide the relation that every second part's candidate lacks."""
    each = decomposition.requirements(_part_requests(spark, sf_dir), query_id="p_partkey", query="query").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("query_id"), "p_size"), "query_id")
    raw = F.when((F.col("kind") == "relation") & (F.col("p_size") % 2 == 0), F.col("threshold") - 0.08).otherwise(F.col("full_score"))
    each = each.withColumns({"raw": raw, "global_score": F.lit(0.72)})
    each = each.withColumns({"strength": gates.strength(F.col("raw"), F.col("threshold"), F.col("full_score")), "passed": F.col("raw") >= F.col("threshold")})
    out = gates.coverage(each, keys=["query_id"], compositional=F.col("compositional"))
    return out.select(F.col("query_id").alias("p_partkey"), "accepted", F.round("coverage_ratio", 6).alias("ratio"))

"""Ranker configurations searched under a protocol: tuned on train, a family chosen on validation, frozen, tested once."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN, VALIDATION, TEST = "train", "validation", "test"


class Ranker(NamedTuple):
    """A configuration: its name, its family, and its score from the branch scores of a (query, item)."""

    name: str
    family: str
    score: Callable[[Mapping[str, Column]], Column]


def rankers(branches: Sequence[str], *, weights: Sequence[float], caps: Sequence[float], scales: Sequence[float], text: str, visual: str, lexical: str, confidence: str) -> list[Ranker]:
    """Every branch alone, fixed and confidence-capped mixtures of text and visual, and the geometric mean of both."""
    found = [Ranker(b, b, lambda c, b=b: c[b]) for b in branches]
    found += [Ranker(f"fixed {w}", "fixed", lambda c, w=w: F.lit(w) * c[text] + F.lit(1.0 - w) * c[visual]) for w in weights]

    def adaptive(c: Mapping[str, Column], cap: float, scale: float) -> Column:
        share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(cap) * c[confidence]))
        return share * (c[text] + F.lit(scale) * c[lexical]) + (F.lit(1.0) - share) * c[visual]

    found += [Ranker(f"adaptive {cap} {scale}", "adaptive", lambda c, cap=cap, scale=scale: adaptive(c, cap, scale)) for cap in caps for scale in scales]
    return [*found, Ranker("product", "product", lambda c: F.sqrt(F.greatest(c[text], F.lit(0.0)) * F.greatest(c[visual], F.lit(0.0))))]


def configuration_metrics(pairs: DataFrame, configurations: Sequence[Ranker], branches: Sequence[str], *, query: str = "query", split: str = "split", relevant: str = "relevant", cut: int = 10) -> DataFrame:
    """``(split, name, family, place, queries, hit, recall, mrr)`` of every configuration.

    ``pairs`` has a row per query and candidate with its branch scores. All
    configurations are scored in the same row, as the slots of one array; a
    query's best relevant score of every slot is one aggregate, how many
    candidates beat it another. So the pairs are read twice, whatever the
    number of configurations, and no row is made per pair and configuration.
    The rank of a query's best relevant candidate is one more than the number
    of candidates with a greater score. Queries without a relevant candidate
    have rank none: they count as misses. Null branch scores count as 0, null
    relevance as no.
    """
    branch = {b: F.coalesce(F.col(b).cast("double"), F.lit(0.0)) for b in branches}
    slots = range(len(configurations))
    scored = pairs.select(split, query, F.coalesce(F.col(relevant), F.lit(False)).alias("_relevant"), *(c.score(branch).alias(f"_s{i}") for i, c in enumerate(configurations)))
    best = scored.groupBy(split, query).agg(*(F.max(F.when(F.col("_relevant"), F.col(f"_s{i}"))).alias(f"_b{i}") for i in slots))
    met = scored.join(best, [split, query])
    ranks = met.groupBy(split, query).agg(*(F.when(F.max(f"_b{i}").isNotNull(), 1 + F.sum((F.col(f"_s{i}") > F.col(f"_b{i}")).cast("long"))).alias(f"_r{i}") for i in slots))
    named = F.array(*(F.struct(F.lit(c.name).alias("name"), F.lit(c.family).alias("family"), F.lit(i).alias("place"), F.col(f"_r{i}").alias("rank")) for i, c in enumerate(configurations)))
    each = ranks.select(split, F.explode(named).alias("c")).select(F.col(split).alias("split"), "c.*")
    # Reciprocal ranks are summed as whole numbers of 2520 * 10^6: the sum does not depend on its order.
    whole = F.when(F.col("rank") <= cut, F.floor(F.lit(2_520_000_000.0) / F.col("rank")).cast("long")).otherwise(0)
    found = each.groupBy("split", "name", "family", "place").agg(
        F.count(F.lit(1)).alias("queries"), F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("hits"), F.sum(F.when(F.col("rank") <= cut, 1).otherwise(0)).alias("found"), F.sum(whole).alias("reciprocal")
    )
    share = lambda c, by=1.0: (F.col(c) / (F.col("queries") * F.lit(by)))
    return found.select("split", "name", "family", "place", "queries", share("hits").alias("hit"), share("found").alias("recall"), share("reciprocal", 2_520_000_000.0).alias("mrr"))


def _best(rows: DataFrame, by: Sequence[str], on: str) -> DataFrame:
    """Of each group the configuration with the best metrics on ``on``; of equal ones the first listed."""
    order = Window.partitionBy(*by).orderBy(F.col(f"{on}.mrr").desc(), F.col(f"{on}.hit").desc(), F.col(f"{on}.recall").desc(), "place")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def select_configuration(metrics: DataFrame) -> DataFrame:
    """The family winners on train and which of them is best on validation: ``name, family, place, train, validation, selected``.

    The metrics must hold no test rows: a protocol that has seen them fails.
    """
    sealed = F.assert_true(F.col("split") != TEST, F.lit("selection must not see the test split"))
    rows = metrics.where(sealed.isNull())
    values = F.struct("queries", "hit", "recall", "mrr")
    side = lambda s: F.max(F.when(F.col("split") == s, values)).alias(s)
    both = rows.groupBy("name", "family", "place").agg(side(TRAIN), side(VALIDATION)).where(f"{TRAIN} is not null and {VALIDATION} is not null")
    winners = _best(both, ["family"], TRAIN)
    # Family winners are as few as there are families: they meet in one group.
    order = Window.partitionBy(F.lit(0)).orderBy(F.col(f"{VALIDATION}.mrr").desc(), F.col(f"{VALIDATION}.hit").desc(), F.col(f"{VALIDATION}.recall").desc(), "place")
    return winners.withColumn("selected", F.row_number().over(order) == 1)


def frozen(selection: DataFrame) -> str:
    """Name of the selected configuration: all that a test needs to know."""
    return selection.where("selected").select("name").first()["name"]


def test_metrics(pairs: DataFrame, configurations: Sequence[Ranker], name: str, branches: Sequence[str], **columns: str) -> DataFrame:
    """Metrics of the frozen configuration on the test rows; no other configuration is scored, no other split read."""
    chosen = [c for c in configurations if c.name == name]
    if len(chosen) != 1:
        raise ValueError(f"no configuration or several are called {name!r}")
    return configuration_metrics(pairs.where(F.col(columns.get("split", "split")) == TEST), chosen, branches, **columns).drop("place")

"""Lexical retrieval: inverted-index statistics and BM25."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import computed_once, token_count, tokens
from tessera.sources.tables import small
from tessera.sources.workspace import materialize


def token_table(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(item, dl, token, tf)``: one row per distinct token of an item, computed inside the row."""
    listed = items.select(F.col(id_col).alias("item"), tokens(F.coalesce(text_col, F.lit(""))).alias("ts"))
    rows = listed.select("item", F.size("ts").alias("dl"), F.explode("ts").alias("token"))
    return rows.groupBy("item", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def corpus_size(items: DataFrame, text_col: str) -> DataFrame:
    """One row: number of items and mean length in tokens."""
    return items.agg(F.count(F.lit(1)).alias("n_items"), F.avg(token_count(F.coalesce(text_col, F.lit("")))).alias("avg_dl"))


def bm25(queries: DataFrame, items: DataFrame, *, query_id: str, query_col: str, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``(query, item, score)`` of every item that shares a token with the query.

    Okapi weights with ``ln(1 + (N - df + .5) / (df + .5))``; a token repeated in
    the query counts ``1 + ln(qf)``. Items without a common token score 0 and
    are left implicit. Only tokens of some query enter the shuffle: the small
    side is joined before items are grouped. These postings are written once;
    document frequencies and scores both read them.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.coalesce(query_col, F.lit("")))).alias("token"))
    asked = asked.groupBy("query", "token").agg(F.count(F.lit(1)).alias("qf"))
    wanted = asked.select("token").distinct()
    listed = items.select(F.col(id_col).alias("item"), tokens(F.coalesce(text_col, F.lit(""))).alias("ts"))
    hits = listed.select("item", F.size("ts").alias("dl"), F.explode("ts").alias("token")).join(wanted, "token")
    hits = materialize(hits.groupBy("item", "dl", "token").agg(F.count(F.lit(1)).alias("tf")), "postings")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    scale = corpus_size(items, text_col)
    idf = df.crossJoin(F.broadcast(scale)).select(
        "token", "avg_dl", F.log(1 + (F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avg_dl", F.lit(1e-12))))
    asked = asked.join(idf, "token").withColumn("boost", 1 + F.log("qf"))
    return hits.join(asked, "token").groupBy("query", "item").agg(F.sum(weight * F.col("boost")).alias("score"))


def weighted_postings(
    queries: DataFrame, items: DataFrame, *, query_id: str, query_col: str, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75
) -> tuple[DataFrame, DataFrame]:
    """``(query, token, boost)`` and ``(item, token, w)``: ``bm25`` is the sum of boost times w over the common tokens.

    Texts are split once: the empty token, which no text has, stands for the
    item itself and its length. What is counted is written, weights are read off it.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.coalesce(query_col, F.lit("")))).alias("token"))
    asked = asked.groupBy("query", "token").agg(F.count(F.lit(1)).alias("qf"))
    listed = items.select(F.col(id_col).alias("item"), computed_once(tokens(F.coalesce(text_col, F.lit("")))).alias("ts"))
    wanted = asked.select("token").distinct().unionByName(queries.sparkSession.createDataFrame([("",)], "token string"))
    hits = listed.select("item", F.size("ts").alias("dl"), F.explode(F.concat("ts", F.array(F.lit("")))).alias("token")).join(small(wanted), "token")
    hits = materialize(hits.groupBy("item", "dl", "token").agg(F.count(F.lit(1)).alias("tf")), "postings")
    scale = hits.where("token = ''").agg(F.sum("tf").alias("n_items"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avg_dl"))
    scale, hits = F.broadcast(materialize(scale, "scale")), hits.where("token <> ''")  # one row
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avg_dl", F.lit(1e-12))))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = materialize(asked.join(df, "token").crossJoin(scale).select("query", "token", (idf * (1 + F.log("qf"))).alias("boost")), "asked")
    return asked, hits.crossJoin(scale).select("item", "token", part.alias("w"))


def bm25_best(
    queries: DataFrame, items: DataFrame, k: int, *, query_id: str, query_col: str, id_col: str, text_col: str, k1: float = 1.5, b: float = 0.75, common: int = 1_000
) -> DataFrame:
    """``(query, item, score, rank)``: the ``k`` best rows of ``bm25`` without scoring every item that shares a token.

    A token never takes away, so an item that shares no token of at most
    ``common`` items with the query is only among its best if it is among the
    best by the other, common tokens. Items with the same common tokens, counts
    and length score alike there, as do queries: classes of queries meet
    classes of items, and ``k`` items stand for a class. These candidates and
    all items that share a rarer token are scored in full. Exact for any ``common``.
    """
    asked = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.coalesce(query_col, F.lit("")))).alias("token"))
    asked = asked.groupBy("query", "token").agg(F.count(F.lit(1)).alias("qf"))
    listed = items.select(F.col(id_col).alias("item"), tokens(F.coalesce(text_col, F.lit(""))).alias("ts"))
    hits = listed.select("item", F.size("ts").alias("dl"), F.explode("ts").alias("token")).join(asked.select("token").distinct(), "token")
    hits = materialize(hits.groupBy("item", "dl", "token").agg(F.count(F.lit(1)).alias("tf")), "postings")
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n_items") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(df, "token").crossJoin(F.broadcast(corpus_size(items, text_col)))
    asked = materialize(asked.select("query", "token", "qf", "avg_dl", (F.col("df") > common).alias("often"), (idf * (1 + F.log("qf"))).alias("boost")), "asked")
    weight = F.col("boost") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.greatest("avg_dl", F.lit(1e-12))))
    often = asked.where("often")
    # Classes by what counts; the smallest member names the class.
    by_query = often.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("token", "qf", "boost", "avg_dl"))).alias("asks"))
    named = by_query.groupBy("asks").agg(F.min("query").alias("kind"))
    by_item = hits.join(often.select("token").distinct(), "token").groupBy("item", "dl").agg(F.array_sort(F.collect_list(F.struct("token", "tf"))).alias("holds"))
    first = Window.partitionBy("dl", "holds").orderBy("item")
    stand = materialize(by_item.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).withColumn("class", F.min("item").over(Window.partitionBy("dl", "holds"))), "classes")
    held = stand.where("n = 1").select("class", "dl", F.explode("holds").alias("h")).select("class", "dl", "h.*")
    scored = named.select("kind", F.explode("asks").alias("a")).select("kind", "a.*").join(held, "token").groupBy("kind", "class").agg(F.sum(weight).alias("score"))
    likely = top_k(scored.join(stand.select("class", "item"), "class"), k, query="kind").select("kind", "item")
    likely = by_query.join(named, "asks").select("query", "kind").join(likely, "kind").select("query", "item")
    rare = hits.join(asked.where("not often"), "token").select("query", "item")
    pairs = likely.unionByName(rare).distinct()
    full = pairs.join(asked, "query").join(hits, ["item", "token"]).groupBy("query", "item").agg(F.sum(weight).alias("score"))
    return top_k(full, k)


def top_k(scores: DataFrame, k: int, *, query: str = "query", item: str = "item", score: str = "score") -> DataFrame:
    """The ``k`` best items of each query with their rank; equal scores by item.

    Scores are compared to nine decimals, so sums added up in another order
    rank alike.
    """
    order = Window.partitionBy(query).orderBy(F.round(score, 9).desc(), F.col(item))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

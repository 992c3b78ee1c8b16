"""Exact deduplication by 128-bit content hash with a byte comparison inside groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import unused
from tessera.sources.workspace import materialize

SALTS = 16  # places a group's rows are spread over when they meet their group


def _best(doc_id: Column, row: Column, keep: str) -> tuple[Column, bool]:
    """What the row that stays is first by (or last, for the largest): ids before none, ties by position."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    if keep == "smallest":
        return F.struct(doc_id.isNull().alias("none"), doc_id.alias("doc_id"), row.alias("row")), True
    return F.struct(doc_id.isNotNull().alias("some"), doc_id.alias("doc_id"), (-row).alias("row")), False


def exact_groups(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by the MD5 of the text's bytes. Grouping by hash and text
    compares the bytes: copies collapse inside each task before anything is
    shuffled, so a text of any number of copies meets itself once per task; a
    hash with several texts is split by them. Only groups of two rows or more
    are joined back, each row to one of ``SALTS`` copies of its group.
    ``keep`` chooses the smallest or largest id to stay. Null texts count as
    empty; texts of any length are compared whole. Rows that repeat the id
    that stays are told apart by input position and only one is kept; rows
    without an id stay only if their whole group has none. Other columns are
    not read.
    """
    best, smallest = _best(F.col("doc_id"), F.col("row"), keep)
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), content.alias("text"))
    h128 = F.unhex(F.md5("text")).alias("h128")
    light = materialize(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", h128, F.sha2("text", 256).alias("text_sha256")), "hashed")
    texts = rows.select(h128, "text").groupBy("h128", "text").agg(F.count(F.lit(1)).alias("n"))
    split = texts.groupBy("h128").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h128", F.lit(True).alias("split"))
    split = materialize(split, "hash-collisions")
    if split.isEmpty():
        keyed = light.withColumn("variant", F.lit(""))
    else:
        keyed = light.join(split, "h128", "left").withColumn("variant", F.when(F.col("split"), F.col("text_sha256")).otherwise(""))
    groups = keyed.groupBy("h128", "variant").agg((F.min if smallest else F.max)(best).alias("best"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.where("group_size > 1").select("h128", "variant", "group_size", F.col("best.doc_id").alias("keep_id"), F.abs(F.col("best.row")).alias("keep_row"))
    groups = materialize(groups, "exact-groups")
    spread = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = keyed.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(spread, ["h128", "variant", "salt"], "left")
    alone = F.col("group_size").isNull()
    return met.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def without_copies(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``documents`` with one row of each group of equal texts, all columns kept.

    One aggregate by hash and text whose partial step leaves one row a text
    and task. The rules for nulls, ties and repeated ids are those of
    ``exact_groups``. A null text stays null if its row is the one that stays.
    """
    row, h128, text, kept = unused(documents, "row", "h128", "same_text", "kept_row")
    best, smallest = _best(F.col(id_col), F.col(row), keep)
    content = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.withColumns({row: F.monotonically_increasing_id(), h128: F.unhex(F.md5(content)), text: content})
    # The text itself is the group's key: only whether it was null travels beside it.
    others = F.struct(*(F.col(c).isNull().alias(c) if c == text_col else F.col(c) for c in documents.columns))
    chosen = rows.groupBy(h128, text).agg((F.min_by if smallest else F.max_by)(others, best).alias(kept))
    kind = documents.schema[text_col].dataType
    back = F.when(~F.col(kept)[text_col], F.col(text).cast(kind)).alias(text_col)
    return chosen.select(*(back if c == text_col else F.col(kept)[c].alias(c) for c in documents.columns))

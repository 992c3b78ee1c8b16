"""Secret scan with corpus-wide ownership frequency, in built-in functions only.

Candidates are spans of credential-like text. The hash of each candidate is
aggregated over the whole corpus: in how many distinct repositories and under
how many distinct owners it occurs. A value copied under many owners is an
example from documentation; one that a single owner uses, and that is not a
placeholder, looks live. Base spans are always reported; further kinds are
reported only when they look live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.columns import bound, running, unused
from tessera.sources.workspace import materialize

# Base kinds in the order they are listed, pattern, and the test a match must pass.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8),
    ("access", r"AKIA[A-Z0-9]+", 16),
    ("hex", r"[0-9a-f]{32,}", 32),
)

# A private key block. Group 1 is its body: all up to the END line if no other marker comes first,
# else header fields, long base64 runs, lines of base64 alone and a padded last run.
_GAP, _LINE = r"(?:\s|\\[nrt])*+", r"(?:(?:\r?\n|\\r\\n|\\n)[ \t]*+)"
_END = r"-----END [A-Z ]*PRIVATE KEY-----"
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
    rf"([^-]*+(?:-(?!----)[^-]*+)*+(?={_END})"
    rf"|(?:{_GAP}(?:Proc-Type|DEK-Info): (?:(?!\\[nr])\S)++)*+"
    rf"(?:{_GAP}[A-Za-z0-9+/=]{{20,}}+|{_LINE}[A-Za-z0-9+/=]++(?=[ \t]*+(?:\r?\n|\\[nr]|\z))|{_GAP}[A-Za-z0-9+/]++={{1,2}}+)*+)"
    rf"(?:{_END})?"
)

# Further credential forms in public use, pattern and the group that is the value.
MORE = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    ("pem", PEM, 1),
)

KINDS = tuple(k for k, *_ in BASE) + tuple(k for k, *_ in MORE)
EXAMPLE = r"(?i)example|changeme|placeholder|your[_-]|xxxx|dummy|sample|12345678"
# Key bodies are long: four letters x stand in some by chance. Blanks and dashes are out of them by then.
PEM_EXAMPLE = EXAMPLE.replace("xxxx", "x{8}").replace("your[_-]", "your(?:private|secret)?key")


SPANS = "array<struct<start:int,end:int,order:int,value:string,from:int,to:int>>"


def _spans(text: Column, order: int, pattern: str, value_group: int) -> Column:
    """Matches of ``pattern``, leftmost and non-overlapping, as (start, end, order, value, from, to).

    The pieces between matches and the matches themselves alternate, so the
    running totals of their lengths are the places: in code points (start,
    end) and in bytes (from, to).
    """
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("found"), values.alias("value")), lambda x: x["found"].isNotNull())

    def totals(z: Column, size) -> Column:
        return running(F.transform(z, lambda x: size(x["gap"]) + size(x["found"])), lambda a, b: a + b)

    def placed(z: Column) -> Column:
        ends = F.arrays_zip(totals(z, F.length).alias("end"), totals(z, F.octet_length).alias("to"), z.alias("x"))
        return F.transform(
            ends,
            lambda e: F.struct(
                (e["end"] - F.length(e["x"]["found"])).alias("start"), e["end"].alias("end"), F.lit(order).alias("order"), e["x"]["value"].alias("value"),
                (e["to"] - F.octet_length(e["x"]["found"])).alias("from"), e["to"].alias("to"),
            ),
        )

    return F.when(text.rlike(pattern), bound(pairs, placed)).otherwise(F.array().cast(SPANS))


def _at_least(n: int):
    return lambda s: F.length(s["value"]) >= n


def _key_body(value: Column) -> Column:
    """The base64 letters of a key, so that copies with other line ends or indents are equal."""
    return F.regexp_replace(value, r"\\[nrt]|[^A-Za-z0-9+/=]", "")


def candidate_spans(text: Column) -> Column:
    """All spans of all kinds that pass their length test, by start and then kind."""
    parts = []
    for order, (kind, pattern, least) in enumerate(BASE):
        spans = _spans(text, order, pattern, 1 if kind == "assign" else 0)
        parts.append(F.filter(spans, _at_least(least)))
    for order, (kind, pattern, group) in enumerate(MORE, len(BASE)):
        spans = _spans(text, order, pattern, group)
        parts.append(F.transform(spans, lambda s: s.withField("value", _key_body(s["value"]))) if kind == "pem" else spans)
    return F.sort_array(F.concat(*parts))


def _is_example(s: Column) -> Column:
    return F.when(s["order"] == KINDS.index("pem"), s["value"].rlike(PEM_EXAMPLE)).otherwise(s["value"].rlike(EXAMPLE))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["order"]), s["start"], s["end"])), ",")


def found_secrets(
    documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang"), live_owners: int = 1
) -> DataFrame:
    """One row per input row: ``row, doc_id, text_key, spans`` with each span's ownership.

    ``spans`` is an array of (start, end, order, hash, owners, repos, live,
    from, to); start and end count code points, from and to bytes, ends are
    exclusive. Texts of any length are searched whole, in time proportional to
    length and matches. Null and empty texts have no spans. Null owners count as one owner of their own. Null ids
    and repeated rows pass through as rows of their own. Columns of the input
    other than those named are not read.
    """
    owner = F.coalesce(F.col(owner_col).cast("string"), F.lit(""))
    repo = F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), owner.alias("owner"), repo.alias("repo"), text.alias("_text"))
    rows = rows.select("doc_id", "owner", "repo", F.xxhash64("_text").alias("text_key"), candidate_spans(F.col("_text")).alias("found"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id", "owner", "repo", "text_key",
        F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["order"].alias("order"), s["from"].alias("from"), s["to"].alias("to"),
                                                F.sha2(s["value"], 256).alias("hash"), _is_example(s).alias("example"))).alias("found"),
    )
    rows = materialize(rows, "secret-candidates")
    each = rows.select("row", "owner", "repo", F.explode("found").alias("s")).select("row", "owner", "repo", "s.*")
    # Distinct (value, owner, repository) first, then counts: no list of owners is ever built.
    uses = each.select("hash", "owner", "repo").distinct()
    owned = uses.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    owned = owned.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))
    judged = each.join(owned, "hash").withColumn("live", (F.col("owners") <= live_owners) & ~F.col("example"))
    spans = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end", "order", "hash", "owners", "repos", "live", "from", "to"))).alias("spans"))
    empty = F.array().cast("array<struct<start:int,end:int,order:int,hash:string,owners:bigint,repos:bigint,live:boolean,from:int,to:int>>")
    return rows.select("row", "doc_id", "text_key").join(spans, "row", "left").select("row", "doc_id", "text_key", F.coalesce("spans", empty).alias("spans"))


def secret_report(documents: DataFrame, **options) -> DataFrame:
    """Counts and digests of ``found_secrets``, one row per input row."""
    rows = found_secrets(documents, **options)
    of = lambda k: F.size(F.filter("spans", lambda s: s["order"] == F.lit(k))).cast("long")
    by_kind = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["live"].alias("live"))))
    rows = rows.withColumn("spans", by_kind)
    base = F.filter("spans", lambda s: s["order"] < F.lit(len(BASE)))
    said = F.filter("spans", lambda s: (s["order"] < F.lit(len(BASE))) | s["live"])
    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return rows.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(said).alias("spans"), live.alias("n_live"),
    )


def redacted(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", mark: str = "[REDACTED]", **options) -> DataFrame:
    """The input with every live-looking span of ``text_col`` replaced by ``mark``.

    Overlapping spans are cut out once, from the first start to the last end.
    Texts of rows without such spans are left as they are, nulls included.
    Pieces are cut from the text's bytes and joined once, so the time does not
    grow with the product of length and spans.
    """
    key_id, key_text, cuts = unused(documents, "secret_id", "secret_text", "secret_cuts")
    live = found_secrets(documents, id_col=id_col, text_col=text_col, **options)
    spans = F.transform(F.filter("spans", lambda s: s["live"]), lambda s: F.struct(s["from"].alias("from"), s["to"].alias("to")))
    live = live.select(F.col("doc_id").alias(key_id), F.col("text_key").alias(key_text), F.sort_array(spans).alias(cuts))
    live = live.where(F.size(cuts) > 0).dropDuplicates([key_id, key_text])
    text = F.col(text_col)

    def pieces(found: Column, raw: Column) -> Column:
        def between(reach: Column) -> Column:
            sides = F.transform(found, lambda s, k: F.struct(F.coalesce(F.get(reach, k - F.lit(1)), F.lit(0)).alias("a"), s["from"].alias("b")))
            kept = F.transform(F.filter(sides, lambda x: x["b"] >= x["a"]), lambda x: F.substring(raw, x["a"] + 1, x["b"] - x["a"]).cast("string"))
            return F.concat(kept, F.array(F.substring(raw, F.element_at(reach, -1) + 1, F.octet_length(raw)).cast("string")))

        return bound(running(F.transform(found, lambda s: s["to"]), F.greatest), between)

    cut = F.array_join(bound(F.col(cuts), lambda found: bound(text.cast("string").cast("binary"), lambda raw: pieces(found, raw))), mark)
    same = F.col(id_col).eqNullSafe(F.col(key_id)) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col(key_text))
    joined = documents.join(live, same, "left")
    return joined.select(*(F.when(F.col(cuts).isNull(), text).otherwise(cut).alias(c) if c == text_col else F.col(c) for c in documents.columns))

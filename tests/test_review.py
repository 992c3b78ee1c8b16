from pyspark.sql import functions as F

from tessera.operators import conditions, literals, review


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_labels_and_roles(spark):
    rows = spark.createDataFrame([("a", "reclassified", "b", None), ("a", "accepted", None, "z"), ("a", None, None, "z"), ("a", None, None, None)], "c string, d string, h string, p string")
    got = rows.select(review.effective_label(F.col("c"), F.col("d"), F.col("h"), F.col("p")).alias("x")).collect()
    assert [r.x for r in got] == ["b", "a", "z", "a"]
    items = spark.createDataFrame([(1,), (2,), (3,)], "i int")
    roles = review.duplicate_roles(items, spark.createDataFrame([(1, 2)], "k int, r int"), item="i", keep="k", remove="r")
    assert {r.i: (r.dedup_role, r.search_enabled) for r in roles.collect()} == {1: ("kept", True), 2: ("removed", False), 3: ("single", True)}


def test_consensus_and_adjudication(spark):
    votes = spark.createDataFrame([("q", "x", 0.9), ("q", "x", 0.85), ("q", "y", 0.99), ("p", "x", 0.9), ("p", "y", 0.9)], "q string, v string, c double")
    got = {r.q: (r.v, r.agreed) for r in review.consensus(votes, case="q", vote="v", confidence="c").collect()}
    assert got == {"q": ("x", True), "p": ("x", False)}
    frame = lambda *rows: spark.createDataFrame(rows, "q int, d string")
    rows = review.adjudicated(frame((1, "a"), (2, "a"), (3, "a")), frame((1, "a"), (2, "b"), (3, "b")), frame((2, "b")), case="q", decision="d").collect()
    assert {r.q: (r.d, r.conflict, r.pending) for r in rows} == {1: ("a", False, False), 2: ("b", True, False), 3: (None, True, True)}


def test_promotion_is_stable(spark):
    rows = spark.createDataFrame([("q", i, i) for i in range(1, 6)], "query string, item int, rank int")
    got = review.promoted(rows, F.col("item").isin(3, 5)).orderBy("new_rank").collect()
    assert [r["item"] for r in got] == [3, 5, 1, 2, 4]


def test_set_scores(spark):
    rows = spark.createDataFrame([(["a", "b"], ["b", "c", "c"]), (["d"], None)], "g array<string>, p array<string>").withColumn("k", F.lit(1))
    r = review.set_scores(rows, "g", "p", ["k"]).first()
    assert (r.precision, round(r.recall, 6), round(r.f1, 6)) == (0.5, 0.333333, 0.4)


def test_literals(spark):
    r = one(
        spark, literals.valid_evidence_line(F.lit("Annual report of the board"), F.lit(0.9)).alias("ok"), literals.valid_evidence_line(F.lit("call 1234567 now"), F.lit(0.9)).alias("no"),
        literals.phrase_candidates(F.lit("one two three four")).alias("p"), literals.four_digit_year(F.lit(49)).alias("y"), literals.four_digit_year(F.lit(50)).alias("z"),
    )
    assert (r.ok, r.no, r.y, r.z) == (True, False, 2049, 1950)
    assert r.p == ["one two three four", "one two three", "two three four"]


def test_fuzzy_hits(spark):
    """The bounded search finds what comparing every window finds."""
    import random
    from difflib import SequenceMatcher

    draw = random.Random(5)
    terms = [(i, " ".join("".join(draw.choices("abcde", k=draw.randint(2, 6))) for _ in range(draw.randint(2, 6)))) for i in range(12)]
    pages = []
    for i in range(15):
        near = list(draw.choice(terms)[1])
        near[draw.randrange(len(near))] = "x"
        pages.append((i, ["".join(draw.choices("abcde ", k=30)), "".join(near), "".join(draw.choices("abc ", k=20))]))
    pages.append((99, None))

    def best(term, lines):
        t, parts = conditions.compact(term), [conditions.compact(x) for x in lines or [] if conditions.compact(x)]
        joined = "".join(parts)
        if t in joined:
            return 1.0
        windows = [joined[k : k + len(t)] for k in range(len(joined) - len(t) + 1)]
        return max((SequenceMatcher(None, t, w).ratio() for w in parts + windows), default=0.0)

    want = {(i, p): round(best(t, ls), 8) for i, t in terms for p, ls in pages}
    rows = spark.createDataFrame(pages, "page int, lines array<string>")
    got = conditions.fuzzy_hits(rows, spark.createDataFrame(terms, "term_id int, term string"), fuzzy=0.8, block=5)
    assert {(r.term_id, r.page): r.similarity for r in got.collect()} == {k: v for k, v in want.items() if v >= 0.8}
    assert conditions.PageText(["ab cd"]).best_ratio("zz") == 0.0

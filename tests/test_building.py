"""Source selection, inverted index, archives, lateral candidates, configuration search."""

import hashlib
import io
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inverted, search
from tessera.operators.fusion import attached_candidates
from tessera.operators.selection import balanced_items, independent_items, replaced_items, shortfall, source_families
from tessera.sources.archives import archive_members


def key_of(seed, item):
    return hashlib.sha256(f"{seed}|{item}".encode()).hexdigest(), item


def greedy(rows, seed, barred=()):
    """rows: {item: keys}; one by one in hash order."""
    used, out = set(barred), set()
    for item in sorted(rows, key=lambda i: key_of(seed, i)):
        if not rows[item] & used:
            used |= rows[item]
            out.add(item)
    return out


def drawn(seed, n, keys, hot=True):
    draw = random.Random(seed)
    return {i: {f"k{draw.randrange(keys)}" for _ in range(draw.randrange(4))} | ({"hot"} if hot and i % 3 == 0 else set()) for i in range(n)}


def sources(spark, rows):
    return spark.createDataFrame([(i, sorted(k) + [None], f"c{i % 3}", "x") for i, k in rows.items()], "id int, keys array<string>, cell string, item string")


@pytest.mark.parametrize("keys", [5, 40, 400])
def test_independent_items(spark, keys):
    rows = drawn(keys, 120, keys)
    barred = spark.createDataFrame([("k1",), ("k2",)], "key string")
    got = {r.item for r in independent_items(sources(spark, rows), item="id", keys="keys", seed="s", excluded=barred).collect()}
    assert got == greedy(rows, "s", {"k1", "k2"})


def test_independent_items_of_odd_tables(spark):
    empty = spark.createDataFrame([], "id int, keys array<string>")
    assert independent_items(empty, item="id", keys="keys", seed="s").collect() == []
    odd = spark.createDataFrame([(1, None), (2, []), (3, ["a"]), (3, ["b"]), (4, ["b"]), (None, ["z"])], "id int, keys array<string>")
    assert {r.item for r in independent_items(odd, item="id", keys="keys", seed="s").collect()} == greedy({1: {"1"}, 2: {"2"}, 3: {"a", "b"}, 4: {"b"}}, "s")


def test_balanced_and_replaced_items(spark):
    rows = drawn(7, 150, 90, hot=False)
    frame = sources(spark, rows)
    quotas = spark.createDataFrame([("c0", 4), ("c1", 1), ("c2", 500), ("none", 2)], "cell string, wanted int")
    chosen = balanced_items(frame, quotas, item="id", keys="keys", cell="cell", seed="s")
    got = {r.item: r.cell for r in chosen.collect()}
    used = [k for i in got for k in rows[i]]
    assert len(used) == len(set(used)) and all(c == f"c{i % 3}" for i, c in got.items())
    n = {c: list(got.values()).count(c) for c in ("c0", "c1", "c2")}
    assert n["c0"] == 4 and n["c1"] == 1
    assert all(rows[i] & set(used) for i in rows if i % 3 == 2 and i not in got)  # nothing more fits
    assert {(r.cell, r.missing) for r in shortfall(chosen, quotas, "cell").collect()} == {("c2", 500 - n["c2"]), ("none", 2)}
    queue = spark.createDataFrame([(i, f"c{i % 3}") for i in list(got)[:6]], "id int, cell string")
    dropped = queue.limit(3)
    new = replaced_items(queue, frame, dropped, item="id", keys="keys", cell="cell", seed="t").collect()
    gone, old = {r.id for r in dropped.collect()}, {r.id for r in queue.collect()}
    assert {r["item"] for r in new if not r["replacement"]} == old - gone
    fresh = [r for r in new if r["replacement"]]
    assert sorted(r["cell"] for r in fresh) == sorted(f"c{i % 3}" for i in gone) and not {r["item"] for r in fresh} & old
    held = [k for i in old for k in rows[i]]
    assert not {k for r in fresh for k in rows[r["item"]]} & set(held)


def test_source_families(spark):
    rows = spark.createDataFrame([(i, f"g{i % 7}" if i < 28 else f"one{i}", "a" if i % 7 < 4 else "b", 100 - i) for i in range(31)], "id int, grp string, lang string, n int")
    counts = spark.createDataFrame([("a", 2), ("b", 9)], "lang string, wanted int")
    got = source_families(rows, counts, item="id", group="grp", stratum="lang", order="n", seed="s").collect()
    assert sorted(r["stratum"] for r in got) == ["a", "a", "b", "b", "b"] and all(r["target"] == r["neighbour"] + 7 for r in got)


def test_inverted_index(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(300)]
    frame = spark.createDataFrame([*rows, (None, [1.0] * 8), (999, None)], "id int, v array<float>")
    root = f"file://{tmp_path}/index"
    inverted.create_index(root, frame, item="id", vector="v", cells=6)
    assert inverted.indexed(spark, root) is None
    for part in ("id < 200", "id >= 100 or id is null", "true"):
        inverted.append(root, frame.where(part), item="id", vector="v")
    held = inverted.indexed(spark, root)
    assert held.count() == held.select("item").distinct().count() == 300 and held.select("cell").distinct().count() > 2
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    got = inverted.search(root, frame.where("id < 20"), query="id", vector="v", k=5, probe=6)
    assert {(r["query"], r["rank"], r["item"]) for r in got.collect()} == {(q, n + 1, int(i)) for q in range(20) for n, i in enumerate(np.argsort(-(x @ x[q]), kind="stable")[:5])}
    near = inverted.search(root, frame.where("id < 20"), query="id", vector="v", k=5, probe=2)
    assert near.count() == 100


def zipped(files, encrypt=False):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as out:
        for name, text in files:
            out.writestr(name, text)
    data = bytearray(held.getvalue())
    if encrypt:
        data[data.index(b"PK\x01\x02") + 8] |= 1
    return bytes(data)


def test_archives(spark):
    link = zipfile.ZipInfo("link")
    link.external_attr = 0o120777 << 16
    lying = bytearray(zipped([("a.txt", "hello hello hello hello")]))
    lying[lying.index(b"PK\x01\x02") + 24] -= 3  # claims three bytes less than it holds
    rows = [
        (1, zipped([("a.txt", "hi"), ("d/", ""), ("d/B.TXT", "ho"), ("x.bin", "1")])), (2, zipped([("../e.txt", "x")])), (3, b"nope"), (4, None), (5, zipped([])), (6, zipped([("big.txt", "0" * 3_000_000)])),
        (7, zipped([(link, "/etc")])), (8, zipped([("a.txt", "1")], True)), (9, zipped([(f"{i}.txt", "1") for i in range(6)])), (10, zipped([("/abs.txt", "x")])), (11, zipped([("..\\w.txt", "x")])), (12, bytes(lying)),
    ]
    frame = spark.createDataFrame(rows, "id int, content binary")
    got = archive_members(frame, content="content", suffixes=(".txt",), max_files=5)
    assert got.columns == ["id", "member", "size", "content", "refused"]
    told = sorted(((r["id"], r["member"], bytes(r["content"]) if r["content"] is not None else None, r["refused"]) for r in got.collect()), key=str)
    want = [(1, "a.txt", b"hi", None), (1, "d/B.TXT", b"ho", None), (2, None, None, "unsafe path"), (3, None, None, "not an archive"), (4, None, None, "not an archive"), (6, None, None, "suspicious ratio")]
    want += [(7, None, None, "link"), (8, None, None, "encrypted"), (9, None, None, "too many files"), (10, None, None, "unsafe path"), (11, None, None, "unsafe path"), (12, "a.txt", None, "damaged")]
    assert told == sorted(want, key=str)
    assert {r["refused"] for r in archive_members(frame.where("id = 1"), content="content", max_bytes=3).collect()} == {"too large"}


def test_attached_candidates(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,), (None,)], "q int")
    run = spark.createDataFrame([(1, 5.0, "a"), (1, 7.0, "b"), (1, 6.0, "c"), (2, 1.0, "d"), (None, 9.0, "e")], "q int, s double, item string")
    got = attached_candidates(asked, {"one": run, "two": run.where("item != 'b'")}, key="q", order="s", k=2)
    assert {(r["q"], r["run"], r["place"], r["item"]) for r in got.collect()} == {(1, "one", 1, "b"), (1, "one", 2, "c"), (2, "one", 1, "d"), (1, "two", 1, "c"), (1, "two", 2, "a"), (2, "two", 1, "d")}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and plan.index("Join") < plan.index("WindowGroupLimit")


def test_configuration_search(spark):
    draw = random.Random(5)
    names = ("a", "b", "c")
    pairs = [(q, ("train", "validation", "test")[q % 3], draw.random() < 0.2 if q != 6 else None, *(draw.choice([0.0, 0.5, 1.0, draw.random(), None]) for _ in names)) for q in range(30) for _ in range(12)]
    frame = spark.createDataFrame(pairs, "query int, split string, relevant boolean, a double, b double, c double")
    configs = [search.Ranker("a", "one", lambda c: c["a"]), search.Ranker("b", "one", lambda c: c["b"]), search.Ranker("mix", "two", lambda c: c["a"] + c["c"])]
    score = {"a": lambda x: x[0], "b": lambda x: x[1], "mix": lambda x: x[0] + x[2]}
    got = {(r.split, r.name): (r.queries, r.hit, r.recall, r.mrr) for r in search.configuration_metrics(frame, configs, names, cut=3).collect()}
    for split in ("train", "validation", "test"):
        for name, f in score.items():
            ranks = []
            for q in {p[0] for p in pairs if p[1] == split}:
                rows = [(f([x or 0.0 for x in p[3:]]), p[2]) for p in pairs if p[0] == q]
                best = max((s for s, rel in rows if rel), default=None)
                ranks.append(None if best is None else 1 + sum(s > best for s, _ in rows))
            want = (len(ranks), sum(r == 1 for r in ranks) / len(ranks), sum(r is not None and r <= 3 for r in ranks) / len(ranks), sum(1 / r for r in ranks if r is not None and r <= 3) / len(ranks))
            assert got[split, name] == pytest.approx(want, abs=1e-8)
    metrics = search.configuration_metrics(frame.where("split != 'test'"), configs, names, cut=3)
    selection = search.select_configuration(metrics).collect()
    winners = {max(("a", "b"), key=lambda n: (got["train", n][3], got["train", n][1], got["train", n][2], n == "a")), "mix"}
    assert {r.name for r in selection} == winners
    best = max(winners, key=lambda n: (got["validation", n][3], got["validation", n][1], got["validation", n][2]))
    assert [r.name for r in selection if r.selected] == [best] == [search.frozen(search.select_configuration(metrics))]
    tested = search.test_metrics(frame, configs, best, names)
    assert tested.count() == 1 and tested.first().split == "test"
    with pytest.raises(ValueError):
        search.test_metrics(frame, configs, "unknown", names)
    with pytest.raises(Exception, match="must not see the test split"):
        search.select_configuration(search.configuration_metrics(frame, configs, names)).collect()
    assert search.configuration_metrics(frame.limit(0), configs, names).count() == 0

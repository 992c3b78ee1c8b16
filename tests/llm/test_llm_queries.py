"""Registered queries and the pipeline on the smallest tables."""

import llm_brute as brute
import corpus_pipeline
import pyarrow.parquet as pq
import pytest

from tessera.llm import queries


def documents(small):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}


def test_every_query_returns_every_document(spark, small):
    ids = set(documents(small))
    for name, query in queries.QUERIES.items():
        if not name.startswith(("op1_", "op11_", "op12_")):
            got = [r.doc_id for r in query(spark, small).select("doc_id").collect()]
            assert len(got) == len(ids) and set(got) == ids, name


def test_held_out_toxicity(spark, small):
    rows = queries.op3_toxicity(spark, small).collect()
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "clicks", "embeddings"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.sql(queries.ORACLES[name])
    columns = list(want.columns)
    assert sorted(tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, small).collect()) == sorted(want.fetchall())


def test_pipeline(spark, small):
    texts = documents(small)
    assert [s[0] for s in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "secret scans", "packing"]
    good = {i: t for i, t in texts.items() if not brute.quality(t)[5]}
    docs, seen, kept = spark.read.parquet(f"{small}/documents.parquet"), [], []
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
        kept.append(docs)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if len(seen) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert seen[0] <= set(good)
    single = {}
    for i in sorted(seen[0]):
        single.setdefault(texts[i], i)
    assert seen[1] == set(single.values())
    groups = brute.components({i: texts[i] for i in seen[1]}, 5, 80, 100)
    assert seen[2] == {i for i, (_, c) in groups.items() if i == c} == seen[3] == seen[4]
    packed_as_told(docs.collect(), {r.doc_id: r.text for r in kept[3].collect()})
    redacted_as_told(spark, kept[2], kept[3])


def packed_as_told(rows, texts):
    """Token counts are the library's, every batch keeps its budget, every place is taken once."""
    import base64

    import tiktoken

    from tessera.llm import packing

    with open(queries.tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    library = tiktoken.Encoding("test", pat_str=packing.PATTERN, mergeable_ranks=table, special_tokens={})
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library.encode_ordinary(t)) for i, t in texts.items()}
    batches = {}
    for r in rows:
        batches.setdefault(r.batch, []).append(r)
    for members in batches.values():
        assert sorted(r.slot for r in members) == list(range(len(members))) and len({r.padded_length for r in members}) == 1
        assert len(members) == 1 or len(members) * members[0].padded_length <= 65_536
        assert all(r.n_tokens <= r.padded_length for r in members)


def redacted_as_told(spark, before, after):
    """Each text is the one before with its live spans, brought together where they overlap, replaced by the mark."""
    from tessera.llm.secrets import found_secrets

    old = {r.doc_id: r.text for r in before.collect()}
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans if s.live] for r in found_secrets(before).collect()}
    changed = 0
    for r in after.collect():
        out, at = [], 0
        for a, b in sorted(spans[r.doc_id]):
            if a >= at:
                out += [old[r.doc_id][at:a], "[REDACTED]"]
            at = max(at, b)
        assert r.text == "".join(out) + old[r.doc_id][at:] and r.n_chars == len(r.text)
        changed += r.text != old[r.doc_id]
    assert changed == sum(map(bool, spans.values()))


def test_held_out_accuracy(spark, small):
    """On labelled rows the model never saw: most toxic texts are found, hardly a clean one is called toxic."""
    folder = str(small).replace("sf0.001", "sf0.01")
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    rows = [(toxic[r.doc_id], r.predicted) for r in queries.op3_toxicity(spark, folder).where("held_out").collect() if r.doc_id in toxic]
    found = [p for t, p in rows if t == 1]
    wrong = [p for t, p in rows if t == 0]
    assert sum(found) >= 0.6 * len(found) and sum(wrong) <= 0.1 * len(wrong)

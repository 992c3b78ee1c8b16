"""Passage removal against a plain version."""

import hashlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from llm_brute import WORD
from llm_cases import LONG, ROWS, frame

from tessera.llm import queries
from tessera.llm.passages import block_keys, remove_passages, rolling_least, spans_of, window_hashes


def plain(docs, length):
    """docs: [(id, text)] -> sorted [(id, words, removed, kept text)], straight from the definition; no id comes last."""
    words = [(2**63 - 1 if i is None else i, i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for rank, _, w in sorted(words, key=lambda x: x[0]):
        for k in range(len(w) - length + 1):
            first.setdefault(tuple(w[k : k + length]), rank)
    out = []
    for rank, i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] < rank:
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return sorted(out, key=str)


def texts_of(rows):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in rows), key=str)


def digests_of(rows):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rows), key=str)


def hashed(found):
    return sorted(((i, n, r, hashlib.sha256(t.encode()).hexdigest()) for i, n, r, t in found), key=str)


@pytest.mark.parametrize("length", [2, 3, 7, 10])
def test_small_alphabets(spark, length):
    rng = np.random.default_rng(length)
    docs = [(int(i), " ".join(rng.choice(["a", "b", "A"], size=rng.integers(0, 25)))) for i in rng.permutation(60)]
    docs += [(7, docs[3][1]), (None, docs[4][1]), (None, "a b A " * 9)]
    got = remove_passages(frame(spark, [(i, t, "s") for i, t in docs]), length=length).collect()
    assert texts_of(got) == plain(docs, length)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_awkward_documents(spark, awkward):
    more = [(30, LONG, "a"), (31, "start " + LONG + " end", "a"), (32, " ".join(LONG.split()[100:149]), "b"), (33, " ".join(LONG.split()[100:150]), "b"), (34, "x y z " * 60, "c"), (35, "new x y z " * 60, "c")]
    both = awkward.unionByName(frame(spark, more))
    docs = [(i, t) for i, t, _ in [*ROWS, *more]]
    want = plain(docs, 50)
    assert texts_of(remove_passages(both).collect()) == want
    assert digests_of(remove_passages(both, digest=True).collect()) == hashed(want)


def test_empty_table(spark, nothing):
    assert remove_passages(nothing).collect() == []
    assert remove_passages(nothing, digest=True).columns == ["doc_id", "n_words", "n_removed", "spans", "kept_sha256"]


def test_query(spark, small):
    for folder in (small, str(small).replace("sf0.001", "sf0.01")):
        docs = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{folder}/documents.parquet").to_pylist()]
        assert digests_of(queries.op13_passage_removal(spark, folder).collect()) == hashed(plain(docs, 50))


def test_chain_of_overlapping_passages(spark):
    """Each document shares its middle with the one before; only what an earlier one holds goes."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[30 * i : 30 * i + 80])) for i in range(10)]
    docs += [(20, " ".join(words[0:60] + words[100:160])), (21, " ".join(words[11:60] + ["gap"] + words[100:150]))]
    assert texts_of(remove_passages(frame(spark, [(i, t, "s") for i, t in docs])).collect()) == plain(docs, 50)


def test_hashes():
    words = np.array([xxhash.xxh3_64_intdigest(str(i % 13)) for i in range(200)], dtype=np.uint64)
    for size in (1, 2, 3, 8, 25, 50):
        for kind in (0, 1):
            h = window_hashes(words, size, kind)
            assert len(h) == 200 - size + 1 and len(set(h.tolist())) == 13
            assert all((h[i] == h[i % 13]) for i in range(len(h)))
    assert len(window_hashes(words[:49], 50)) == 0 == len(window_hashes(words[:0], 3)) == len(block_keys(words[:24], 25))
    for size in (1, 2, 3, 18, 200, 201):
        assert rolling_least(words, size).tolist() == [min(words[i : i + size].tolist()) for i in range(200 - size + 1)]
    assert spans_of(np.array([5, 0, 3, 8, 30, 29]), 4) == [(0, 12), (29, 34)]

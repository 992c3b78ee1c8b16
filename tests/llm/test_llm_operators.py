"""Each operator on awkward rows and on empty tables, against plain versions."""

import llm_brute as brute
import numpy as np
import pytest
from llm_cases import LINE, ROWS, frame

from tessera.llm import chat, packing, toxicity
from tessera.llm.bpe import encode_documents
from tessera.llm.exact_dedup import exact_groups, without_copies
from tessera.llm.licenses import TEMPLATES, scan_licenses
from tessera.llm.ngram_join import ngram_jaccard_components
from tessera.llm.quality import quality_filter, quality_report
from tessera.llm.queries import tokenizer_file
from tessera.llm.repeats import remove_repeats
from tessera.llm.secrets import redacted, secret_report


def near(spark):
    """Groups of near copies, chains of them, and a passage that many share."""
    words = [f"v{i}" for i in range(120)]
    rows = [(100 + k, " ".join(words[:k] + [f"new{k}"] + words[k + 1 :]), "a") for k in range(0, 40, 3)]
    rows += [(200 + k, " ".join(words[:30] + [f"own{k}_{i}" for i in range(60)]), "b") for k in range(12)]
    chain = [f"c{i}" for i in range(200)]
    rows += [(300 + k, " ".join(chain[: 150 + 4 * k]), "c") for k in range(12)]
    return rows


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_ngram_join(spark, size, num, den):
    rows = [r for r in ROWS if r[0] is not None] + near(spark)
    got = ngram_jaccard_components(frame(spark, rows), size=size, num=num, den=den).collect()
    want = brute.components({i: t for i, t, _ in rows}, size, num, den)
    assert len(got) == len(rows)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, n, c) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(want)


def test_ngram_join_edges(awkward, nothing):
    assert ngram_jaccard_components(nothing).count() == 0
    rows = ngram_jaccard_components(awkward).collect()
    assert len(rows) == len(ROWS)
    assert all(r.component_id is None for r in rows if r.doc_id is None)


def test_repeats(spark):
    rows = sorted({(i, t) for i, t, _ in ROWS if i is not None} | {(i, t) for i, t, _ in near(spark)}, key=lambda r: r[0])
    rows = [(i, t[:40_000] if t else t) for i, t in rows] + [(900, "ab" * 400), (901, "z" + "ab" * 200), (902, LINE * 3)]
    got = remove_repeats(frame(spark, [(i, t, "s") for i, t in rows]), digest=True)
    assert sorted(tuple(r) for r in got.collect()) == brute.removed(rows, 100)


def test_repeats_edges(awkward, nothing):
    assert remove_repeats(nothing).count() == 0
    rows = remove_repeats(awkward).collect()
    assert len(rows) == len(ROWS)
    again = [r for r in rows if r.doc_id == 10]
    assert len(again) == 2 and again[0] == again[1]
    assert {r.n_removed for r in rows if r.doc_id == 7} == {len(LINE)}  # the row without an id comes first


def test_secrets(awkward, nothing):
    assert secret_report(nothing).count() == 0
    rows = secret_report(awkward).collect()
    assert len(rows) == len(ROWS)
    for i, t, _ in ROWS:
        got = {(r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in rows if r.doc_id == i}
        assert brute.base_secrets(t) in got
    clean = {r.doc_id: r.text for r in redacted(awkward).collect()}
    assert "qx7Lm2Zp9Rt4Vb" not in clean[15] and clean[7] == LINE and "hunter2" in clean[16]
    assert redacted(awkward).columns == awkward.columns


def test_secrets_by_ownership(spark):
    rows = [(i, f"key ghp_{'A1b2' * 9} end", f"s{i}") for i in range(5)] + [(9, f"ghp_{'Zz99' * 9}", "solo")]
    got = {r.doc_id: r.spans for r in secret_report(frame(spark, rows)).collect()}
    assert got[0] == "" and got[9].startswith("github:0:")


def test_many_secrets_in_one_text(spark):
    """Time in proportion to the matches, and every place right."""
    import time

    text = "\n".join(f"é token = k{i:05d}Zq{i * 7919 % 99991:05d}" for i in range(40_000))
    began = time.perf_counter()
    rows = frame(spark, [(1, text, "a"), (2, "x", "b")])
    got = {r.doc_id: r for r in secret_report(rows).collect()}
    assert got[1].n_assign == 40_000 and (got[1].n_assign, got[1].n_access, got[1].n_hex, got[1].base_sha256) == brute.base_secrets(text)
    clean = {r.doc_id: r.text for r in redacted(rows).collect()}
    assert clean[1] == "\n".join(["é [REDACTED]"] * 40_000) and clean[2] == "x"
    assert time.perf_counter() - began < 60


def test_private_key_blocks(spark):
    body = {k: [brute.sha(f"{k}{i}")[:64].upper().replace("A", "a/") for i in range(5)] + [f"{k}Q=="] for k in "abcdefg"}
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    block = lambda k, sep="\n": sep.join([head, *body[k], end])
    cut = "\n".join([head, *body["d"]])
    rows = [
        (1, f"x {block('a')} y", "s1"), (2, f"x {block('b')} y", "s2"),
        (3, block("c"), "s3"), (4, block("c", "\r\n  "), "s4"), (5, f"k = '{block('c', chr(92) + 'n')}'", "s5"),  # one key, copied
        (6, f"{cut}\n\nprose goes on, see {block('e')} end", "s6"),
        (7, f"say {head} in a text", "s7"), (8, f"{head} here too", "s8"),
        (9, f"{head}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n" + "\n".join(body["f"]), "s9"),
        (10, f"{head} {' '.join(body['g'])} and prose - with ----- marks", "s10"),
        (11, f"{head}\nxXxX{''.join(body['a'])}\n{end}", "s11"), (12, f"{head}\nyour-key-here\n{end}", "s12"),
        (13, head + "\n" + "- a - b " * 30_000, "s13"), (14, head + "\n" + "qR7/" * 100_000 + "\n" + end, "s14"),
    ]
    clean = {r.doc_id: r.text for r in redacted(frame(spark, rows)).collect()}
    mark = "[REDACTED]"
    assert clean[1] == clean[2] == f"x {mark} y"
    assert [clean[i] for i in (3, 4, 5, 7, 8, 12)] == [rows[i - 1][1] for i in (3, 4, 5, 7, 8, 12)]
    assert clean[6] == f"{mark}\n\nprose goes on, see {mark} end"
    assert clean[9] == mark and clean[10] == f"{mark} and prose - with ----- marks" and clean[11] == clean[14] == mark
    spans = {r.doc_id: r.spans for r in secret_report(frame(spark, rows)).collect()}
    assert spans[1] == f"pem:2:{2 + len(block('a'))}"


def test_licenses(awkward, nothing):
    assert scan_licenses(nothing).count() == 0
    rows = scan_licenses(awkward).collect()
    assert len(rows) == len(ROWS)
    for i, t, _ in ROWS:
        got = [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows if r.doc_id == i]
        assert brute.base_licenses(t) in got
    assert [r.labels for r in rows if r.doc_id == 17] == ["apache,cc-by,mit"]


def test_license_templates_line_up(spark):
    text = "x y Permission is hereby granted, free of charge, to any person obtaining a copy of this software z"
    row = scan_licenses(frame(spark, [(1, text, "a"), (2, "granted software hereby charge", "a")])).collect()
    assert [(r.base_labels, r.labels) for r in sorted(row)] == [("", "mit"), ("", "")]
    assert sorted(row)[0].score == 1.0
    plain = scan_licenses(frame(spark, [(1, "Apache\u212aLicense \u0130 MIT licenSe", "a")])).collect()[0]
    assert (plain.n_words, plain.base_labels) == brute.base_licenses("Apache\u212aLicense \u0130 MIT licenSe")[::4] == (4, "mit")


def test_every_license_template_is_found(spark):
    """Alone, all in one text, and in a very long one."""
    rows = [(i, f"some prose {text.upper()} more prose", "a") for i, (_, text, _) in enumerate(TEMPLATES)]
    every = " and then other words stand here ".join(text for _, text, _ in TEMPLATES)
    rows += [(100, every, "a"), (101, "word filler " * 50_000 + every + " free software" * 30_000, "a")]
    got = {r.doc_id: set(r.labels.split(",")) for r in scan_licenses(frame(spark, rows)).collect()}
    assert all(label in got[i] for i, (label, _, _) in enumerate(TEMPLATES))
    assert got[100] == got[101] == {label for label, _, _ in TEMPLATES}

def test_license_notices_together(spark):
    from itertools import combinations

    notices = {label: text for label, text, _ in TEMPLATES if label in ("lgpl", "bsd", "mpl", "isc", "unlicense")}
    sets = [c for n in (2, 3, 5) for c in combinations(sorted(notices), n)]
    rows = [(i, " prose ".join(notices[x] for x in c) + " granted hereby charge lesser modification attribution" * 3, "a") for i, c in enumerate(sets)]
    got = {r.doc_id: r.labels for r in scan_licenses(frame(spark, rows)).collect()}
    assert got == {i: ",".join(c) for i, c in enumerate(sets)}


def test_quality(awkward, nothing):
    assert quality_report(nothing).count() == 0
    assert quality_filter(nothing).count() == 0
    rows = quality_report(awkward).collect()
    assert len(rows) == len(ROWS)
    for i, t, _ in ROWS:
        got = [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows if r.doc_id == i]
        assert brute.quality(t) in got
    kept = sorted(r.doc_id for r in rows if r.kept)
    assert kept == sorted(r.doc_id for r in quality_filter(awkward).collect()) == [11, 12]


def test_exact(awkward, nothing):
    assert exact_groups(nothing).count() == 0 and without_copies(nothing).count() == 0
    rows = exact_groups(awkward, keep="largest").collect()
    assert len(rows) == len(ROWS)
    by_text = {}
    for i, t, _ in ROWS:
        by_text.setdefault(t or "", []).append(i)
    for text, ids in by_text.items():
        mine = [r for r in rows if r.text_sha256 == brute.sha(text)]
        best = max((i for i in ids if i is not None), default=None)
        assert len(mine) == len(ids) and sum(r.kept for r in mine) == 1
        assert {(r.keep_id, r.group_size) for r in mine} == {(best, len(ids))}
        assert [r.doc_id for r in mine if r.kept] == [best]
    left = without_copies(awkward)
    assert left.columns == awkward.columns
    assert sorted((r.text or "") for r in left.collect()) == sorted(by_text)


def test_stages_with_clashing_names(spark):
    """Columns named like those operators use inside; nulls, copies and empty tables through every stage."""
    import corpus_pipeline

    names = "doc_id long, text string, lang string, source string, n_chars long, _id long, row long, h128 string, secret_id long, same_text string, kept_row int, set_key string"
    rows = [(i, t, "en", s, len(t or ""), 1, 2, "h", 3, "t", 4, "k") for i, t, s in ROWS]
    for given in (rows, []):
        docs = spark.createDataFrame(given, names)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            assert out.count() <= len(given), name
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(given)


def test_exact_null_stays_null(spark):
    left = without_copies(frame(spark, [(2, "", "a"), (1, None, "a"), (3, None, "b"), (4, "x", "c"), (4, "x", "c")]))
    assert sorted((r.doc_id, r.text, r.source) for r in left.collect()) == [(1, None, "a"), (4, "x", "c")]
    with pytest.raises(ValueError):
        without_copies(left, keep="first")


def test_repeats_in_crowded_triggers(spark):
    """One passage between ever new contexts: the two ways of ordering a dictionary agree."""
    rows = [(i, f"left{i * 7919} {LINE} right{i * 104729 % 9973}", "s") for i in range(60)] + [(900, "ab" * 400, "s"), (901, LINE * 3, "s")]
    want = brute.removed([(i, t) for i, t, _ in rows], 100)
    for hot in (4096, 5, 1):
        assert sorted(tuple(r) for r in remove_repeats(frame(spark, rows), digest=True, hot=hot).collect()) == want


def test_crowded_phrases_are_not_dealt_out_by_window(spark, monkeypatch):
    """No step makes a row for each window of a crowded trigger's phrases: a round cuts a phrase in two at most."""
    from tessera.llm import repeats

    made, keep = [], repeats.materialize
    monkeypatch.setattr(repeats, "materialize", lambda df, label: made.append((label, keep(df, label))) or made[-1][1])
    rng = np.random.default_rng(5)
    alike = ["".join(map(chr, rng.integers(97, 123, 120))) for _ in range(3)]
    rows = [(i, f"{alike[i % 3][i % 40 :]} {LINE} {alike[i % 2][: i % 45]}#{i}", "s") for i in range(300)]
    got = repeats.remove_repeats(frame(spark, rows), digest=True, hot=8)
    assert sorted(tuple(r) for r in got.collect()) == brute.removed([(i, t) for i, t, _ in rows], 100)
    phrases = next(df.count() for label, df in made if label == "phrases")
    tables = {label: df.count() for label, df in made if label not in ("phrases", "dictionary")}
    assert max(tables.values()) <= 2 * phrases, (phrases, tables)


def test_repeats_across_chunks(spark):
    """A text longer than the piece that is hashed at once, with a repeat over its edge."""
    from tessera.llm import repeats

    rng = np.random.default_rng(2)
    body = "".join(map(chr, rng.integers(97, 123, repeats.CHUNK + 5_000)))
    text = body + "#" + body[repeats.CHUNK - 300 : repeats.CHUNK + 300] + "#"
    row = remove_repeats(frame(spark, [(1, text, "s")])).collect()[0]
    assert (row.n_removed, [tuple(s) for s in row.spans]) == (600, [(len(body) + 1, len(body) + 601)])


def test_suffix_ranks():
    from tessera.llm.repeats import ranks

    rng = np.random.default_rng(4)
    for length in (1, 5, 8, 20, 30, 100):
        data = rng.integers(0, 2, 400).astype(np.uint8) + 1
        whole = bytes(data) + b"\0" * length
        keys = [whole[i : i + length] for i in range(len(data))]
        order = {k: i + 1 for i, k in enumerate(sorted(set(keys)))}
        assert ranks(data, length).tolist() == [order[k] for k in keys]


def test_bpe(awkward, nothing, spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert encode_documents(nothing, path, digest=True).count() == 0
    extra = ["it's <|endoftext|>x", "#'s 'll don't", "áb\u0085c​d İ K Σς", "A1b2_c-d.e,f"]
    docs = awkward.unionByName(frame(spark, [(1000 + i, t, "s") for i, t in enumerate(extra)]))
    rows = encode_documents(docs, path, digest=True).collect()
    texts = [(i, t) for i, t, _ in ROWS] + [(1000 + i, t) for i, t in enumerate(extra)]
    assert len(rows) == len(texts)
    for i, t in texts:
        assert brute.bpe(library, t) in [tuple(r)[1:] for r in rows if r.doc_id == i]
    plain = {r.doc_id: r for r in encode_documents(docs, path).collect()}
    assert plain[4].ids == library.encode("one", add_special_tokens=False).ids and plain[1].decoded == ""


def test_bpe_of_other_files(spark):
    """A file the fragments are not proven for goes through the library as a whole."""
    import json

    from tokenizers import Tokenizer

    from tessera.llm.bpe import fits

    path = tokenizer_file("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        assert not fits(json.load(f))
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        assert fits(json.load(f))
    texts = [" two  blanks", "A\n\nb C'll", ""]
    got = {r.doc_id: (r.ids, r.decoded) for r in encode_documents(frame(spark, [(i, t, "s") for i, t in enumerate(texts)]), path).collect()}
    library = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[i] == (ids, library.decode(ids, skip_special_tokens=False))


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|> <<|<\\\\|", "", None, "\n\n x 😀é́ ", "<", "|im_end|>", "plain"]
    rows = [(c, k, r, t, 1) for c in (1, 2) for k, (r, t) in enumerate((r, t) for t in hard for r in ("user", "assistant", None))]
    rows += [(None, 0, "assistant", "lost", 1), (3, 0, "assistant", "tie b", 1), (3, 0, "assistant", "tie a", 1), (3, 0, "assistant", "tie a", 1)]
    frame_ = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns int")
    got = {r.conv_id: tuple(r)[1:5] for r in chat.format_conversations(frame_, tokenizer_file("byte_bpe_50k.json"), digest=True).collect()}
    assert got.keys() == {1, 2, 3, None}
    assert got[1] == got[2] == brute.chat([(r, t) for t in hard for r in ("user", "assistant", None)])
    assert got[3] == brute.chat([("assistant", "tie a")] * 2 + [("assistant", "tie b")])
    assert got[None] == brute.chat([("assistant", "lost")])
    assert chat.format_conversations(frame_.limit(0), tokenizer_file("byte_bpe_50k.json")).count() == 0


def test_chat_mask_and_blocks(monkeypatch):
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        formatter = chat.ChatFormatter(f.read())
    turns = [("user", "hi there"), ("assistant", "héllo 😀 wörld"), ("user", "x"), ("assistant", "bye")] * 5
    whole = formatter.format(turns)
    assert "".join(whole.loss_texts()) == "".join(t for r, t in turns if r == "assistant")
    monkeypatch.setattr(chat, "BLOCK", 50)
    parts = formatter.format(turns)
    assert np.array_equal(whole.ids, parts.ids) and np.array_equal(whole.mask, parts.mask) and np.array_equal(whole.starts, parts.starts)


def test_packing_boundaries():
    rng = np.random.default_rng(1)

    def padding(lengths, counts, ends):
        return sum(c * (min(e for e in ends if e >= n) - n) for n, c in zip(lengths, counts))

    from itertools import combinations

    for _ in range(60):
        n = int(rng.integers(1, 9))
        lengths = sorted(rng.choice(np.arange(1, 60), n, replace=False).tolist())
        counts = rng.integers(1, 9, n).tolist()
        for k in (1, 2, 3, 4):
            ends = packing.optimal_boundaries(lengths, counts, k)
            best = min(padding(lengths, counts, [*c, lengths[-1]]) for j in range(min(k, n)) for c in combinations(lengths[:-1], j))
            assert len(ends) <= k and padding(lengths, counts, ends) == best
    assert packing.optimal_boundaries([], [], 4) == []


def test_packing(awkward, nothing):
    path = tokenizer_file("byte_bpe_50k.tiktoken")
    assert packing.pack_documents(nothing, path).count() == 0
    rows = packing.pack_documents(awkward, path, budget=4096, shard_rows=3).collect()
    assert len(rows) == len(ROWS)
    batches = {}
    for r in rows:
        assert r.n_tokens <= r.padded_length or r.n_tokens == 0
        batches.setdefault(r.batch, []).append(r)
    last = {}
    for members in batches.values():
        assert sorted(r.slot for r in members) == list(range(len(members)))
        room = max(4096 // members[0].padded_length, 1)
        assert len(members) <= room and len({(r.bucket, r.padded_length) for r in members}) == 1
        last.setdefault(members[0].bucket, []).append(len(members) < room)
    assert all(sum(x) <= 1 for b, x in last.items() if b >= 0)


def test_packing_counts_whole_texts(spark, small):
    """Token counts are those of the library for each text in one piece."""
    import base64

    import public_tokenizers
    import pyarrow.parquet as pq
    import tiktoken

    with open(tokenizer_file("byte_bpe_50k.tiktoken"), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}
    assert packing.PATTERN == public_tokenizers.PATTERN
    library = tiktoken.Encoding("test", pat_str=packing.PATTERN, mergeable_ranks=table, special_tokens={})
    texts = [r["text"] for r in pq.read_table(f"{small}/documents.parquet", columns=["text"]).to_pylist()]
    texts += [" a", "a ", "a  b", "a\u00a0 b", "a \u3000b", "it 's it's", "1 2  3\x1c 4", "\n x\t y \n", "\u200b \u200b", "", None, "a\x85 b", "e \u0301x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_lengths(rows, tokenizer_file("byte_bpe_50k.tiktoken")).collect()}
    assert got == {i: len(library.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def kernel(s, t):
    """Subsequence kernel of three letters by enumeration."""
    from itertools import combinations

    def features(x):
        out = {}
        for c in combinations(range(len(x)), 3):
            if c[2] - c[0] < toxicity.SPAN:
                key = tuple(x[i] for i in c)
                out[key] = out.get(key, 0) + toxicity.DECAY ** (c[2] - c[0] + 1)
        return out

    a, b = features(s), features(t)
    dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
    return dot(a, b) / ((dot(a, a) * dot(b, b)) ** 0.5 or 1)


def test_kernel():
    words = ["idiot", "idxiot", "banana", "ab", "aaaaaa", "scum"]
    words += ["\u0430\u0431\u0432\u0433", "\u0435\u0436\u0437\u0438"]
    space = toxicity.Space(words)
    got = space.kernel(words, space.dense(words))
    want = [[kernel(s, t) for t in words] for s in words]
    assert np.allclose(got, want, atol=1e-5)
    few = toxicity.Space(words[:3])  # letters of the others are unknown to it
    assert np.allclose(few.kernel(words, few.dense(words[:3])), [r[:3] for r in want], atol=1e-5)
    sparse = toxicity.Space(words)
    sparse.table = None
    assert np.allclose(sparse.kernel(words, sparse.dense(words)), want, atol=1e-5)


def test_toxicity_letters_and_labels():
    """Letters beyond a-z are told apart, marks do not hide a word, one wrong label clears none."""
    rng = np.random.default_rng(8)
    good = ["\u0441\u043b\u043e\u0432\u043e", "\u0434\u043e\u043c", "table", "window", "fenster", "stra\u00dfe", "garten"]
    rows = [[str(w) for w in rng.choice(good, 30)] for _ in range(120)]
    bad = ["\u0431\u043e\u043b\u0432\u0430\u043d", "scumbag"]
    for i in range(0, 120, 3):
        rows[i][int(rng.integers(30))] = bad[i % 2]
    rows[1][3] = bad[1]  # a clean text that quotes an insult
    model = toxicity.train([" ".join(w) for w in rows], [int(i % 3 == 0) for i in range(120)])
    probe = lambda w: float(model.probability(toxicity.evidence(model, [toxicity.tokens(w)], {}))[0])
    assert probe(bad[0]) > 0.7 > probe("".join(chr(ord(c) + 5) for c in bad[0])) and probe("table/scumbag/window") > 0.7 > probe("table/garten/window")


def test_toxicity(spark, nothing, awkward):
    rng = np.random.default_rng(3)
    syllables = ["an", "the", "or", "in", "re", "st", "ou", "ha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    bad = ["idiot", "moron", "scumbag"]
    texts, labels = [], []
    for i in range(240):
        w = [word() for _ in range(40)]
        if i % 3 == 0:
            for b in rng.choice(bad, 2):
                w.insert(int(rng.integers(len(w))), str(b))
        texts.append(" ".join(w))
        labels.append(int(i % 3 == 0))
    model = toxicity.train(texts[:160], labels[:160])
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts[160:])])
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(x) for i, x in enumerate(labels[160:]))
    probe = lambda w: float(model.probability(toxicity.evidence(model, [toxicity.tokens(w)], {}))[0])
    assert probe("you i d i o t you") > 0.7 and probe("an id*iot") > 0.7 and probe("idxiot") > 10 * probe("anther")
    edge = toxicity.score_toxicity(awkward, model).collect()
    assert len(edge) == len(ROWS) and all(0 <= r.score <= 1 for r in edge)
    assert toxicity.score_toxicity(nothing, model).count() == 0
    assert toxicity.train(["a b"], [0]).probability(np.zeros((1, toxicity.TOP + 1)))[0] < 0.5


def test_toxicity_in_long_tokens():
    rng = np.random.default_rng(5)
    syllables = ["an", "the", "or", "in", "re", "st", "ou", "ha"]
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 4)))
    rows = [[word() for _ in range(40)] for _ in range(160)]
    for i in range(0, 160, 3):
        rows[i].insert(20, ["idiot", "moron", "scumbag"][i % 9 // 3])
    model = toxicity.train([" ".join(w) for w in rows], [int(i % 3 == 0) for i in range(160)])
    probe = lambda w: float(model.probability(toxicity.evidence(model, [toxicity.tokens(w)], {}))[0])
    clean = [word() for _ in range(100)]
    for mark in (".", "/", ",", "_", ""):
        for at in (30, 50, 71):
            assert probe(mark.join(clean[:at] + ["idiot"] + clean[at:])) > 0.7
        assert probe(mark.join(clean)) < 0.7
    assert probe("\u6f22\u5b57" * 300 + "scumbag" + "\u6f22\u5b57" * 301) > 0.7 > probe("\u6f22\u5b57" * 600)
    run = "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 500)))
    for k in (6, 18, 40, 72):  # whole in some window, wherever it stands
        assert all(any(run[a : a + k] in w for w in toxicity.units(run)) for a in range(len(run) - k + 1))

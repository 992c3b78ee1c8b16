"""BPE encoding and decoding with forced-boundary splitting.

A merge can only ever join two symbols whose touching bytes stand side by side
inside some vocabulary token. A byte pair that stands in no token is therefore
a certain cut: the pieces on both sides are encoded independently and their
ids concatenated. Blanks are such cuts in the text itself, so a text falls
into fragments that repeat across the corpus; each worker encodes a distinct
fragment once. Inside a fragment the tokenizer file's normaliser and
pre-tokenizer give words, which are cut again at impossible pairs before
merges run on the short pieces.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_ids_of, _tokens_of = itemgetter(0), itemgetter(1)

# An ASCII letter beside other ASCII, but for the apostrophe of contractions: never one token, never composed.
_cut = re.compile(rb"(?<=[A-Za-z])(?=[!-&(-@\[-`{-~])|(?<=[!-&(-@\[-`{-~])(?=[A-Za-z])")


# Words whose normal form is plain lower case: letters of one code point, nothing composes with them.
_plain = re.compile(r"[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0132-\u024F]+")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


# Fixed value: the word pattern that the cuts are proven for.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def fits(spec: dict) -> bool:
    """Whether a ``tokenizers`` file has the parts the fragment encoder is proven for.

    It cuts texts at blanks and between ASCII letters and marks, lower-cases
    plain words itself and reads the decoded text off the tokens. That holds
    for a byte-level BPE vocabulary whose words end in a suffix and never hold
    blanks, whose normaliser lower-cases and folds white space, and whose added
    tokens are taken literally.
    """
    model, pre, normal = spec.get("model") or {}, spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
    steps = normal.get("normalizers") or [normal]
    parts = pre.get("pretokenizers") or [pre]
    return (
        model.get("type") == "BPE"
        and bool(model.get("end_of_word_suffix"))
        and not model.get("continuing_subword_prefix")
        and not model.get("byte_fallback")
        and not model.get("ignore_merges")
        and not model.get("dropout")
        and {x.get("type") for x in steps} == {"NFC", "Replace", "Lowercase"}
        and len(parts) == 2
        and parts[0].get("pattern") == {"Regex": WORD_PATTERN}
        and parts[-1].get("type") == "ByteLevel"
        and not parts[-1].get("add_prefix_space")
        and (spec.get("decoder") or {}).get("type") is None
        and all(not t.get("normalized") and not t.get("single_word") and not t.get("lstrip") and not t.get("rstrip") and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens", ()))
    )


class LibraryBPE:
    """Whole texts through the library, for files the fragment encoder is not proven for."""

    def __init__(self, spec_json: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec_json)
        self.library.no_truncation()
        self.library.no_padding()

    def encode_batch(self, texts: list[bytes]) -> Iterator[tuple[bytes, str]]:
        for text in texts:
            ids = self.library.encode(text.decode("utf-8"), add_special_tokens=False).ids
            yield np.array(ids, dtype="<u4").tobytes(), self.library.decode(ids, skip_special_tokens=False)


class ForcedBoundaryBPE:
    """Encoder of one byte-level ``tokenizers`` file with a BPE model."""

    def __init__(self, spec_json: str, cache_limit: int = 400_000):
        from tokenizers import Tokenizer, pre_tokenizers

        spec = json.loads(spec_json)
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.library = Tokenizer.from_str(spec_json)
        self.library.no_truncation()
        self.library.no_padding()
        self.suffix = spec["model"]["end_of_word_suffix"] or ""
        self.added = [t["content"].encode() for t in spec["added_tokens"]]
        # Merges alone, over blank-separated pieces: for the last piece of a word, and for those another follows.
        self.last, self.inner = Tokenizer(self.library.model), None
        self.last.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._inner_spec = spec
        symbols = byte_symbols()
        self.bytes_of = place = {c: b for b, c in symbols.items()}
        self.symbols = symbols | {32: " "}  # a blank stands between words here
        self.pairs = np.zeros((256, 256), dtype=bool)
        for token in vocab:
            inside = [place[c] for c in token.removesuffix(self.suffix)]
            self.pairs[inside[:-1], inside[1:]] = True
        self.pairs[32], self.pairs[:, 32] = True, True  # blanks between words are cut already
        self.limit, self.cache = cache_limit, {}

    def _merge(self, tokenizer, pieces: list[bytes]) -> list[tuple[bytes, str]]:
        """Packed ids and joined tokens of each piece; pieces go through the library many at a time."""
        if not pieces:
            return []
        made = tokenizer.encode(b" ".join(pieces).decode("latin-1").translate(self.symbols), add_special_tokens=False)
        packed, tokens = np.array(made.ids, dtype="<u4").tobytes(), made.tokens
        ends = np.searchsorted(np.array(made.word_ids), np.arange(1, len(pieces) + 1)).tolist()
        return [(packed[4 * a : 4 * b], " ".join(tokens[a:b])) for a, b in zip([0, *ends], ends, strict=False)]

    def words_made(self, words: list[bytes]) -> list[tuple[bytes, str]]:
        """(packed ids, joined tokens) of words given as normalised bytes, cut at impossible pairs."""
        if not words:
            return []
        flat = np.frombuffer(b" ".join(words), dtype=np.uint8)
        at = np.flatnonzero(~self.pairs[flat[:-1], flat[1:]]) + 1
        begin = np.cumsum([0, *(len(w) + 1 for w in words[:-1])])
        owner = np.searchsorted(begin, at, side="right") - 1
        cuts: dict[int, list[int]] = {}
        for w, i in zip(owner.tolist(), (at - begin[owner]).tolist(), strict=True):
            cuts.setdefault(w, []).append(i)
        ends, before = list(words), {}
        for w, places in cuts.items():
            before[w] = [words[w][i:j] for i, j in zip([0, *places], places, strict=False)]
            ends[w] = words[w][places[-1] :]
        out = self._merge(self.last, ends)
        if before:
            if self.inner is None:
                from tokenizers import Tokenizer, models, pre_tokenizers

                model = self._inner_spec["model"]
                merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
                self.inner = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges))
                self.inner.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            single = list({piece for parts in before.values() for piece in parts})
            known = dict(zip(single, self._merge(self.inner, single), strict=True))
            for w, parts in before.items():
                out[w] = _chained([*map(known.__getitem__, parts), out[w]])
        return out

    def _words(self, raw: bytes) -> list[bytes]:
        """Normalised words of a fragment without control strings."""
        if raw.isalpha():
            return [raw.lower()]
        text = raw.decode("utf-8")
        if _plain.fullmatch(text):
            return [text.lower().encode()]
        normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
        return [bytes(map(self.bytes_of.__getitem__, word)) for word, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def learn(self, fragments: set[bytes]) -> None:
        """Puts (packed ids, tokens joined by blanks) of unknown fragments into the cache."""
        cache = self.cache
        common = os.path.commonprefix(self.added)  # a quick look before the exact one
        split, fresh = [], set()
        for raw in fragments:
            if raw.isalpha():
                fresh.add(raw)
            elif common in raw and any(a in raw for a in self.added):  # control strings are the library's to find
                made = self.library.encode(raw.decode("utf-8"), add_special_tokens=False)
                cache[raw] = (np.array(made.ids, dtype="<u4").tobytes(), " ".join(made.tokens))
            else:
                parts = _cut.split(raw)
                fresh.update(parts)
                if len(parts) > 1:
                    split.append((raw, parts))
        fresh = list(fresh.difference(cache))
        words = list(map(self._words, fresh))
        made = iter(self.words_made([w for ws in words for w in ws]))
        for part, ws in zip(fresh, words, strict=True):
            cache[part] = next(made) if len(ws) == 1 else _chained([next(made) for _ in ws])
        for raw, parts in split:
            cache[raw] = _chained([cache[p] for p in parts])

    def encode_batch(self, texts: list[bytes]) -> Iterator[tuple[bytes, str]]:
        """Ids and decoded text of each whole text, fragment by fragment."""
        for a in range(0, len(texts), 400):
            listed = [t.split() for t in texts[a : a + 400]]
            every = set().union(*listed)
            if len(self.cache) > self.limit:  # emptied between blocks only, so a block finds all of its own
                self.cache.clear()
            fresh = every.difference(self.cache)
            if fresh:
                self.learn(fresh)
            for fragments in listed:
                yield _chained([*map(self.cache.__getitem__, fragments)])


def _chained(made: list[tuple[bytes, str]]) -> tuple[bytes, str]:
    return b"".join(map(_ids_of, made)), " ".join(filter(None, map(_tokens_of, made)))


def _encoded(batches: Iterator[pa.RecordBatch], spec: str, digest: bool) -> Iterator[pa.RecordBatch]:
    bpe = (ForcedBoundaryBPE if fits(json.loads(spec)) else LibraryBPE)(spec)
    for batch in batches:
        made = bpe.encode_batch([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
        if digest:
            rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) for ids, text in made]
            kinds, names = (pa.int64(), pa.string(), pa.string()), ("n_tokens", "ids_sha256", "decoded_sha256")
        else:
            rows = [(np.frombuffer(ids, dtype="<u4").tolist(), text) for ids, text in made]
            kinds, names = (pa.list_(pa.int64()), pa.string()), ("ids", "decoded")
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *names])


def encode_documents(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """``doc_id, ids, decoded`` per input row; with ``digest``, counts and SHA-256 instead.

    ``tokenizer`` is the path of the file on the driver; its bytes travel with
    the tasks, so executors need no copy. Texts that hold a control string are
    cut at blanks like all others and those fragments go through the library.
    Texts of any length are encoded whole. Files the fragments are not proven
    for (see ``fits``) are encoded by the library alone, with the same result.
    Null and empty texts have no ids and decode to the empty string. Null ids
    and repeated rows pass through; other columns are not read.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = documents.sparkSession.sparkContext.broadcast(f.read())
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<bigint>, decoded string"
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _encoded(it, spec.value, digest), f"doc_id {kind}, {made}")

"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and its loss mask
comes from intersecting the sorted spans of the assistant turns with the
tokens' spans by binary search. The turn marks are control tokens of the
tokenizer, so no token can straddle a mark and a text.

Template per turn: ``<|im_start|>role<|im_sep|>text<|im_end|>\\n``. Inside roles
and texts every ``<`` that runs into ``|`` over backslashes gets one more
backslash (``<|`` becomes ``<\\|``, ``<\\|`` becomes ``<\\\\|``), which taking one
away undoes, so no text can contain a mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
BLOCK = 1_000_000  # characters encoded at once; cut between turns only

_to_escape = re.compile(r"<(?=\\*\|)")
_escaped = re.compile(r"<\\(?=\\*\|)")
_turn = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)


def escape(text: str) -> str:
    return _to_escape.sub(r"<\\", text)


def unescape(text: str) -> str:
    return _escaped.sub("<", text)


@dataclass
class Formatted:
    """A rendered conversation, its tokens and the mask over them."""

    text: str
    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    mask: np.ndarray

    def turns(self) -> list[tuple[str, str]]:
        """Roles and texts read back from the rendering."""
        return [(unescape(r), unescape(t)) for r, t in _turn.findall(self.text)]

    def loss_texts(self) -> list[str]:
        """The unescaped text under each run of masked tokens."""
        out, at = [], np.flatnonzero(self.mask)
        if len(at):
            cut = np.flatnonzero(self.starts[at[1:]] > np.maximum.accumulate(self.ends[at])[:-1])
            for run in np.split(at, cut + 1):
                out.append(unescape(self.text[self.starts[run[0]] : self.ends[run].max()]))
        return out


def masked_tokens(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap one of the sorted, disjoint ``spans``; empty tokens never do."""
    if not len(spans) or not len(starts):
        return np.zeros(len(starts), dtype=bool)
    k = np.searchsorted(spans[:, 0], ends, side="left") - 1  # last span that begins before the token ends
    return (k >= 0) & (starts < spans[np.maximum(k, 0), 1]) & (ends > starts)


class ChatFormatter:
    """Renders, encodes and masks conversations with one ``tokenizers`` file."""

    def __init__(self, spec: str, learn_roles: tuple[str, ...] = ("assistant",)):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.add_special_tokens([START, SEP, END])
        self.roles = set(learn_roles)

    def format(self, turns: list[tuple[str, str]]) -> Formatted:
        parts, spans, blocks, at, begun = [], [], [], 0, 0
        for role, text in turns:
            head, body = f"{START}{escape(role)}{SEP}", escape(text)
            if role in self.roles and body:
                spans.append((at + len(head), at + len(head) + len(body)))
            parts.append(f"{head}{body}{END}\n")
            at += len(parts[-1])
            if at - begun >= BLOCK:
                blocks.append((begun, at))
                begun = at
        blocks += [(begun, at)] if at > begun else []
        whole = "".join(parts)
        ids, starts, ends = [], [], []
        for a, b in blocks:
            e = self.tokenizer.encode(whole[a:b], add_special_tokens=False)
            offsets = np.array(e.offsets, dtype=np.int64).reshape(-1, 2) + a
            ids.append(np.array(e.ids, dtype=np.int64))
            starts.append(offsets[:, 0])
            ends.append(offsets[:, 1])
        join = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
        starts, ends = join(starts), join(ends)
        mask = masked_tokens(starts, ends, np.array(spans, dtype=np.int64).reshape(-1, 2))
        return Formatted(whole, join(ids), starts, ends, mask)


def _digest_row(f: Formatted) -> tuple:
    turns, loss = f.turns(), "".join(f.loss_texts())
    turn_hash = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), turn_hash, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(f.text), len(f.ids), int(f.mask.sum())


def _formatted(batches: Iterator[pa.RecordBatch], spec: str, digest: bool) -> Iterator[pa.RecordBatch]:
    formatter = ChatFormatter(spec)
    for batch in batches:
        made = [formatter.format([(t["role"] or "", t["text"] or "") for t in turns]) for turns in batch.column(1).to_pylist()]
        if digest:
            rows = list(zip(*map(_digest_row, made), strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "n_loss_tokens"]
            columns = [pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]
        else:
            names = ["formatted", "ids", "loss_mask"]
            columns = [pa.array([f.text for f in made], pa.string()), pa.array([f.ids for f in made], pa.list_(pa.int64())), pa.array([f.mask for f in made], pa.list_(pa.bool_()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv_id", *names])


def format_conversations(conversations: DataFrame, tokenizer: str, *, digest: bool = False) -> DataFrame:
    """One row per ``conv_id``: rendering, token ids and mask, or their counts and digests.

    Turns are ordered by ``turn`` (null first), then role and text, so ties and
    repeated rows have a fixed order and all stay. Null roles and texts are
    empty; rows with a null ``conv_id`` form one conversation. An assistant
    turn with an empty text has no loss text. Texts of any length are rendered
    and encoded whole, long conversations block by block. An empty table gives
    no rows.
    Columns other than conv_id, turn, role and text are not read.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = conversations.sparkSession.sparkContext.broadcast(f.read())
    turn = F.struct("turn", "role", "text")
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    made = "formatted string, ids array<bigint>, loss_mask array<boolean>"
    if digest:
        made = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
    return rows.mapInArrow(lambda it: _formatted(it, spec.value, digest), f"conv_id {kind}, {made}")

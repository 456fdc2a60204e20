"""Encoding texts with a byte-level BPE vocabulary by a tokenization automaton.

The merges are compiled, in order, into a deterministic automaton over tokens that accepts exactly the correct
encodings.  It starts with one state that has an arc to itself for every byte.  The gadget of a merge
``u v -> w`` gives every state with an arc ``u`` an arc ``w`` to where ``v`` leads, and leads ``u`` to a copy of
its target without the arc ``v``, so ``u`` then ``v`` is no longer accepted.  All arcs of a token lead to one
state, so a state is its token; states are kept copy-on-write, as the merge that took an arc away.  Of each
prefix of a word exactly one token sequence is accepted, so a forward pass over the word's bytes needs to keep
one state a position.  Decoding emits the labels of the arcs.

Written out, the arcs of 50,257 states would be some 2.5e9, nearly all pairs of tokens, so those are kept as the times at which
merges gave and took them, and an arc is worked out when it is first followed.  The transitions over bytes are a
table: one goto and failure automaton of all labels, which yields at each byte the tokens that end there.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the pattern that splits a text before the merges of this vocabulary apply.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words kept encoded, and arcs kept looked up, in a worker.
KEEP, KEEP_ARCS = 300_000, 1_000_000
_NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The automaton of a list of merges; picklable, read only once compiled."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_letters()
        ids = {k: i for k, i in model["vocab"].items() if all(c in letters for c in k)}
        self.label = {i: bytes(letters[c] for c in k) for k, i in ids.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.taken: dict[tuple[int, int], int] = {}
        for time, (u, v) in enumerate(merges):
            self._gadget(ids[u], ids[v], ids[u + v], time)
        known = {i for i in self.label if len(self.label[i]) == 1} | set(self.born)
        self.ids = {self.label[i]: i for i in known}
        self._compile()
        self._arcs: dict[tuple[int, int], bool] = {}
        self._words: dict[str, tuple[int, ...]] = {}

    def _compile(self) -> None:
        """The table of transitions over bytes."""
        self._table = ahocorasick.Automaton()
        for label, i in self.ids.items():
            self._table.add_word(label.decode("latin-1"), (len(label), i))
        self._table.make_automaton()

    def _gadget(self, u: int, v: int, w: int, time: int) -> None:
        if w in self.born:
            return
        self.left[w], self.right[w], self.born[w] = u, v, time
        self.taken[u, v] = time  # the state of u loses the arc v; the state of w is that of v as it is now

    def _lost(self, state: int, token: int) -> int:
        """When the arc ``token`` was taken from the state; what its origins lost after the copy was made doesn't count."""
        until, when = _NEVER, _NEVER
        while True:
            t = self.taken.get((state, token), _NEVER)
            if t < until and t < when:
                when = t
            if state not in self.right:
                return when
            until = min(until, self.born[state])
            state = self.right[state]

    def accepts(self, state: int, token: int) -> bool:
        """Whether the state of one token has an arc for the other; found once, then looked up."""
        key = (state, token)
        ok = self._arcs.get(key)
        if ok is None:
            ok, part, needed = True, token, _NEVER
            while ok:
                # the arc of a merged token grew from its left part's, so that one had to be there then
                lost = self._lost(state, part)
                ok = lost > needed if needed != _NEVER else lost == _NEVER
                if part not in self.left:
                    break
                needed, part = self.born[part], self.left[part]
            self._arcs[key] = ok
        return ok

    def encode_word(self, data: bytes) -> tuple[int, ...]:
        whole = self.ids.get(data)
        if whole is not None:
            return (whole,)
        n = len(data)
        last = [-1] * (n + 1)
        accepts = self.accepts
        # of the tokens that end at a byte, exactly one follows the state before it
        for at, (size, token) in self._table.iter(data.decode("latin-1")):
            end = at + 1
            if last[end] < 0 and (size == end or accepts(last[end - size], token)):
                last[end] = token
        out = []
        while n:
            out.append(last[n])
            n -= len(self.label[last[n]])
        return tuple(out[::-1])

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for an empty or null one."""
        if not text:
            return []
        words, found = self._words, []
        for w in _split(text):
            ids = words.get(w)
            if ids is None:
                if len(words) >= KEEP:
                    words.clear()
                if len(self._arcs) >= KEEP_ARCS:
                    self._arcs.clear()
                ids = words[w] = self.encode_word(w.encode("utf-8", "replace"))
            found.append(ids)
        return list(chain.from_iterable(found))

    def decode(self, ids) -> str:
        """The text of ``ids``: the labels of the arcs, one after the other."""
        return b"".join(self.label[i] for i in ids).decode("utf-8", "replace")

    def __getstate__(self):
        return self.__dict__ | {"_arcs": {}, "_words": {}, "_table": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._compile()


_split = regex.compile(PATTERN).findall
_COMPILED: dict[str, Automaton] = {}


def automaton(path: str = TOKENIZER) -> Automaton:
    """The automaton of the vocabulary file, compiled once; executors are sent the compiled one."""
    if path not in _COMPILED:
        _COMPILED[path] = Automaton(path)
    return _COMPILED[path]


def encode_texts(df: DataFrame, key: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``key, ids``: the token ids of each text, without special tokens, whose strings are ordinary text.

    Null and empty texts have an empty list.  Texts are taken whole, equal rows each for itself.  ``path`` is
    the vocabulary file, which only the driver reads; its size bounds the automaton that is sent to the executors.
    """
    shared = df.sparkSession.sparkContext.broadcast(automaton(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            ids = [np.array(a.encode(t), dtype=np.int32) for t in b.column(1).to_pylist()]
            offsets = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_ids(df: DataFrame, key: str, ids: str, path: str = TOKENIZER) -> DataFrame:
    """``key, text`` of lists of ids; a null list gives null."""
    shared = df.sparkSession.sparkContext.broadcast(automaton(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else a.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)

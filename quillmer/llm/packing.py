"""Harmonic packing of tokenised documents.

A document's ids are cut into whole sequences and a rest. The rest is cut into
pieces of 1/2, 1/4, ... of the capacity (down to ``least``) and a tail, so all
but the tail fall exactly on a reciprocal of the capacity. Class m holds pieces
longer than capacity/(m+1) and at most capacity/m, and every bin of class m takes
m pieces. Classes fill their bins independently, each worker its own, so there is
no shuffle and nothing is shared. At the end a worker puts the pieces of its
unfilled bins together, longest first, so at most a few bins a task hold padding.

Defined results: a null or empty text still has its one end id; empty input gives
no pieces; repeated rows and null ids are packed as any row; other columns are
not read.
"""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_MEMO = 400_000
_ROWS = 512
#: ASCII marks: a run of them after letters is a word of its own to the tokenizer.
_MARKS = frozenset(string.punctuation)


class Ids:
    """Ids of whole texts, as little-endian 32-bit bytes; ids of chunks are remembered.

    The tokenizer never merges across white space, nor a letter with the marks
    after it, and ignores case; so a text's ids are those of its chunks in order.
    Unknown chunks of letters are encoded together, in one call, and told apart
    by the vocabulary's word ends. Texts that hold a special token's string, or a
    letter whose lower case depends on its neighbours, or a control that only one
    side takes for a blank, go to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: The same model for words that are lower-case, composed and of letters alone: they need no normalising.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        bytes_only = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), bytes_only])
        whole = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(map(re.escape, [*whole, "\u0130", "\u03a3", "\x1c", "\x1d", "\x1e", "\x1f"])))
        self.memo: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def of(self, texts: list[str]) -> list[bytes]:
        cut = [None if self.whole.search(t) else t.lower().split() for t in texts]
        if len(self.memo) > _MEMO:
            self.memo.clear()
        get = self._known(set().union(*(c for c in cut if c is not None))).__getitem__
        return [self._encode([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of these chunks; of letters with marks after them both parts are remembered, not the whole."""
        marked = [(c, head, c[len(head) :]) for c in chunks if c[-1] in _MARKS and (head := c.rstrip(string.punctuation)).isalpha()]
        base = chunks.difference([m[0] for m in marked])
        base.update([m[1] for m in marked], [m[2] for m in marked])
        self._learn(base.difference(self.memo))
        known = dict(zip(base, map(self.memo.__getitem__, base), strict=True))
        known.update([(c, known[head] + known[tail]) for c, head, tail in marked])
        return known

    def _learn(self, other: set[str]) -> None:
        plain = [c for c in other if c.isalpha()]
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            joined = " ".join(part)
            use = self.plain if unicodedata.is_normalized("NFC", joined) else self.tokenizer
            ids = np.array(use.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(part):  # a letter here that is none to the tokenizer
                self.memo.update(zip(part, self._encode(part), strict=True))
                continue
            raw = ids.tobytes()
            first = np.r_[0, last[:-1]]
            self.memo.update((c, raw[4 * x : 4 * y]) for c, x, y in zip(part, first.tolist(), last.tolist(), strict=True))
        rest = [c for c in other if not c.isalpha()]
        self.memo.update(zip(rest, self._encode(rest), strict=True))


#: One a worker process and path: what was learnt serves all its tasks.
_IDS: dict[str, Ids] = {}


def cut(n: int, capacity: int, least: int) -> list[int]:
    """Piece lengths of n ids: whole sequences, then halves, quarters ... of the capacity, then the tail."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= least:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


class Bins:
    """One worker's open bins: ``add`` returns the place of a piece once its bin is full."""

    def __init__(self, capacity: int, first: int):
        self.capacity, self.next = capacity, first
        self.open: dict[int, list[tuple[int, tuple]]] = {}

    def add(self, length: int, piece: tuple) -> list[tuple]:
        m = self.capacity // length
        held = self.open.setdefault(m, [])
        held.append((length, piece))
        return self._close(self.open.pop(m)) if len(held) == m else []

    def _close(self, held: list[tuple[int, tuple]]) -> list[tuple]:
        at, out = 0, []
        for length, piece in held:
            out.append((*piece, self.next, at))
            at += length
        self.next += 1
        return out

    def rest(self) -> Iterator[list[tuple]]:
        """What is left, longest first, each piece into the first bin it fits."""
        bins: list[list] = []
        for length, piece in sorted((p for held in self.open.values() for p in held), key=lambda p: -p[0]):
            home = next((b for b in bins if b[0] + length <= self.capacity), None)
            if home is None:
                bins.append(home := [0, []])
            home[0] += length
            home[1].append((length, piece))
        self.open = {}
        return map(self._close, (b[1] for b in bins))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 1, least: int = 32) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is a file path on every worker; by default the public word
    vocabulary of the installed package. Each task numbers its sequences in a
    range of its own (its partition in the upper bits).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in _IDS:
            _IDS[path] = Ids(path)
        ids = _IDS[path]
        bins = Bins(capacity, TaskContext.get().partitionId() << 36)
        doc_type, end = None, end_id.to_bytes(4, "little")
        for b in it:
            out: list[tuple] = []
            doc_type = b.column("doc_id").type
            for i in range(0, b.num_rows, _ROWS):
                part = b.slice(i, _ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc, raw in zip(part.column("doc_id").to_pylist(), ids.of(texts), strict=True):
                    raw += end
                    n, start = len(raw) // 4, 0
                    for length in cut(n, capacity, least):
                        out += bins.add(length, (doc, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]), n))
                        start += length
            yield table(out, doc_type)
        for full in bins.rest():
            yield table(full, doc_type)

    def table(rows: list[tuple], doc_type: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, doc_type if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)

    shape = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return docs.select("doc_id", F.col("text")).mapInArrow(batches, shape)

"""Exact passage dedup through difference-cover anchors.

A window is 13 consecutive words. {0, 1, 3} is a difference cover modulo 7: for
any two positions some shift below 7 takes both to positions whose residues are
in the cover. So two equal windows share an aligned anchor, 7 words that begin
at a cover position in both documents and lie inside the window. Only anchors
(3 of 7 positions) are hashed and shuffled; those that occur in one document
alone are dropped. Around the others the match is extended: the (at most 7)
windows that hold the anchor are compared, exactly the contract's condition being
"the least doc_id in which this window starts is smaller".

Anchors are told apart by cheap hashes: a collision there only brings a window to
the comparison. Windows are told apart by their words' 128-bit BLAKE2 digest under
a key drawn for the run, so no text can be built whose different windows meet; among
10**14 windows two meet by chance with a probability of 2e-11.

Texts are never shuffled for the search except to meet their own anchors; hot
anchors and windows are reduced by partial aggregates before any shuffle, and the
joins back are many rows against one row a key.

Defined results: null texts have no words; a row with a null id neither removes
nor loses words; rows with one id are compared with other ids only; repeated
rows are treated alike; very long texts are taken whole; ids that are no integers
are an error of the cast; other columns are not read.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

PERIOD, COVER = 7, (0, 1, 3)


class Hasher:
    """64-bit hashes of runs of words, all runs of a text at once.

    A text's words joined by one space get prefix sums of byte codes times powers
    of an odd base, modulo 2**64; a run's hash is the difference of two sums,
    brought back to power 0 by the inverse power, and mixed. So a run costs three
    array operations, whatever its length.
    """

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.codes = draw.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(draw.integers(1 << 40, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        def powers(of: int) -> np.ndarray:
            out = np.full(n, of, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        self.powers, self.inverses = powers(self.base), powers(self.inverse)

    def runs(self, text: Words, starts: np.ndarray, length: int) -> np.ndarray:
        """Hash of the ``length`` words from each start."""
        n = len(text.raw)
        if len(self.powers) <= n:
            self._grow(max(2 * n, 1 << 16))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[text.raw] * self.powers[:n], out=sums[1:])
        first, last = text.starts[starts], text.ends[starts + length - 1]
        h = (sums[last] - sums[first]) * self.inverses[first]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


class Words:
    """The words of a text, and where they are in the bytes of the text joined by one space."""

    def __init__(self, raw: bytes | None):
        self.list = raw.split() if raw else []
        self.raw = np.frombuffer(b" ".join(self.list), np.uint8)
        gaps = np.flatnonzero(self.raw == 32)
        self.starts, self.ends = np.r_[0, gaps + 1], np.r_[gaps, len(self.raw)]

    def __len__(self) -> int:
        return len(self.list)


def cover_positions(n: int, anchor: int) -> np.ndarray:
    """The positions below n - anchor + 1 whose residues are in the cover."""
    at = np.arange(max(0, n - anchor + 1))
    return at[np.isin(at % PERIOD, COVER)]


def _anchors(docs: DataFrame, anchor: int, with_place: bool) -> DataFrame:
    """(h, doc_id) of the anchors of every text, once a text; with th and place also where they are."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(1)
        for b in it:
            ths = b.column("th").to_pylist() if with_place else None
            hs, ids, places, texts = [], [], [], []
            for row, (doc, raw) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist(), strict=True)):
                text = Words(raw)
                at = cover_positions(len(text), anchor)
                if len(at) and doc is not None:
                    h = hasher.runs(text, at, anchor)
                    if not with_place:
                        h = np.unique(h)
                    else:
                        places.append(at)
                        texts.append(np.full(len(h), ths[row], np.int64))
                    hs.append(h)
                    ids.append(np.full(len(h), doc, np.int64))
            cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
            columns = {"h": cat(hs, np.uint64).view(np.int64), "doc_id": cat(ids, np.int64)}
            if with_place:
                columns |= {"th": cat(texts, np.int64), "place": cat(places, np.int64).astype(np.int32)}
            yield pa.RecordBatch.from_pydict(columns)

    shape = "h bigint, doc_id bigint" + ", th bigint, place int" * with_place
    source = docs.select("doc_id", *["th"] * with_place, F.col("text").cast("binary").alias("raw"))
    return source.mapInArrow(batches, shape)


def _windows(texts: DataFrame, window: int, anchor: int, key: bytes) -> DataFrame:
    """(w, x, doc_id, th, start) of every window that holds one of the row's ``places``; w and x are its digest."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeded = hashlib.blake2b(digest_size=16, key=key)

        def digest(part: bytes) -> bytes:
            h = seeded.copy()
            h.update(part)
            return h.digest()

        for b in it:
            digests, ids, ths, starts = [], [], [], []
            rows = zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "places", "raw")), strict=True)
            for doc, th, places, raw in rows:
                text = Words(raw)
                p = np.array(places, np.int64)
                at = np.unique((p[:, None] - np.arange(window - anchor + 1)).ravel())
                at = at[(at >= 0) & (at + window <= len(text))]
                if len(at):
                    joined = text.raw.tobytes()
                    digests += [digest(joined[s:e]) for s, e in zip(text.starts[at].tolist(), text.ends[at + window - 1].tolist(), strict=True)]
                    starts.append(at)
                    ids.append(np.full(len(at), doc, np.int64))
                    ths.append(np.full(len(at), th, np.int64))
            cat = lambda v: np.concatenate(v) if v else np.zeros(0, np.int64)
            both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_pydict({
                "w": both[:, 0].copy(), "x": both[:, 1].copy(), "doc_id": cat(ids), "th": cat(ths), "start": cat(starts).astype(np.int32),
            })

    return texts.mapInArrow(batches, "w bigint, x bigint, doc_id bigint, th bigint, start int")


def kept_words(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text's hash, from rows (doc_id, raw, starts)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n, gone, sha = [], [], []
            for raw, starts in zip(b.column("raw").to_pylist(), b.column("starts").to_pylist(), strict=True):
                ws = raw.split() if raw else []
                n.append(len(ws))
                if starts:
                    step = np.zeros(len(ws) + 1, np.int32)
                    at = np.unique(np.array(starts, np.int64))
                    step[at] += 1
                    step[at + window] -= 1
                    stay = np.cumsum(step[:-1]) == 0
                    ws = [w for w, s in zip(ws, stay, strict=True) if s]
                gone.append(n[-1] - len(ws))
                sha.append(hashlib.sha256(b" ".join(ws)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return docs.mapInArrow(batches, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def repeated_starts(spark: SparkSession, docs: DataFrame, window: int = 13, slices: int = 3) -> DataFrame:
    """(doc_id, th, starts): the windows of a text that also start in a document with a smaller id.

    Windows are compared in ``slices`` parts by their hash, one after another, so
    that only a part's shuffle files are on disk at a time.
    """
    anchor = window - PERIOD + 1
    if anchor < 1:
        raise ValueError(f"windows must have at least {PERIOD} words")
    scratch = Scratch(spark, "passages")
    seen = _anchors(docs, anchor, False).groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    shared = scratch.keep(seen.where("a < b").select("h"), "anchors")
    placed = _anchors(docs, anchor, True).join(shared, "h", "left_semi")
    placed = scratch.keep(placed.groupBy("doc_id", "th").agg(F.collect_set("place").alias("places")), "places")
    texts = docs.select("doc_id", "th", F.col("text").cast("binary").alias("raw")).join(placed, ["doc_id", "th"])
    found = scratch.keep(_windows(texts, window, anchor, secrets.token_bytes(16)), "windows")
    scratch.drop(shared)
    scratch.drop(placed)
    parts = [scratch.keep(_again(found.where(F.pmod("w", F.lit(slices)) == k), scratch), "starts") for k in range(slices)]
    scratch.drop(found)
    every = reduce(DataFrame.union, parts).groupBy("doc_id", "th").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    return every


def _again(found: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, th, starts) of the windows that start in a smaller document too.

    The least documents are a table of their own, so that both sides of the join
    are plain shuffles and adaptive execution can split a hot window's rows.
    """
    first = found.groupBy("w", "x").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("w", "x", "a")
    first = scratch.keep(first, "first")
    again = found.join(first, ["w", "x"]).where("doc_id > a")
    return again.groupBy("doc_id", "th").agg(F.collect_list("start").alias("starts"))


def dedup_passages(spark: SparkSession, docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    starts = repeated_starts(spark, docs, window)
    with_starts = docs.join(starts, ["doc_id", "th"], "left")
    return kept_words(with_starts.select("doc_id", F.col("text").cast("binary").alias("raw"), "starts"), window)

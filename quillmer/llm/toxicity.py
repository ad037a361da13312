"""Toxicity by nearest labelled examples, in exact TF-IDF cosine.

The terms are all terms of a bounded labelled sample; none is left out. A term
weighs (1 + ln count) * idf * relevance: document frequencies are counted over all
documents, and relevance grows with the share of toxic texts among the examples
that hold the term (1 for a term of clean examples alone). Terms outside the sample
have no weight. The examples form an inverted index cut into blocks of examples;
each term keeps its largest weight in each block, so blocks whose bound is below the
k-th best likeness are skipped. Terms that an eighth of the examples hold have a full
row instead of a list, and their sums are part of a block's bound. The found
neighbours are exact. Their votes, weighted
by likeness and shrunk to the share of toxic examples, give the score; the
neighbours are the evidence.

Defined results: null texts count as empty; a text without any term of the sample
(empty texts too) gets the smoothed share of toxic examples among the examples
without terms; equal likenesses are taken by ascending example id; repeated rows are
scored alike; very long texts are scored whole; without labelled rows every score is
0, with labels of one class all scores lie at that class; other columns are not read;
null ids pass. Ids may be of any type that sorts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out
from .quality import labelled_sample

_TERM = re.compile(r"\w+")
_BLOCK = 64
_FIRST = 4
#: A term held by one in so many examples has a full row of weights.
_COMMON = 8
#: So many texts meet the rows of the common terms at once.
_TEXTS = 64


def terms_of(text: str | None) -> Counter:
    """Counts of the lower-cased terms of a whole text."""
    return Counter(_TERM.findall((text or "").lower()))


def known_counts(text: str | None, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the known terms of a text, and their counts."""
    found = terms_of(text)
    numbers = np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))
    held = numbers >= 0
    return numbers[held], np.fromiter(found.values(), np.int64, len(found))[held]


def relevance(holders: np.ndarray, toxic_holders: np.ndarray) -> np.ndarray:
    """How much a term speaks for toxic examples, 1 at least: squared log of the ratio of toxic to clean holders."""
    return np.log2(2 + toxic_holders / np.maximum(1, holders - toxic_holders)) ** 2


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All indices of the ranges one after another, and the lengths of the ranges."""
    n = ends - starts
    upto = np.cumsum(n)
    return np.arange(upto[-1] if len(n) else 0) + np.repeat(starts - upto + n, n), n


@dataclass
class BlockMaxIndex:
    """Postings of unit vectors by term and block, with each block's largest weight.

    Flat arrays: term t's blocks are ``block_of[at[t]:at[t + 1]]`` with bounds
    ``most``; entry e of these has the postings ``first[e]:first[e + 1]`` of
    ``example`` and ``weight``. ``row_of[t]`` is a common term's row of ``rows``, else -1.
    """

    ids: list
    toxic: np.ndarray
    scale: np.ndarray
    at: np.ndarray
    block_of: np.ndarray
    most: np.ndarray
    first: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    row_of: np.ndarray
    rows: np.ndarray
    rest: float
    share: float

    @classmethod
    def build(cls, ids: list, toxic: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, scale: np.ndarray) -> BlockMaxIndex:
        """Index the examples; (row, term, count) are the terms of all, by ascending row, scale the weight of each term."""
        share = float(np.mean(toxic)) if len(toxic) else 0.0
        sizes = np.bincount(row, minlength=len(ids))
        rest = float((toxic[sizes == 0].sum() + share) / ((sizes == 0).sum() + 1))
        w = (1 + np.log(count)) * scale[term]
        norm = np.sqrt(np.bincount(row, w * w, minlength=len(ids)))
        w = w / np.where(norm > 0, norm, 1)[row]
        # Alike examples share blocks (by their heaviest term), so bounds are tight.
        by = np.lexsort((term, -w, row))
        held = np.flatnonzero(sizes)
        heaviest = term[by][np.searchsorted(row[by], held)]
        rank = np.empty(len(held), np.int64)
        rank[sorted(range(len(held)), key=lambda i: ids[held[i]])] = np.arange(len(held))
        held = held[np.lexsort((rank, sizes[held], heaviest))]
        place = np.full(len(ids), -1)
        place[held] = np.arange(len(held))
        row = place[row]
        common = np.flatnonzero(np.bincount(term, minlength=len(scale)) * _COMMON >= max(len(held), 1))
        row_of = np.full(len(scale), -1)
        row_of[common] = np.arange(len(common))
        full, listed = np.zeros((len(common), len(held))), row_of[term] < 0
        full[row_of[term[~listed]], row[~listed]] = w[~listed]
        term, row, w = term[listed], row[listed], w[listed]
        by = np.lexsort((row, term))
        term, row, w = term[by], row[by], w[by]
        block = row // _BLOCK
        new = np.flatnonzero(np.r_[len(term) > 0, (term[1:] != term[:-1]) | (block[1:] != block[:-1])])
        return cls(
            [ids[i] for i in held], toxic[held], scale, np.searchsorted(term[new], np.arange(len(scale) + 1)), block[new].astype(np.int64),
            np.maximum.reduceat(w, new) if len(new) else np.zeros(0), np.r_[new, len(term)].astype(np.int64), row.astype(np.int32), w, row_of, full, rest, share,
        )

    def ready(self, many: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each text (terms, counts) its unit vector, and what the common terms add to its likeness to each example."""
        units, q = [unit(*x, self.scale) for x in many], np.zeros((len(many), len(self.rows)))
        for i, (terms, _) in enumerate(many):
            row = self.row_of.take(terms)
            q[i, row[row >= 0]] = units[i][row >= 0]
        return list(zip(units, q @ self.rows, strict=True))

    def nearest(self, terms: np.ndarray, q: np.ndarray, sums: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Likenesses and examples of the k nearest with any likeness, exact; of equals the smaller ids. q and sums are those of ready."""
        rare, common = self.row_of.take(terms) < 0, sums
        terms, q, sums = terms[rare], q[rare], sums.copy()
        low, high = self.at.take(terms), self.at.take(terms + 1)
        entry, n = _spread(low, high)
        block, w = self.block_of.take(entry), np.repeat(q, n)
        bound = np.maximum.reduceat(sums, np.arange(0, len(sums), _BLOCK))
        bound += np.bincount(block, w * self.most.take(entry), minlength=len(bound))

        def fill(wanted: np.ndarray) -> None:
            on = np.flatnonzero(wanted.take(block))
            entries = entry.take(on)
            post, n = _spread(self.first.take(entries), self.first.take(entries + 1))
            np.add(sums, np.bincount(self.example.take(post), np.repeat(w.take(on), n) * self.weight.take(post), minlength=len(sums)), out=sums)

        lead = np.zeros(len(bound), bool)
        lead[np.argsort(-bound, kind="stable")[:_FIRST]] = True
        fill(lead)
        least = np.partition(sums, -k)[-k] if len(sums) > k else 0.0
        rest = ~lead & (bound > 0) & (bound >= least - 1e-9)
        if rest.sum() * 2 > len(rest):  # most blocks may hold a neighbour: the terms' whole lists are read, in one stretch each
            post, n = _spread(self.first.take(low), self.first.take(high))
            sums = common + np.bincount(self.example.take(post), np.repeat(q, n) * self.weight.take(post), minlength=len(sums))
        else:
            fill(rest)
        sums = np.round(sums, 12)
        hits = np.flatnonzero(sums > 0)
        if len(hits) > k:
            hits = hits[sums[hits] >= np.partition(sums[hits], -k)[-k]]
        best = sorted(hits.tolist(), key=lambda h: (-sums[h], self.ids[h]))[:k]
        return sums[best], np.array(best, int)

    def score(self, terms: np.ndarray, counts: np.ndarray, k: int, shrink: float, ready: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[float, list]:
        """Score from 0 to 1 and the ids of the first neighbours that voted."""
        if not len(terms) or not len(self.ids):
            return self.rest, []
        like, near = self.nearest(terms, *(ready or self.ready([(terms, counts)])[0]), k)
        votes = float((like * self.toxic[near]).sum() + shrink * self.share) / float(like.sum() + shrink)
        return votes, [self.ids[n] for n in near[:3]]


def unit(terms: np.ndarray, counts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    raw = (1 + np.log(counts)) * scale[terms]
    return raw / (np.sqrt((raw * raw).sum()) or 1.0)


def document_frequencies(docs: DataFrame, known: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each known term occurs, and their number; one sum a term and task is shuffled."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known) + 2, np.int64)  # the last but one are the texts, the last is of no term
        for b in it:
            for text in b.column("text").to_pylist():
                terms = set(_TERM.findall((text or "").lower()))
                total[np.fromiter(map(known.get, terms, repeat(-1)), np.int64, len(terms))] += 1
            total[-2] += b.num_rows
        some = np.flatnonzero(total[:-1])
        yield pa.RecordBatch.from_pydict({"term": some, "n": total[some]})

    got = docs.select("text").mapInArrow(batches, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(known) + 1)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def fit_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 4000) -> tuple[BlockMaxIndex, dict[str, int]]:
    """The index over at most ``sample`` labelled examples (the one bound; a parameter), and the numbers of its terms.

    Only the sampled ids (a bounded set) are broadcast; only term counts of the
    sampled texts and one number a term of theirs come to the driver.
    """
    chosen = labelled_sample(labels, "toxic", sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("th", F.xxhash64("text"))
    texts = texts.orderBy(F.xxhash64("doc_id"), "doc_id", "th", "y").limit(sample)  # repeated ids don't add to it

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.list_(pa.string()), pa.list_(pa.int64()))
        for b in it:
            counts = [terms_of(t) for t in b.column("text").to_pylist()]
            lists = [pa.array([list(c) for c in counts], kinds[0]), pa.array([list(c.values()) for c in counts], kinds[1])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), b.column("th"), *lists], ["doc_id", "y", "th", "t", "n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = texts.mapInArrow(batches, f"doc_id {kind}, y double, th bigint, t array<string>, n array<bigint>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("th", "ascending"), ("y", "ascending")]).combine_chunks()
    sizes = np.array([len(x) for x in got.column("t")], np.int64)
    words = pa.chunked_array([c.flatten() for c in got.column("t").chunks], pa.string()).combine_chunks().dictionary_encode()
    words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
    term = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    count = np.concatenate([c.flatten().to_numpy() for c in got.column("n").chunks] or [np.zeros(0, np.int64)])
    row, toxic = np.repeat(np.arange(len(sizes)), sizes), got.column("y").to_numpy()
    known = {t: i for i, t in enumerate(words.dictionary.to_pylist())}
    first = np.zeros(len(sizes), bool)
    first[np.unique(got.column("th").to_numpy(), return_index=True)[1]] = True  # each text once
    holders = np.bincount(term, first[row], minlength=len(known))
    toxic_holders = np.bincount(term, first[row] & (toxic[row] > 0.5), minlength=len(known))
    df, n = document_frequencies(docs, known) if known else (np.zeros(0), 0)
    scale = (np.log((n + 1) / (df + 1)) + 1) * relevance(holders, toxic_holders)
    return BlockMaxIndex.build(got.column("doc_id").to_pylist(), toxic, row, term, count, scale), known


def score_toxicity(docs: DataFrame, index: BlockMaxIndex, known: dict[str, int], cut: float = 0.3, k: int = 15, shrink: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (ids of the nearest examples) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = b.column("doc_id")
            got = []
            for i in range(0, b.num_rows, _TEXTS):
                many = [known_counts(t, known) for t in b.column("text").slice(i, _TEXTS).to_pylist()]
                got += [index.score(*x, k, shrink, ready) for x, ready in zip(many, index.ready(many), strict=True)]
            columns = [ids, pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.list_(ids.type))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "score", "evidence"])

    scored = docs.select("doc_id", "text").mapInArrow(batches, f"doc_id {kind}, score double, evidence array<{kind}>")
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"), "evidence",
    )

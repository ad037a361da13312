"""Quality classifier: a sparse rule ensemble over text statistics.

1. Statistics of each whole text (one Arrow pass over bytes, no per-row Spark rows).
2. Boosted depth-limited trees on a bounded labelled sample; every path of every
   tree is a conjunctive rule over statistics.
3. An L1-penalised logistic fit (proximal gradient with momentum) weighs the rules.
4. The surviving rules are compiled into one Spark column expression.

Defined results: a null text counts as empty; empty texts get a score as any
other; repeated rows are scored alike; without labelled rows of both classes
every score is the share of good labels (0.5 if there are none); very long texts
are measured whole; other columns of the input are neither read nor needed (none
may begin with ``rule_``); a null id passes through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out

STATISTICS = (
    "log_chars", "log_words", "word_len", "letters", "uppers", "digits", "blanks", "marks", "symbols",
    "line_len", "distinct_words", "same_neighbours", "repeat_share", "line_copies", "marked_words",
    "upper_words", "pipes", "byte_entropy", "long_words",
)

_UPPER, _LOWER, _DIGIT, _BLANK, _MARK, _SYMBOL, _HIGH = range(7)
_CLASS = np.full(256, _SYMBOL)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[9, 10, 11, 12, 13, 32]] = _BLANK
_CLASS[[ord(c) for c in ".,;:'\"!?()-"]] = _MARK


def text_statistics(raw: bytes) -> tuple[float, ...]:
    """The STATISTICS of one UTF-8 text."""
    n = len(raw)
    if not n:
        return (0.0,) * len(STATISTICS)
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS, weights=by_byte, minlength=7)
    share = by_byte[by_byte > 0] / n
    ws = raw.split()
    m = max(len(ws), 1)
    distinct = len(set(ws))
    same = sum(map(bytes.__eq__, ws, ws[1:]))
    pairs = len(set(zip(ws, ws[1:], strict=False)))
    lines = raw.split(b"\n")
    ends = sum(w[-2:].translate(None, _WORD_BYTES) == w[-2:] for w in ws if len(w) > 2)
    return (
        np.log1p(n), np.log1p(len(ws)), n / m, (kinds[_UPPER] + kinds[_LOWER] + kinds[_HIGH]) / n,
        kinds[_UPPER] / max(kinds[_UPPER] + kinds[_LOWER], 1), kinds[_DIGIT] / n, kinds[_BLANK] / n, kinds[_MARK] / n,
        kinds[_SYMBOL] / n, np.log1p(n / len(lines)), distinct / m, same / m, 1 - pairs / max(len(ws) - 1, 1),
        1 - len(set(lines)) / len(lines), ends / m, sum(map(bytes.isupper, ws)) / m, by_byte[124] / m,
        float(-(share * np.log2(share)).sum()), sum(len(w) > 24 for w in ws) / m,
    )


_WORD_BYTES = bytes(b for b in range(256) if _CLASS[b] in (_UPPER, _LOWER, _DIGIT, _HIGH))


def with_statistics(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a document: its id and STATISTICS as doubles."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.array([text_statistics(t or b"") for t in b.column("raw").to_pylist()], float)
            x = x.reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column("id"), *map(pa.array, x.T)], ["id", *STATISTICS])

    kind = docs.schema[id_column].dataType.simpleString()
    got = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("binary").alias("raw"))
    got = got.mapInArrow(batches, f"id {kind}, " + ", ".join(f"{s} double" for s in STATISTICS))
    return got.withColumnRenamed("id", id_column)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is_above, threshold) and its fitted weight."""

    terms: tuple[tuple[int, bool, float], ...]
    weight: float = 0.0

    def holds(self, x: np.ndarray) -> np.ndarray:
        ok = np.ones(len(x), bool)
        for f, above, at in self.terms:
            ok &= (x[:, f] > at) if above else (x[:, f] <= at)
        return ok

    def column(self, prefix: str = "") -> Column:
        ok = F.lit(True)
        for f, above, at in self.terms:
            c = F.col(prefix + STATISTICS[f])
            ok = ok & ((c > F.lit(at)) if above else (c <= F.lit(at)))
        return ok


def _best_split(x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, least: int) -> tuple[float, int, float]:
    """Gain, statistic and threshold of the best split by gradient statistics."""
    best = (1e-6, -1, 0.0)
    g_all, h_all = g[rows].sum(), h[rows].sum()
    for f in range(x.shape[1]):
        v = x[rows, f]
        order = np.argsort(v, kind="stable")
        s = v[order]
        gl, hl = np.cumsum(g[rows][order])[:-1], np.cumsum(h[rows][order])[:-1]
        gain = gl**2 / (hl + 1) + (g_all - gl) ** 2 / (h_all - hl + 1) - g_all**2 / (h_all + 1)
        at = np.arange(1, len(s))
        gain[(s[1:] <= s[:-1]) | (at < least) | (len(s) - at < least)] = -1
        if len(gain) and gain.max() > best[0]:
            i = int(gain.argmax())
            best = (float(gain[i]), f, float((s[i] + s[i + 1]) / 2))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int, depth: int, least: int, rate: float) -> list[Rule]:
    """Every root-to-node path of boosted trees, as rules without weights."""
    rules: dict[tuple, None] = {}
    score = np.full(len(y), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        nodes = [((), np.arange(len(y)), 0)]
        while nodes:
            path, rows, d = nodes.pop()
            if path:
                rules[path] = None
            gain, f, at = _best_split(x, g, h, rows, least) if d < depth and len(rows) >= 2 * least else (0, -1, 0)
            if f < 0:
                score[rows] += rate * g[rows].sum() / (h[rows].sum() + 1)
                continue
            above = x[rows, f] > at
            nodes += [((*path, (f, True, at)), rows[above], d + 1), ((*path, (f, False, at)), rows[~above], d + 1)]
    return [Rule(r) for r in rules]


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic fit by accelerated proximal gradient."""
    n, m = r.shape
    size = 0.25 * np.linalg.norm(np.c_[r, np.ones(n)], 2) ** 2 / n
    w = z = np.zeros(m + 1)
    t = 1.0
    rows = np.c_[r, np.ones(n)]
    for _ in range(steps):
        step = z - rows.T @ (1 / (1 + np.exp(-(rows @ z))) - y) / n / size
        new = np.r_[np.sign(step[:-1]) * np.maximum(np.abs(step[:-1]) - penalty / size, 0), step[-1]]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; ``score`` is a Spark column over the STATISTICS."""

    rules: tuple[Rule, ...]
    intercept: float

    def score(self, prefix: str = "") -> Column:
        total = F.lit(self.intercept)
        for r in self.rules:
            total = total + F.when(r.column(prefix), F.lit(r.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, penalty: float = 1e-3) -> RuleEnsemble:
    """Trees, their paths as rules, lasso weights; only rules with weight stay."""
    if len(y) == 0 or y.min() == y.max():
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        return RuleEnsemble((), float(np.log(share / (1 - share))))
    rules = tree_rules(x, y, trees, depth, max(3, len(y) // 1000), 0.3)
    w, b = lasso_logistic(np.column_stack([r.holds(x) for r in rules]).astype(float), y, penalty)
    kept = tuple(Rule(r.terms, float(c)) for r, c in zip(rules, w, strict=True) if abs(c) > 1e-9)
    return RuleEnsemble(kept, b)


def labelled_sample(labels: DataFrame, target: str, sample: int) -> DataFrame:
    """At most ``sample`` labelled rows that may be learnt from, by the order of a hash of the id."""
    may = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & ~held_out(F.col("doc_id")))
    return may.select("doc_id", F.col(target).cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit_quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = 6000) -> RuleEnsemble:
    """Fit on at most ``sample`` labelled rows (the one bound; it is a parameter).

    The sampled ids (16 bytes each, at most ``sample``) are broadcast; only
    their statistics come to the driver, ``sample`` rows at most even if ids repeat.
    """
    chosen = labelled_sample(labels, "quality", sample)
    rows = with_statistics(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.join(F.broadcast(chosen), "doc_id")
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y", *STATISTICS).limit(sample).toPandas()
    got = got.sort_values(["doc_id", *STATISTICS])
    return fit_rules(got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(float))


def score_quality(docs: DataFrame, model: RuleEnsemble, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", model.score().alias("score"))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= cut).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, model: RuleEnsemble, cut: float = 0.7) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns.

    Statistics travel beside the row in the same Arrow batch, so that no join
    by id (and no shuffle of texts) is needed and repeated ids are no trouble.
    The compiled rules judge them.
    """
    names = [f"rule_{s}" for s in STATISTICS]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = np.array([text_statistics((t or "").encode()) for t in b.column("text").to_pylist()], float)
            x = x.reshape(b.num_rows, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, x.T)], [*b.schema.names, *names])

    shape = T.StructType([*docs.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    return docs.mapInArrow(batches, shape).where(model.score("rule_") >= cut).select(*[F.col(f"`{c}`") for c in docs.columns])

"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so neighbours differ in few bits.
Consecutive fingerprints form groups, groups of groups and so on. Each node holds
the bits its members share that its parent does not already hold; a search adds
up a query's differences from the root down and drops a whole group as soon as
the sum exceeds the radius.

Distributed form: the top level (even ranges of Gray rank, about ``cell_size``
fingerprints each) is small and goes to the workers in a closure. A fingerprint
is sent to the cells it may have neighbours in; every cell builds its own lower
levels and is searched by itself. Cells send on only a spanning set of links.

Defined results: null texts count as empty; no words: fingerprint zero, linked
as any other; equal fingerprints are linked; rows with a null id are linked as
others, but only ids that are not null can name a component (null if it has
none); repeated rows stay; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, let, local_roots, words
from .simhash import fingerprints, hex16, word_terms

_FAN = 16
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
_TOP = -(1 << 63)


def shingle_hashes(w: Column, size: int) -> Column:
    """XXH64 (seed 42) of every run of ``size`` words joined by one space, of all words if fewer."""
    return word_terms(w, size, lambda ws: F.struct(F.xxhash64(F.concat_ws(" ", *ws)).alias("h0")))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def doc_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp of every row."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", lower_ascii(F.col("text")).alias("text"))
    hashed = rows.select("row", "doc_id", let(words(F.col("text")), lambda w: shingle_hashes(w, shingle)).alias("terms"))
    return fingerprints(hashed, ["row", "doc_id"], "terms", 1).select("doc_id", F.col("fp0").alias("fp"))


def gray_rank(fp: Column) -> Column:
    """Position of fp in the Gray sequence, as a number whose signed order is that position's order."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(_TOP))


def gray_ranks(fps: np.ndarray) -> np.ndarray:
    r = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(shift)
    return r


class GrayIndex:
    """Levels over items that are in Gray order; each item is a (pattern, mask of known bits)."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None):
        full = [(patterns, np.full(len(patterns), _ALL) if masks is None else masks)]
        while len(full[-1][0]) > _FAN:
            p, m = full[-1]
            starts = np.arange(0, len(p), _FAN)
            both = np.bitwise_and.reduceat(m, starts)
            same = both & ~(np.bitwise_or.reduceat(p, starts) ^ np.bitwise_and.reduceat(p, starts))
            full.append((p[starts] & same, same))
        self.levels = []
        for k, (p, m) in enumerate(full):
            held = np.repeat(full[k + 1][1], _FAN)[: len(p)] if k + 1 < len(full) else np.uint64(0)
            self.levels.append((p, m & ~held))
        self.levels.reverse()

    def search(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices (query, item) of all items that may be (for full masks: are) within the radius."""
        n = len(self.levels[0][0])
        q, node = np.repeat(np.arange(len(queries)), n), np.tile(np.arange(n), len(queries))
        off = np.zeros(len(q), np.uint8)
        for k, (p, m) in enumerate(self.levels):
            if k:
                child = node[:, None] * _FAN + np.arange(_FAN)
                ok = (child < len(p)).ravel()
                q, off, node = np.repeat(q, _FAN)[ok], np.repeat(off, _FAN)[ok], child.ravel()[ok]
            off = off + np.bitwise_count((queries[q] ^ p[node]) & m[node])
            ok = off <= radius
            q, off, node = q[ok], off[ok], node[ok]
        return q, node


def near_links(spark: SparkSession, distinct: DataFrame, radius: int, scratch: Scratch, cell_size: int = 65_536) -> DataFrame:
    """A spanning set of links (a, b: fingerprints) among distinct fingerprints ``fp`` within the radius."""
    ranked = distinct.select("fp", gray_rank(F.col("fp")).alias("rank"))
    n = ranked.count()
    cells = max(1, -(-n // cell_size))
    at = [i / cells for i in range(1, cells)]
    bounds = sorted({int(x) for x in ranked.agg(F.percentile_approx("rank", F.lit(at), F.lit(max(10_000, 4 * cells)))).first()[0]}) if at else []
    cuts = np.array(bounds, np.int64)

    def home(b: pd.DataFrame) -> np.ndarray:
        return np.searchsorted(cuts, b["rank"].to_numpy(np.int64), side="right")

    def tops(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            by = b.groupby(home(b))["fp"]
            yield pd.DataFrame({"cell": list(by.groups), "all_of": by.agg(np.bitwise_and.reduce).array, "any_of": by.agg(np.bitwise_or.reduce).array})

    top = ranked.mapInPandas(tops, "cell int, all_of bigint, any_of bigint")
    top = top.groupBy("cell").agg(F.expr("bit_and(all_of)").alias("a"), F.expr("bit_or(any_of)").alias("o")).orderBy("cell").toPandas()
    ids = top["cell"].to_numpy(np.int64)
    all_of, any_of = (top[c].to_numpy(np.int64).view(np.uint64) for c in "ao")
    shared = ~(all_of ^ any_of)

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = GrayIndex(all_of & shared, shared) if len(ids) else None
        for b in it:
            fps, own = b["fp"].to_numpy(np.int64), home(b)
            for i in range(0, len(fps), 4096):
                part, mine = fps[i : i + 4096], own[i : i + 4096]
                q, node = index.search(part.view(np.uint64), radius)
                cell = ids[node]
                ok = cell >= mine[q]
                yield pd.DataFrame({"cell": cell[ok].astype(np.int32), "fp": part[q[ok]], "home": cell[ok] == mine[q[ok]]})

    def join(b: pd.DataFrame) -> pd.DataFrame:
        fps, is_home = b["fp"].to_numpy(np.int64).view(np.uint64), b["home"].to_numpy(bool)
        order = np.argsort(gray_ranks(fps[is_home]))
        items = fps[is_home][order]
        all_fps = np.r_[items, fps[~is_home]]
        index, a, c = GrayIndex(items), [], []
        for i in range(0, len(all_fps), 4096):
            q, node = index.search(all_fps[i : i + 4096], radius)
            ok = q + i != node
            a.append(q[ok] + i)
            c.append(node[ok])
        root = local_roots(len(all_fps), np.concatenate(a), np.concatenate(c))
        off = np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": all_fps[off].view(np.int64), "b": all_fps[root[off]].view(np.int64)})

    routed = ranked.mapInPandas(route, "cell int, fp bigint, home boolean")
    return routed.groupBy("cell").applyInPandas(join, "a bigint, b bigint")


def simhash_groups(spark: SparkSession, docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (smallest linked doc_id, itself included) of every row."""
    scratch = Scratch(spark, "gray")
    fps = scratch.keep(doc_fingerprints(docs, shingle), "fps")
    distinct = scratch.keep(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(spark, near_links(spark, distinct, radius, scratch), scratch)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = scratch.keep(named, "named")
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = named.join(low, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return hex16(fp)

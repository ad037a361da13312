"""Embedding near-duplicates by an exact metric range join.

On unit vectors, cosine >= c is distance <= r with r = sqrt(2 - 2c). Every
vector belongs to the cell of its nearest pivot. By the triangle inequality a
vector can be within r of a member of another cell only if it is within that
cell's radius plus r of its pivot and no further than r beyond the plane between
the two pivots; only then a copy visits that cell, and only a cell of a smaller
number, so that each pair meets once. Cells join by themselves: each (home block,
visitor block) of a cell is one bounded unit of work: a single-precision product
with a margin finds the candidates, double precision decides. A unit sends on the
number of links of each vector and a spanning set of links, never pairs.

Copies are few if the vectors form clusters wider apart than r; evenly spread
vectors of many dimensions are visited by nearly all cells (README has figures).

Exact copies are joined first and count as one vector with a multiplicity.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing (n_links 0, component their own id); vectors of
other lengths than the most frequent length link only with their own length;
rows with a null id are compared too but cannot name a component; repeated ids
are rows of their own, n_links counts the other rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, components, local_roots

#: Slack for rounding in the distance bounds and in the single-precision filter; the link test itself has none.
_SLACK, _MARGIN = 1e-9, 1e-4


def valid(column: str):
    """True for vectors that may link."""
    c = F.col(column)
    fine = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & (F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def _units(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * x @ pivots.T, 0))


def range_units(spark: SparkSession, reps: DataFrame, cosine: float, per_cell: int, block: int, most_pivots: int) -> DataFrame:
    """Links among reps (rep, v, n): rows (a, b, links): per unit, a's links there, or b its smallest linked vector.

    ``most_pivots`` bounds what the driver and every closure hold (the pivots and
    their distances). Beyond it cells grow; their blocks, the units of work, don't.
    """
    r = float(np.sqrt(2 - 2 * cosine))
    n = reps.count()
    chosen = reps.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(min(most_pivots, max(1, -(-n // per_cell))))
    pivots = chosen.toPandas()
    if not len(pivots):
        return spark.createDataFrame([], "a bigint, b bigint, links bigint")
    pivots = _units(np.vstack(pivots["v"]))
    apart = np.maximum(_distances(pivots, pivots), 1e-6)

    def radii(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            d = _distances(_units(np.vstack(b["v"])), pivots)
            home = d.argmin(axis=1)
            yield pd.DataFrame({"cell": home, "d": d[np.arange(len(d)), home]}).groupby("cell", as_index=False)["d"].max()

    far = {x["cell"]: x["d"] for x in reps.mapInPandas(radii, "cell int, d double").groupBy("cell").agg(F.max("d").alias("d")).collect()}
    radius = np.array([far.get(i, -np.inf) for i in range(len(pivots))])

    def routed(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """home cell, and (row, cell) of all cells each row is in."""
        home = d.argmin(axis=1)
        own = d[np.arange(len(d)), home]
        beyond = (d**2 - own[:, None] ** 2) / (2 * apart[home])
        go = (d <= radius + r + _SLACK) & (beyond <= r + _SLACK)
        go &= np.arange(len(pivots)) < home[:, None]
        go[np.arange(len(d)), home] = True
        return (home, *np.nonzero(go))

    def sizes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            home, _, cell = routed(_distances(_units(np.vstack(b["v"])), pivots))
            yield pd.DataFrame({"cell": np.arange(len(pivots)), "h": np.bincount(home, minlength=len(pivots)), "m": np.bincount(cell, minlength=len(pivots))})

    counted = reps.mapInPandas(sizes, "cell int, h bigint, m bigint").groupBy("cell").agg(F.sum("h").alias("h"), F.sum("m").alias("m")).collect()
    h_blocks, v_blocks = np.ones(len(pivots), int), np.ones(len(pivots), int)
    for c in counted:
        h_blocks[c["cell"]], v_blocks[c["cell"]] = max(1, -(-c["h"] // block)), max(1, -(-c["m"] // block))

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Copies for each unit: a home row in block i meets all visitor blocks, any row in visitor block j all home blocks."""
        for whole in it:
            for s in range(0, len(whole), 1024):
                yield from copies(whole.iloc[s : s + 1024])

    def copies(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        raw = np.vstack(b["v"])
        home, row, cell = routed(_distances(_units(raw), pivots))
        packed = np.array([x.tobytes() for x in raw], dtype=object)
        mix = (b["rep"].to_numpy(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        own = home[row] == cell
        for role in (0, 1):
            kept = np.flatnonzero(own) if role == 0 else np.arange(len(row))
            here, across = (h_blocks, v_blocks) if role == 0 else (v_blocks, h_blocks)
            n = across[cell[kept]]
            at = np.repeat(kept, n)
            k = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            mine = (mix[row[at]] % here[cell[at]].astype(np.uint64)).astype(int)
            i, j = (mine, k) if role == 0 else (k, mine)
            for s in range(0, len(at), 20_000):
                z = slice(s, s + 20_000)
                r_ = row[at[z]]
                yield pd.DataFrame({
                    "cell": cell[at[z]].astype(np.int32), "i": i[z].astype(np.int32), "j": j[z].astype(np.int32),
                    "role": np.where(own[at[z]], role, 2).astype(np.int32), "rep": b["rep"].to_numpy()[r_], "n": b["n"].to_numpy()[r_], "v": packed[r_],
                })

    def join(b: pd.DataFrame) -> pd.DataFrame:
        role, ids, weight = b["role"].to_numpy(), b["rep"].to_numpy(np.int64), b["n"].to_numpy(np.int64)
        x = _units(np.frombuffer(b"".join(b["v"]), dtype).reshape(len(b), -1))
        is_home = role == 0
        hx, vx, hid, vid, hn, vn = x[is_home], x[~is_home], ids[is_home], ids[~is_home], weight[is_home], weight[~is_home]
        foreign = role[~is_home] == 2
        h32, v32 = hx.astype(np.float32), vx.astype(np.float32).T.copy()
        every, place = np.unique(np.r_[hid, vid], return_inverse=True)
        hp, vp = place[: len(hid)], place[len(hid) :]
        h_links, v_links, a, c = np.zeros(len(hid), np.int64), np.zeros(len(vid), np.int64), [], []
        for s in range(0, len(hid), 256):
            rough = h32[s : s + 256] @ v32 >= cosine - _MARGIN
            p, q = np.nonzero(rough)
            if not len(p):
                continue
            if len(p) > rough.size // 50:
                p, q = np.nonzero(rough & (hx[s : s + 256] @ vx.T >= cosine))
            else:
                fine = np.einsum("ij,ij->i", hx[p + s], vx[q]) >= cosine
                p, q = p[fine], q[fine]
            p += s
            other = hid[p] != vid[q]
            p, q = p[other], q[other]
            np.add.at(h_links, p, vn[q])
            away = foreign[q]
            np.add.at(v_links, q[away], hn[p[away]])
            root = local_roots(len(every), hp[p], vp[q])
            off = np.flatnonzero(root != np.arange(len(root)))
            a.append(off)
            c.append(root[off])
        a, c = (np.concatenate(z) if z else np.zeros(0, int) for z in (a, c))
        root = local_roots(len(every), a, c)
        off = np.flatnonzero(root != np.arange(len(root)))
        who, links = np.r_[hid, vid], np.r_[h_links, v_links]
        got = np.flatnonzero(links)
        return pd.DataFrame({
            "a": np.r_[who[got], every[off]], "b": pd.array([None] * len(got) + every[root[off]].tolist(), "Int64"),
            "links": np.r_[links[got], np.zeros(len(off), np.int64)],
        })

    dtype = {"float": np.float32, "double": np.float64}[reps.schema["v"].dataType.elementType.simpleString()]
    units = reps.mapInPandas(route, "cell int, i int, j int, role int, rep bigint, n bigint, v binary")
    return units.groupBy("cell", "i", "j").applyInPandas(join, "a bigint, b bigint, links bigint")


def near_vectors(spark: SparkSession, vectors: DataFrame, cosine: float = 0.9, per_cell: int = 8192, block: int = 8192, most_pivots: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding)."""
    scratch = Scratch(spark, "vectors")
    base = vectors.select("vec_id", "embedding").withColumn("ok", valid("embedding"))
    if base.schema["embedding"].dataType.elementType.simpleString() != "float":
        base = base.withColumn("embedding", F.col("embedding").cast("array<double>"))
    size = base.where("ok").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").collect()
    copies = base.where("ok").groupBy("embedding").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    reps = scratch.keep(copies.select(F.monotonically_increasing_id().alias("rep"), F.col("embedding").alias("v"), "n", "first"), "reps")
    found = None
    for d in (x["d"] for x in size):  # lengths differ only in faulty inputs
        part = range_units(spark, reps.where(F.size("v") == d).select("rep", "v", "n"), cosine, per_cell, block, most_pivots)
        found = part if found is None else found.union(part)
    if found is None:
        found = spark.createDataFrame([], "a bigint, b bigint, links bigint")
    found = scratch.keep(found, "found")
    roots = components(spark, found.where("b is not null").select("a", "b"), scratch)
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    named = reps.join(roots, reps["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    named = named.join(links, named["rep"] == links["a"], "left")
    named = named.select("v", "root", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    named = scratch.keep(named, "named")
    low = named.groupBy("root").agg(F.min("first").alias("component_id"))
    by_vector = named.join(low, "root").select("v", "n_links", "component_id")
    own = F.when(F.col("ok"), F.col("embedding"))  # null never joins
    out = base.select("vec_id", own.alias("e")).join(by_vector, F.col("e") == F.col("v"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.when(F.col("v").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

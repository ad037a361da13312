"""Hits of reads counted in numpy: rows come sorted by read, with the flat lists of one k-mer each (labels.packed)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..functions.kmers import text_codes, window_codes

#: Rows that are worked on at once, besides those of a longer read.
_AT_ONCE = 1 << 16
_LOW = np.int64(0xFFFFFFFF)


def whole_reads(it: Iterator[pa.RecordBatch], at_once: int = _AT_ONCE) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches sorted by their first column, regrouped so that no read is cut, and where each read begins.

    A read's rows are held until they are all there, however many they are.
    """
    held, n, wanted = [], 0, at_once
    for b in it:
        held.append(b)
        n += b.num_rows
        if n < wanted:
            continue
        t = pa.Table.from_batches(held)
        starts = _starts(t)
        if len(starts) > 1:
            yield t.slice(0, starts[-1]).combine_chunks(), starts[:-1]
            t = t.slice(starts[-1])
        held, n = t.to_batches(), t.num_rows
        wanted = max(at_once, 2 * n)
    if n:
        t = pa.Table.from_batches(held).combine_chunks()
        yield t, _starts(t)


def _starts(t: pa.Table) -> np.ndarray:
    ids = t.column(0).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    if not len(ids):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)).to_numpy(zero_copy_only=False))))


def _flat(t: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The elements of a list column one after another, and the length of each list."""
    c = t.column(name).combine_chunks()
    c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.int64), c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _key(row: np.ndarray, tid: np.ndarray) -> np.ndarray:
    return (row << 32) | (tid & _LOW)


def _first(x: np.ndarray) -> np.ndarray:
    """Where a value of a sorted array stands first."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def strains_of(t: pa.Table, read: np.ndarray) -> tuple[np.ndarray, ...]:
    """read, species, tid and number of k-mers of each species' representing strain; and per strain of a k-mer its k-mer and whether it represents.

    The strain of most k-mers of the read represents its species, of equals the smallest tid.
    """
    tid, n = _flat(t, "tids")
    species, _ = _flat(t, "species")
    row = np.repeat(np.arange(len(n)), n)
    order = np.argsort(_key(read[row], tid), kind="stable")
    key = _key(read[row], tid)[order]
    at = _first(key)
    count = np.diff(np.append(at, len(key)))
    one = order[at]
    own, kind, name = read[row[one]], species[one], tid[one]
    by = np.lexsort((name, -count, kind, own))
    best = np.zeros(len(at), bool)
    if len(by):
        best[by[np.concatenate(([True], (own[by][1:] != own[by][:-1]) | (kind[by][1:] != kind[by][:-1])))]] = True
    represents = np.zeros(len(key), bool)
    represents[order] = np.repeat(best, count)
    some = np.flatnonzero(best)
    return own[some], kind[some], name[some], count[some], row, represents


def _counted(t: pa.Table, starts: np.ndarray) -> list[pa.Array]:
    found = np.diff(np.append(starts, t.num_rows))
    read = np.repeat(np.arange(len(starts)), found)
    node, n = _flat(t, "nodes")
    keys = _key(np.repeat(read, n), node)
    *_, row, represents = strains_of(t, read)
    lent, n = _flat(t, "lends")
    each, _ = _flat(t, "sizes")
    if represents.any():
        lends = np.repeat(represents, each)
        of = _key(np.repeat(row, each)[lends], lent[lends])
        of = np.sort(of)
        of = of[_first(of)]  # a node once a k-mer, whichever strains lend it
        keys = np.concatenate((keys, _key(read[of >> 32], of & _LOW)))
    keys.sort()
    at = _first(keys)
    hits = np.diff(np.append(at, len(keys)))
    own, tid = keys[at] >> 32, (keys[at] & _LOW).astype(np.uint32).view(np.int32)
    place = t.column("place").to_numpy()[starts]
    n_kmers, gc_bin = place >> 36, ((place >> 32) & 15).astype(np.int32)
    ids = t.column(0).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return [ids.take(pa.array(starts[own])), *map(pa.array, (tid, hits, n_kmers[own], found[own], gc_bin[own], hits / n_kmers[own]))]


def _represented(t: pa.Table, starts: np.ndarray) -> list[pa.Array]:
    read = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
    own, species, tid, n, *_ = strains_of(t, read)
    ids = t.column(0).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return [ids.take(pa.array(starts[own])), pa.array(species.astype(np.int32)), pa.array(tid.astype(np.int32)), pa.array(n)]


def _by_read(met: DataFrame, make: Callable, columns: str, names: list[str] | None = None) -> DataFrame:
    kind = met.schema[0].dataType.simpleString()
    key, shape = met.columns[0], f"{kind}, {columns}"
    names = [key, *(names or (c.split()[0] for c in columns.split(", ")))]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_reads(it):
            yield pa.RecordBatch.from_arrays(make(t, starts), names)

    return met.repartition(key).sortWithinPartitions(key).mapInArrow(batches, f"{key} {shape}")


def counted(met: DataFrame) -> DataFrame:
    """(read_id, tid, hits, n_kmers, n_found, gc_bin, prob) of k-mers with their lists: (read_id, place, nodes, tids, species, sizes, lends)."""
    return _by_read(met, _counted, "tid int, hits bigint, n_kmers bigint, n_found bigint, gc_bin int, prob double")


def represented(met: DataFrame) -> DataFrame:
    """(read_id, species, tid, n): the representing strain of each species in a read, and its k-mers; of (read_id, tids, species)."""
    return _by_read(met, _represented, "species int, tid int, n bigint")


def _genes(t: pa.Table, starts: np.ndarray, kind: pa.DataType) -> list[pa.Array]:
    found = np.diff(np.append(starts, t.num_rows))
    read = np.repeat(np.arange(len(starts)), found)
    gid, n = _flat(t, "genes")
    names, number = np.unique(gid, return_inverse=True)
    keys = np.sort(_key(np.repeat(read, n), number))
    at = _first(keys)
    hits, own, gid = np.diff(np.append(at, len(keys))), keys[at] >> 32, names[keys[at] & _LOW]
    lists = lambda of, x: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=len(starts)))).astype(np.int32)), x)
    l = lists(own, pa.StructArray.from_arrays([pa.array(hits), pa.array(gid).cast(kind)], ["hits", "gid"]))
    best = np.lexsort((gid, -hits, own))
    best = best[_first(own)]
    lead, known = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
    lead[own[best]], known[own[best]] = gid[best], True
    m = t.column("m").combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
    wide = np.flatnonzero(m >= 0)
    code = t.column("code").to_numpy()[wide]
    order = np.lexsort((code, read[wide]))
    most = np.maximum(np.maximum.reduceat(m, starts), 0).astype(np.int32)
    ids = t.column(0).combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    return [
        ids.take(pa.array(starts)), pa.array(t.column("n").to_numpy()[starts]), lists(read[wide], pa.array(code[order])), pa.array(most), l,
        pa.array(lead, mask=~known).cast(kind),
    ]


def genes_of_reads(met: DataFrame, gid: DataType) -> DataFrame:
    """(read_id, n, wide, m, l, lead) of a read's k-mers with their genes (read_id, n, code, genes, m), m being null where the genes are listed.

    l are the listed genes with their hits, lead that of most hits, of equals the
    smallest; wide the sorted codes of the k-mers with m, and m the largest of these.
    """
    kind = to_arrow_type(gid)
    shape = f"n bigint, wide array<bigint>, m int, l array<struct<hits:bigint,gid:{gid.simpleString()}>>, lead {gid.simpleString()}"
    return _by_read(met, lambda t, starts: _genes(t, starts, kind), shape, ["n", "wide", "m", "l", "lead"])


# Genes and reads that meet by sorting: under each key the held rows (kind 0) come before those that ask (kind 1).


def _lists(of: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """n lists of the values, which are sorted by their list."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))).astype(np.int32)), pa.array(values))


def _bits(code: np.ndarray) -> np.ndarray:
    """One of 64 bits for each k-mer."""
    return np.uint64(1) << ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(58))


def _any_bits(code: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduceat(_bits(code), starts).view(np.int64) if len(starts) else np.zeros(0, np.int64)


def _mapped(df: DataFrame, make: Callable, shape: str) -> DataFrame:
    """make(batch) gives the columns of shape for each batch, cut to pieces that Arrow can hold."""
    names = [c.split()[0] for c in shape.split(", ")]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in make(b)], names)

    return df.mapInArrow(batches, shape)


def coded_pairs(index: DataFrame, k: int) -> DataFrame:
    """(code, gid) of (kmer, gid)."""

    def make(b: pa.RecordBatch) -> list:
        row, code = text_codes(b.column(0), k)
        return [code, b.column(1).take(pa.array(row))]

    return _mapped(index.selectExpr("kmer", "cast(gid as bigint) as gid"), make, "code bigint, gid bigint")


def signed_pairs(own: DataFrame) -> DataFrame:
    """(code, gid, bits): a row a k-mer of a gene (gid, codes); bits are those of all its k-mers."""

    def make(b: pa.RecordBatch) -> list:
        code, n = _flat(pa.Table.from_batches([b]), "codes")
        at = np.append(0, np.cumsum(n))[:-1]
        gid = b.column(0).to_numpy(zero_copy_only=False)
        return [code, np.repeat(gid[n > 0], n[n > 0]), np.repeat(_any_bits(code, at[n > 0]), n[n > 0])]

    return _mapped(own.select("gid", "codes"), make, "code bigint, gid bigint, bits bigint")


def _distinct(row: np.ndarray, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """row and code, sorted, each pair once."""
    order = np.lexsort((code, row)) if k > 15 else np.argsort((row << 2 * k) | code)
    r, c = row[order], code[order]
    once = np.ones(len(r), bool)
    once[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
    return r[once], c[once]


def probes(runs: DataFrame, k: int) -> DataFrame:
    """(read_id, seq, alone, n, bits, last, first) of (read_id, seq, alone): distinct k-mers of seq, the bits of all of them, its last and its first k-mer; rows without k-mers are left out."""

    def make(b: pa.RecordBatch) -> list:
        row, code = window_codes(b.column(1), k)
        at = _first(row)
        n = np.bincount(_distinct(row, code, k)[0], minlength=b.num_rows)
        some = pa.array(row[at])
        ends = np.append(at[1:], len(row)) - 1 if len(at) else at
        return [*(b.column(i).take(some) for i in range(3)), n[row[at]], _any_bits(code, at), code[ends], code[at]]

    kind = runs.schema["read_id"].dataType.simpleString()
    return _mapped(runs.select("read_id", "seq", "alone"), make, f"read_id {kind}, seq string, alone boolean, n bigint, bits bigint, last bigint, first bigint")


def _met(held: DataFrame, asking: DataFrame, key: str) -> DataFrame:
    """Rows of both by key, the held first, columns of the other being null."""
    a = held.withColumn("kind", F.lit(0)).select(key, "kind", *[c for c in held.columns if c != key])
    b = asking.withColumn("kind", F.lit(1)).select(key, "kind", *[c for c in asking.columns if c != key])
    return a.unionByName(b, allowMissingColumns=True).repartition(key).sortWithinPartitions(key, "kind")


def _split(b: pa.RecordBatch) -> tuple[pa.Table, pa.Table]:
    kind = b.column(1).to_numpy()
    t = pa.Table.from_batches([b])
    return tuple(t.take(pa.array(np.flatnonzero(kind == x))).combine_chunks() for x in (0, 1))


def _one(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name).combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c


def candidates(pairs: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, seq, alone, n, genes): the genes of a read's code, of pairs (code, gid, bits), whose bits hold those of the read (read_id, seq, alone, n, code, want).

    A gene that has all k-mers of a read is among them. A code has few genes; those of the last one are kept from batch to batch.
    """
    kind = reads.schema["read_id"].dataType.simpleString()
    shape = f"read_id {kind}, seq string, alone boolean, n bigint, genes array<bigint>"
    names = ["read_id", "seq", "alone", "n"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for b in it:
            have, ask = _split(b)
            held = [np.concatenate((h, _one(have, c).to_numpy())) for h, c in zip(held, ("code", "gid", "bits"), strict=True)]
            if ask.num_rows:
                code = _one(ask, "code").to_numpy()
                low, high = np.searchsorted(held[0], code, "left"), np.searchsorted(held[0], code, "right")
                n = high - low
                of = np.repeat(np.arange(len(n)), n)
                at = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]
                want = _one(ask, "want").to_numpy()[of]
                fine = (held[2][at] & want) == want
                genes = _lists(of[fine], len(n), held[1][at[fine]])
                yield pa.RecordBatch.from_arrays([*(_one(ask, c) for c in names), genes], [*names, "genes"])
            held = [h[np.searchsorted(held[0], held[0][-1:], "left")[0] if len(held[0]) else 0 :] for h in held]

    return _met(pairs, reads, "code").mapInArrow(batches, shape)


class _Genes:
    """Genes in the order of their ids with the codes of their k-mers, sorted."""

    def __init__(self, gid: np.ndarray, n: np.ndarray, codes: np.ndarray):
        self.gid = gid
        row = np.repeat(np.arange(len(gid)), n)
        order = np.lexsort((codes, row))
        self.row, self.codes = row[order], codes[order]
        self.narrow = not len(codes) or int(codes.max()) < 1 << 31
        self.known = None if self.narrow else np.unique(self.codes)
        self.keys = (self.row << 32) | (self.codes if self.narrow else np.searchsorted(self.known, self.codes))

    def find(self, gene: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the codes are k-mers of the gene beside it, and their places in codes of the genes."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if self.narrow:
            own, fine = codes, codes < 1 << 31
        else:
            own = np.minimum(np.searchsorted(self.known, codes), len(self.known) - 1)
            fine = self.known[own] == codes
        key = np.where(fine, (gene << 32) | own, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == key)
        return hit, at[hit]


def _gene_batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Genes, pa.Table]]:
    """The genes of each batch, the last one of the batch before being the first, and the rows that ask for them."""
    gid, n, codes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in it:
        have, ask = _split(b)
        c, m = _flat(have, "codes")
        genes = _Genes(np.append(gid, _one(have, "gid").to_numpy()), np.append(n, m), np.append(codes, c))
        yield genes, ask
        if len(genes.gid):
            codes = genes.codes[genes.row == len(genes.gid) - 1]
            gid, n = genes.gid[-1:], np.array([len(codes)])


def checked(own: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(read_id, gid, n, hits, ...) of reads (read_id, seq, gid, ...): their distinct k-mers, and how many of them the gene, of own (gid, codes), has."""
    rest = [f for f in reads.schema if f.name not in ("read_id", "seq", "gid")]
    kind = reads.schema["read_id"].dataType.simpleString()
    shape = ", ".join([f"read_id {kind}", "gid bigint", "n bigint", "hits bigint", *(f"{f.name} {f.dataType.simpleString()}" for f in rest)])
    names = ["read_id", "gid", "n", "hits", *(f.name for f in rest)]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for genes, ask in _gene_batches(it):
            if ask.num_rows:
                row, code = _distinct(*window_codes(_one(ask, "seq"), k), k)
                gene = np.searchsorted(genes.gid, _one(ask, "gid").to_numpy())
                hit, _ = genes.find(gene[row], code)
                n, hits = (pa.array(np.bincount(x, minlength=ask.num_rows)) for x in (row, row[hit]))
                yield pa.RecordBatch.from_arrays([_one(ask, "read_id"), _one(ask, "gid"), n, hits, *(_one(ask, f.name) for f in rest)], names)

    return _met(own, reads, "gid").mapInArrow(batches, shape)


def covered(own: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(gid, n_kmers, sum_kmers): distinct and all occurrences of the k-mers of a gene, of own (gid, codes), in reads (gid, seq); genes without any are left out."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = None, None
        for genes, ask in _gene_batches(it):
            count = np.zeros(len(genes.codes), np.int64)
            if last is not None:
                count[: len(seen)] = seen
            if ask.num_rows:
                row, code = window_codes(_one(ask, "seq"), k)
                gene = np.searchsorted(genes.gid, _one(ask, "gid").to_numpy())
                count += np.bincount(genes.find(gene[row], code)[1], minlength=len(count))
            if not len(genes.gid):
                continue
            own = genes.row < len(genes.gid) - 1
            yield out(genes.gid[:-1], genes.row[own], count[own])
            last, seen = genes.gid[-1:], count[~own]
        if last is not None:
            yield out(last, np.zeros(len(seen), np.int64), seen)

    def out(gid: np.ndarray, row: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        n, every = (np.bincount(row, w, len(gid)).astype(np.int64) for w in (count > 0, count))
        return pa.RecordBatch.from_arrays([pa.array(x[n > 0]) for x in (gid, n, every)], ["gid", "n_kmers", "sum_kmers"])

    return _met(own, reads, "gid").mapInArrow(batches, "gid bigint, n_kmers bigint, sum_kmers bigint")


# Many k-mers that meet their genes go as packed arrays, a row for each (batch, bucket of k-mers) and then for each (bucket, block of reads).
_BUCKETS, _BLOCK = 128, 13


def _pack(x: np.ndarray) -> bytes:
    small = not len(x) or (int(x.min()) >= 0 and int(x.max()) < 1 << 31)
    return b"4" + x.astype(np.int32).tobytes() if small else b"8" + x.astype(np.int64).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    return np.frombuffer(b, np.int32 if b[:1] == b"4" else np.int64, offset=1).astype(np.int64)


def _dealt(key: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    order = np.argsort(key, kind="stable")
    at = _first(key[order])
    for low, high in zip(at, np.append(at[1:], len(order)), strict=True):
        i = order[low:high]
        yield int(key[i[0]]), _pack(a[i]), _pack(b[i])


def _bucket(code: np.ndarray) -> np.ndarray:
    return ((code.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.int64) % _BUCKETS


def packed_pairs(pairs: DataFrame) -> DataFrame:
    """(bucket, a, b): codes and genes of pairs (code, gid)."""

    def make(b: pa.RecordBatch) -> list:
        code, gid = b.column(0).to_numpy(), b.column(1).to_numpy()
        rows = list(_dealt(_bucket(code), code, gid))
        return [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))]

    return _mapped(pairs.select("code", "gid"), make, "bucket bigint, a binary, b binary")


def likely(packed: DataFrame, reads: DataFrame, k: int) -> DataFrame:
    """(number, gid): the genes of packed_pairs that may have ``least`` of the k-mers of a read (number, seq, least).

    A gene stands there as gid * 256 + w, w being less than least: it may have w k-mers more than are listed.
    """
    mask = np.int64((1 << _BLOCK) - 1)

    def asking(b: pa.RecordBatch) -> list:
        number = b.column(0).to_numpy()
        row, code = _distinct(*window_codes(b.column(1), k), k)
        block = number[row] >> _BLOCK
        rows = []
        for x in np.unique(block):
            own = np.flatnonzero(block == x)
            rows += [(n, int(x), c, i) for n, c, i in _dealt(_bucket(code[own]), code[own], number[row[own]] & mask)]
        return [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))]

    def needs(b: pa.RecordBatch) -> list:
        number, need = b.column(0).to_numpy(), b.column(1).to_numpy()
        rows = list(_dealt(number >> _BLOCK, number & mask, need))
        return [pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2))]

    def meet(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, ready = [], None, None
        for b in it:
            for bucket, kind, codes, other, block in zip(*(b.column(c).to_pylist() for c in ("bucket", "kind", "a", "b", "block")), strict=True):
                if bucket != at:
                    held, at, ready = [], bucket, None
                if not kind:
                    held.append((_unpack(codes), _unpack(other)))
                    continue
                if ready is None and held:
                    code, gid = (np.concatenate(x) for x in zip(*held, strict=True))
                    order = np.argsort(code)
                    ready, held = (code[order], gid[order]), []
                if ready is None:
                    continue
                code, local = _unpack(codes), _unpack(other)
                low, high = np.searchsorted(ready[0], code, "left"), np.searchsorted(ready[0], code, "right")
                n = high - low
                of = np.repeat(np.arange(len(n)), n)
                gid = ready[1][np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + low[of]]
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([1], pa.int32()), pa.array([_pack(local[of])]), pa.array([_pack(gid)])], ["block", "kind", "a", "b"])

    def settled(block: int, need: list, found: list) -> pa.RecordBatch:
        local, least = (np.concatenate(x) for x in zip(*need, strict=True))
        wanted = np.zeros(mask + 1, np.int64)
        wanted[local] = least
        local, gid = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        names = None
        if len(gid) and int(gid.max()) >> 50 or len(gid) and int(gid.min()) < 0:
            names, gid = np.unique(gid, return_inverse=True)
        keys = np.sort((local << 50) | gid)
        first = _first(keys)
        own, gid = keys[first] >> 50, keys[first] & np.int64((1 << 50) - 1)
        gid = gid if names is None else names[gid]
        kept = np.diff(np.append(first, len(keys))) + (gid & 255) >= wanted[own]
        return pa.RecordBatch.from_arrays([pa.array((block << _BLOCK) | own[kept]), pa.array(gid[kept] >> 8)], ["number", "gid"])

    def settle(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, need, found = None, [], []
        for b in it:
            for block, kind, x, y in zip(*(b.column(c).to_pylist() for c in ("block", "kind", "a", "b")), strict=True):
                if block != at:
                    if at is not None:
                        yield settled(at, need, found)
                    at, need, found = block, [], []
                (found if kind else need).append((_unpack(x), _unpack(y)))
        if at is not None:
            yield settled(at, need, found)

    asked = _mapped(reads.select("number", "seq"), asking, "bucket bigint, block bigint, a binary, b binary")
    met = _met(packed, asked, "bucket").select("bucket", "kind", "a", "b", "block").mapInArrow(meet, "block bigint, kind int, a binary, b binary")
    least = _mapped(reads.select("number", F.col("least").cast("bigint")), needs, "block bigint, a binary, b binary").withColumn("kind", F.lit(0))
    rows = least.select("block", "kind", "a", "b").union(met).repartition("block").sortWithinPartitions("block", "kind")
    return rows.mapInArrow(settle, "number bigint, gid bigint")

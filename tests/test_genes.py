"""The best gene of a read against every gene of every k-mer."""

import os
import random

import pytest

from quillmer import store
from quillmer.operators import genes, index


def naive(reads, pairs, k):
    def kmers(s):
        flip = lambda w: w[::-1].translate(str.maketrans("acgt", "tgca"))
        return {min(s[i : i + k], flip(s[i : i + k])) for i in range(len(s) - k + 1)}

    held, out = {}, {}
    for kmer, gid in pairs:
        held.setdefault(kmer, set()).add(gid)
    for read in {r for r, _ in reads}:
        own = set().union(*(kmers(s) for r, s in reads if r == read))
        n = {}
        for w in own:
            for g in held.get(w, ()):
                n[g] = n.get(g, 0) + 1
        if n:
            gid = min(n, key=lambda g: (-n[g], g))
            out[read] = (gid, n[gid], round(n[gid] / len(own), 9))
    return out


@pytest.mark.parametrize("few", [0, 1, 3, 64])
def test_best_gene_equals_all_genes(spark, few):
    r = random.Random(11)
    block = lambda n: "".join(r.choice("acgt") for _ in range(n))
    heads = [block(24) for _ in range(3)]
    seqs = [(g, heads[g % 3] + (block(20) if g % 4 else "")) for g in range(60)]
    reads = []
    for n in range(300):
        s = r.choice(seqs)[1]
        at = r.randrange(max(1, len(s) - 15))
        reads.append((n // 3 * 2 if n % 5 == 0 else n, s[at : at + 25]))
    reads += [(900, block(30)), (901, "acg"), (902, heads[0][:12] + heads[1][:12])]
    found = index.kmer_taxa(spark.createDataFrame(seqs, "tid bigint, seq string"), 6).withColumnRenamed("tid", "gid")
    got = genes.best_genes(spark.createDataFrame(reads, "read_id bigint, seq string"), found, 6, few).collect()
    assert len({g["read_id"] for g in got}) == len(got)
    assert {g["read_id"]: (g["gid"], g["hits"], round(g["gscore"], 9)) for g in got} == naive(reads, [tuple(p) for p in found.collect()], 6)


def test_wide_kmers_are_not_listed_a_read(spark):
    """A k-mer of many genes in many reads makes neither their product nor a row a gene and read."""
    head, r = "acgtcatgtgcaaggct", random.Random(3)
    seqs = [(g, head + "".join(r.choice("acgt") for _ in range(20))) for g in range(3000)]
    reads = [(n, seqs[n % 3000][1]) for n in range(6000)]
    found = index.kmer_taxa(spark.createDataFrame(seqs, "tid bigint, seq string"), 12).withColumnRenamed("tid", "gid")
    plan = genes.best_genes(spark.createDataFrame(reads, "read_id bigint, seq string"), found, 12)
    got = {x["read_id"]: x["gid"] for x in plan.collect()}
    assert got == {n: n % 3000 for n in range(6000)}


def test_reads_meet_genes_by_code(spark):
    """K-mers go to the genes as codes, from one row a read; a read whose rows share an id is one read, one without an id none."""
    found = spark.createDataFrame([("acgtac", 7), ("ccgtac", 8), ("ccgtac", 9)], "kmer string, gid bigint")
    reads = spark.createDataFrame([(1, "ACGTAC"), (1, "ccgtacn"), (2, "ttgtacgg"), (None, "acgtac"), (3, None)], "read_id bigint, seq string")
    plan = genes.best_genes(reads, found, 6)
    got = {r["read_id"]: (r["gid"], r["hits"], round(r["gscore"], 9)) for r in plan.collect()}
    assert got == {1: (7, 1, 0.5), 2: (8, 1, round(1 / 3, 9))}
    assert "MapInArrow" in genes.read_codes(genes.merged(reads), 6)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [1, 3, 64])
def test_reads_of_several_rows_meet_packed_lists(spark, few, monkeypatch):
    """Reads of several rows, of which a gene has one whole, are settled in parts and without all genes of all k-mers."""
    r = random.Random(5)
    block = lambda n: "".join(r.choice("acgt") for _ in range(n))
    heads = [block(20) for _ in range(3)]
    seqs = [(g, heads[g % 3] + block(30)) for g in range(90)]
    seqs += [(200 + g, heads[0] + seqs[g][1][25:45] + seqs[g + 1][1][22:40]) for g in range(20)]
    reads = [(n // 3, r.choice(seqs)[1][r.randrange(10) :][:30]) for n in range(600)]
    found = index.kmer_taxa(spark.createDataFrame(seqs, "tid bigint, seq string"), 8).withColumnRenamed("tid", "gid")
    late = []
    monkeypatch.setattr(genes, "_AT_ONCE", 250)
    monkeypatch.setattr(genes, "_REST_AT_ONCE", 90)
    whole = genes._by_all_kmers
    monkeypatch.setattr(genes, "_by_all_kmers", lambda reads, *a: late.append(reads.count()) or whole(reads, *a))
    got = genes.best_genes(spark.createDataFrame(reads, "read_id bigint, seq string"), found, 8, few).collect()
    assert {g["read_id"]: (g["gid"], g["hits"], round(g["gscore"], 9)) for g in got} == naive(reads, [tuple(p) for p in found.collect()], 8)
    assert len(got) == 200 and (few < 64 or sum(late) < 100)


def test_tables_of_the_way_are_deleted(spark):
    """What is written on the way to the best genes goes with its last reader; before, every table stayed until the end of the session."""
    folder = store.shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    found = spark.createDataFrame([("acgtac", 7), ("ccgtac", 8), ("ccgtac", 9)], "kmer string, gid bigint")
    got = genes.best_genes(spark.createDataFrame([(1, "acgtac"), (2, "ttgtacgg")], "read_id bigint, seq string"), found, 6)
    assert {r["read_id"]: (r["gid"], r["hits"]) for r in got.collect()} == {1: (7, 1), 2: (8, 1)}
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert not left & {"reads", "found", "checked", "runs"}

"""Coded k-mers and the hits counted over them, against the form by text and by position."""

import random

import pytest
from pyspark.sql import functions as F

from quillmer.functions import kmers
from quillmer.operators import index, labels
from quillmer.plans.fixtures import Fixtures, K

SF = "/root/testdata/sf0.001"
ODD = ["", None, "acg", "ACGTNacgtTTGCA" * 3, "a" * 40, "acgté" * 9, "ggcc" * 30, "n" * 20, "acgtacgtacgtac", "ügatcgatcgatcgatc"]


@pytest.mark.parametrize("k", [1, 5, 12, 31])
def test_codes_equal_texts(spark, k):
    r = random.Random(k)
    seqs = ODD + ["".join(r.choice("acgtACGTn") for _ in range(r.randrange(90))) for _ in range(60)]
    reads = spark.createDataFrame([(str(i % 50), s) for i, s in enumerate(seqs)], "read_id string, seq string")
    want = {(x["read_id"], x["kmer"]) for x in kmers.distinct_kmers(reads, k, keep=("read_id",)).collect()}
    one = kmers.merged(reads)
    assert sorted((x["read_id"], x["kmer"]) for x in kmers.read_texts(one, k, "read_id").collect()) == sorted(want)
    got = kmers.read_codes(one, k).select("read_id", "code", kmers.n_kmers_of(F.col("place")).alias("n"), kmers.gc_bin_of(F.col("place")).alias("gc"))
    codes = {(x["read_id"], x["code"]): (x["n"], x["gc"]) for x in got.collect()}
    text = spark.createDataFrame(sorted(want), "read_id string, kmer string").select("read_id", kmers.encode(F.col("kmer")).alias("code"))
    assert {tuple(x) for x in text.collect()} == set(codes)
    bins = {x["read_id"]: x["gc_bin"] for x in kmers.read_bins(reads, k).collect()}
    many = {i: sum(1 for w in want if w[0] == i) for i in bins}
    assert all(v == (many[i], bins[i]) for (i, _), v in codes.items())


def test_hits_equal_those_by_position(spark):
    f = Fixtures(spark, SF)
    strict = labels.strict_hits(labels.read_kmers(f.reads(), K), f.label_index())
    want = sorted(map(tuple, labels.taxon_hits(strict).collect()))
    assert sorted(map(tuple, f.probs().select("read_id", "tid", "hits").collect())) == want
    given = labels.label_reads(f.reads(), f.label_index(), f.tax(), f.null(), K).select("read_id", "tid", "score").collect()
    own = labels.label_reads(f.reads(), None, f.tax(), f.null(), K, probs=f.probs()).select("read_id", "tid", "score").collect()
    assert sorted((r["read_id"], r["tid"]) for r in given if r["tid"]) == sorted((r["read_id"], r["tid"]) for r in own if r["tid"])


def test_reads_are_not_dealt_by_taxon_and_position(spark):
    """The plan of the hits deals k-mers by code and by read, with no sort of (read, taxon, position) rows from the whole lists."""
    f = Fixtures(spark, SF)
    plan = labels.label_probabilities(f.reads(), f.lists(), K)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list(pos" not in plan and "ShuffledHashJoin" in plan
    assert index.kmer_taxa(f.genomes(), K).count() == f.pairs().count()

import gzip
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from quillmer.operators import content, index, labels, nullmodel, reports, taxonomy
from quillmer.sources import readers, writers
from quillmer.streaming import reads as streams


def tree(n, seed):
    rnd = random.Random(seed)
    parent = {1: 1}
    for t in range(2, n):
        parent[t] = rnd.randrange(1, t)
    return parent


def path(parent, t):
    out = []
    while parent[t] != t:
        t = parent[t]
        out.append(t)
    return out


@pytest.fixture(scope="module")
def tax(spark):
    parent = tree(40, 1)
    rows = [(t, p, f"n{t}", "no_rank" if t == 1 else "species" if t % 3 == 0 else "strain") for t, p in parent.items()]
    return taxonomy.closure(spark.createDataFrame(rows, "tid int, parent int, name string, rank string")).cache(), parent


def test_paths(tax):
    df, parent = tax
    assert {r["tid"]: list(r["path"]) for r in df.collect()} == {t: path(parent, t) for t in parent}


def test_subtree_below_the_common_ancestor(spark, tax):
    df, parent = tax
    rnd = random.Random(2)
    lists = {f"k{i}": rnd.sample(range(1, 40), rnd.randrange(1, 5)) for i in range(60)}
    pairs = spark.createDataFrame([(k, t) for k, ts in lists.items() for t in ts] + [("k0", 999)], "kmer string, tid int")
    got = {}
    for r in index.subtree(pairs, df).collect():
        got.setdefault(r["kmer"], set()).add(r["tid"])
    for k, ts in lists.items():
        chains = [[t, *path(parent, t)] for t in ts]
        common = [n for n in chains[0] if all(n in c for c in chains)]
        assert got[k] == {n for c in chains for n in c if n not in common[1:]}


def test_rank_pruning_drops_whole_groups(spark):
    pairs = spark.createDataFrame([("a", t) for t in range(1, 8)] + [("b", 1), ("c", 5), ("c", 6), ("c", 7)], "kmer string, tid int")
    ranks = spark.createDataFrame([(1, 1), (2, 12), (3, 14), (4, 14), (5, 16), (6, 16), (7, 16)], "tid int, nrank int")
    got = sorted((r["kmer"], r["tid"]) for r in index.rank_pruned(pairs, ranks, 2).collect())
    assert got == [("a", 1), ("a", 2), ("b", 1), ("c", 1)]


def test_the_call():
    c = lambda tid, depth, score, p: {"tid": tid, "depth": depth, "score": score, "path": p}
    line = [c(1, 0, 1.0, []), c(2, 1, 2.0, [1]), c(3, 2, 3.0, [2, 1])]
    assert labels.decide(line, 3.0, 0.5) == (3, 3.0, labels.DIRECT)
    rival = [c(1, 0, 1.0, []), c(2, 1, 2.9, [1]), c(4, 2, 2.95, [2, 1]), c(3, 2, 3.0, [2, 1])]
    assert labels.decide(rival, 3.0, 0.5)[0::2] == (2, labels.MULTI)
    far = [c(1, 0, 1.0, []), c(4, 2, 1.1, [2, 1]), c(2, 1, 2.9, [1]), c(3, 2, 3.0, [2, 1])]
    assert labels.decide(far, 3.0, 0.5)[0] == 3
    plasmid = [c(2, 1, 3.0, [1]), c(10_000_001, 2, 3.0, [2, 1])]
    assert labels.decide(plasmid, 3.0, 0.5)[0] == 10_000_001
    tied = [c(2, 1, 3.0, [1]), c(10_000_001, 2, 3.0, [2, 1]), c(10_000_002, 2, 3.0, [2, 1])]
    assert labels.decide(tied, 3.0, 0.5)[0::2] == (10_000_001, labels.MULTI)  # the last looked at
    assert labels.decide([c(2, 1, 2.0, [1]), c(77, 2, 3.0, [2, 1]), c(78, 2, 3.0, [2, 1])], 3.0, 0.5, frozenset({77}))[0] == 77
    biased = [{**c(1, 0, 1.0, []), "plain": 1.0}, {**c(5, 2, 2.5, [9606, 1]), "plain": 2.5}, {**c(9606, 1, 4.0, [1]), "plain": 2.0}]
    assert labels.decide(biased, 2.5, 0.1) == (5, 2.5, labels.DIRECT)
    apart = [c(6, 1, 2.99, [8]), c(5, 1, 3.0, [7])]
    assert labels.decide(apart, 3.0, 0.5) == (0, -1.0, labels.LCA_ERROR)
    assert labels.decide([], 0.0, 0.5)[2] == labels.NONE


def test_deep_chains_cycles_and_loose_ends(spark):
    shape = "tid int, parent int, name string, rank string"
    chain = spark.createDataFrame([(1, 1, "r", None), *((t, t - 1, "n", None) for t in range(2, 301)), (900, 899, "x", None)], shape)
    got = {r["tid"]: (r["depth"], list(r["path"])) for r in taxonomy.closure(chain).collect()}
    assert got[300] == (299, list(range(299, 0, -1))) and got[1] == (0, []) and got[900] == (1, [899])
    with pytest.raises(ValueError):
        taxonomy.closure(spark.createDataFrame([(1, 1, "r", None), (2, 3, "a", None), (3, 4, "b", None), (4, 2, "c", None)], shape))


def test_a_taxon_without_a_null_model_never_wins(spark, tax):
    df, _ = tax
    probs = spark.createDataFrame([("r", 2, 3, 0.5, 9), ("r", 3, 3, 0.5, 9)], "read_id string, tid int, gc_bin int, prob double, n_kmers int")
    null = spark.createDataFrame([(2, 3, 0.1)], "tid int, gc_bin int, cutoff double")
    got = {r["tid"]: (r["random_prob"], r["score"]) for r in labels.log_odds(probs, null, df).collect()}
    assert got[3][0] == 1.0 and got[3][1] == pytest.approx(math.log(0.5)) and got[2][1] == pytest.approx(math.log(0.5 / 0.1001))
    assert {r["score"] for r in labels.log_odds(probs, None, df).collect()} == {0.5}
    by = labels.log_odds(probs, null.withColumn("read_kmers", F.lit(10)), df, [10, 30])
    assert {r["tid"]: r["score"] for r in by.collect()} == pytest.approx({t: s for t, (_, s) in got.items()})
    far = labels.log_odds(probs.withColumn("n_kmers", F.lit(29)), null.withColumn("read_kmers", F.lit(10)), df, [10, 30])
    assert {r["score"] for r in far.collect()} == {0.5}


def test_phage_screen_human_bias_and_thresholds(spark):
    shape = "read_id string, n_kmers bigint, n_found bigint, avg double, stdev double, top double, cands array<struct<rounded:double,depth:int,tid:int,score:double,plain:double,path:array<int>>>"
    one = lambda tid, depth, score, path: (round(score, 3), depth, tid, score, score, path)
    cands = [one(1, 0, 1.0, []), one(5, 1, 2.0, [1]), one(10847, 2, 2.0, [5, 1])]
    df = spark.createDataFrame([("a", 40, 9, 1.0, 0.1, 2.0, cands), ("b", 40, 1, 1.0, 0.1, 2.0, cands), ("c", 10, 9, 1.0, 0.1, 2.0, cands)], shape)
    got = {r["read_id"]: tuple(r)[1:4] for r in labels.call_reads(df, min_kmers=20, min_found=2).collect()}
    assert got == {"a": (32630, 2.0, "DirectMatch"), "b": (0, -1.0, "NoMatch"), "c": (0, -1.0, "NoMatch")}
    assert labels.call_reads(df, phix_screen=False).first()["tid"] == 10847
    reads = spark.createDataFrame([("a", "acgt" * 12), ("b", "acgt" * 12), ("d", "acgt" * 12), ("e", "ac")], "read_id string, seq string")
    out = {r["read_id"]: r["reason"] for r in labels.outcome(reads, labels.call_reads(df, min_kmers=20, min_found=2), 12, 20, 3.0).collect()}
    assert out == {"a": labels.LOW, "b": labels.NO_HITS, "d": labels.NO_HITS, "e": labels.SHORT}


def test_second_peak(spark):
    rows = [(1, 8, i + 1, n) for i, n in enumerate([90, 40, 10, 30, 60, 20])] + [(2, 8, i + 1, n) for i, n in enumerate([9, 5, 1])]
    got = {r["tid"]: r["peak"] for r in content.second_peak(spark.createDataFrame(rows, "tid int, k int, cnt int, n_kmers int")).collect()}
    assert got == {1: 5, 2: -1}


def test_fasta_and_fastq(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one x \nACG\nT\n>two\n\n>3\nGG>GG\n")
    got = [(r["header"], r["seq"]) for r in readers.read_reads(spark, str(tmp_path / "a.fa")).collect()]
    assert got == [("one x", "ACGT"), ("two", ""), ("3", "GG>GG")]
    (tmp_path / "c.fa").write_bytes(b">one x\r\nACG\r\nT\r\n>two\r\n\r\n>3\r\nGG\r\n")
    got = [(r["header"], r["seq"]) for r in readers.read_fasta(spark, str(tmp_path / "c.fa")).collect()]
    assert got == [("one x", "ACGT"), ("two", ""), ("3", "GG")]
    assert [r["read_id"] for r in labels.named(spark.createDataFrame([("", "a"), ("h", "a")], "header string, seq string")).collect()][1] == "h"
    (tmp_path / "b.fq").write_text("@r1\nACGT\n+\nIIII\n@r2\nGG\n+\n@I\n")
    got = [(r["header"], r["seq"]) for r in readers.read_reads(spark, str(tmp_path / "b.fq")).collect()]
    assert got == [("r1", "ACGT"), ("r2", "GG")]


def test_labelled_reads_round_trip(spark, tmp_path):
    shape = "read_id string, seq string, avg double, stdev double, n_kmers int, candidates array<struct<tid:int,score:double>>, tid int, score double, match_type string"
    rows = [("r1", "acgt", 1.5, 0.5, 9, [(7, 2.0), (1, 0.5)], 7, 2.0, "DirectMatch"), ("r2", "a", None, None, 0, [], None, None, "NoDbHits")]
    df = spark.createDataFrame(rows, shape)
    writers.write_labelled(df, str(tmp_path / "out"))
    got = {r["read_id"]: r for r in readers.read_labelled(spark, str(tmp_path / "out")).collect()}
    assert got["r1"]["tid"] == 7 and [tuple(c) for c in got["r1"]["candidates"]] == [(7, 2.0), (1, 0.5)] and got["r2"]["candidates"] == []


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fa").write_text(">r1\nacgta\n>r2\nacgtt\n")
    idx = spark.createDataFrame([("acg", 5), ("cgt", 6), ("aac", 7)], "kmer string, tid int")
    q = streams.running_hits(streams.stream_fasta(spark, str(tmp_path / "in")), idx, 3).writeStream.format("memory").queryName("hits").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["tid"]: r["hits"] for r in spark.table("hits").collect()} == {5: 2, 7: 1}


def test_index_store(spark, tmp_path):
    pairs = spark.createDataFrame([("acg", 5), ("acg", 6), ("ttt", 7)], "kmer string, tid int")
    index.write_index(pairs, str(tmp_path / "i"), 3)
    got = {r["kmer"]: list(r["tids"]) for r in index.read_index(spark, str(tmp_path / "i")).collect()}
    assert got == {6: [5, 6], 63: [7]}


def test_fastq_lines_that_look_like_headers(spark, tmp_path):
    records = [(f"r{i} x", "acgt" * (i % 4), "@+I@"[i % 4 :] + "@" * (4 * (i % 4))) for i in range(300)]
    for part, some in enumerate((records[:200], records[200:])):
        text = "".join(f"@{h}\n{s}\n+{h}\n{q}\n" for h, s, q in some)
        (tmp_path / f"{part}.fastq").write_text(text if part else text.replace("\n", "\r\n"))
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, "512")
    try:
        from quillmer.sources.readers import read_fastq

        df = read_fastq(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        assert sorted(map(tuple, df.collect())) == sorted(records)
    finally:
        spark.conf.unset(key)


def test_tree_histogram_and_null_model_files(spark, tmp_path):
    (tmp_path / "t.dat").write_text("# a\n# b\n3\n1 1 2 1\nroot\n2 1 3 1\nmid\n3 0 2\nleaf x\n")
    assert {r["tid"]: (r["name"], list(r["path"])) for r in readers.read_tree(spark, str(tmp_path / "t.dat")).collect()} == {1: ("root", []), 2: ("mid", [1]), 3: ("leaf x", [2, 1])}
    (tmp_path / "h.txt").write_text("acgt 3 2 2 7 1 8 0\n27 1 0 0\n")
    assert [(r["kmer"], list(r["tids"])) for r in readers.read_legacy_histogram(spark, str(tmp_path / "h.txt")).collect()] == [(27, [7]), (27, [])]
    with gzip.open(tmp_path / "n.gz", "wt") as f:
        f.write("2\n5 genus-5 1 0.25 900 0 0 900\n562 no_rank-1 4 0.5 10 0 0 10\n28384 species-2 0 0 5 0 0 5\n")
    (tmp_path / "list").write_text(f"61 {tmp_path}/n.gz\n")
    model = readers.read_null_models(spark, str(tmp_path / "list"))
    assert {(r["tid"], r["read_kmers"]) for r in model.collect()} == {(5, 61), (562, 61), (28384, 61)}
    got = {r["tid"]: (r["rank_class"], list(r["cutoff"])) for r in nullmodel.load(model.drop("read_kmers")).collect()}
    assert got == {5: ("genus", [0.25, 0.25]), 562: ("genus", [0.5, 0.5]), 28384: ("genus", [0.5, 0.5])}
    assert nullmodel.read_kmer_buckets(nullmodel.read_lengths(80, 100, 20)) == [61, 81]


def test_binary_k_mer_files(spark, tmp_path):
    for wide, every, form in ((True, 1000, "<QI"), (False, 1500, "<QH")):
        rows = [(i * 3, [i % 7, 9] if i % 5 else [4]) for i in range(3200)]
        mark = (1 << 64) - 1
        body = b"".join(
            struct.pack(form, k, len(t)) + struct.pack(f"<{len(t)}I", *t) + (struct.pack("<Q", mark) if (i + 1) % every == 0 else b"") for i, (k, t) in enumerate(rows)
        )
        head = struct.pack("<IQQIcI", 29, len(rows), mark, 999, b"N", 20)
        (tmp_path / f"k{wide}").write_bytes(head + body)
        assert [(r["kmer"], list(r["tids"])) for r in readers.read_kmer_records(spark, str(tmp_path / f"k{wide}"), wide).collect()] == rows


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "feed").write_text("ACGT tttt\naaaa\n\n")
    assert {r[0] for r in readers.read_feed(spark, str(tmp_path / "feed")).collect()} == {"acgt", "aaaa"}
    (tmp_path / "l").write_text("depth=1,taxid=7,ktaxid=7,entries=-1\tgenus,A\tspecies,B\n")
    assert tuple(readers.read_lineage(spark, str(tmp_path / "l")).first()) == (7, "species,B")
    (tmp_path / "nodes").write_text("1\t|\t1\t|\tno rank\t|\n2\t|\t1\t|\tsub species\t|\n")
    (tmp_path / "names").write_text("1\t|\troot\t|\t\t|\tscientific name\t|\n2\t|\tx\t|\t\t|\tscientific name\t|\n2\t|\ty\t|\t\t|\tsynonym\t|\n")
    assert {r["tid"]: (r["name"], r["rank"], r["depth"]) for r in readers.read_nodes(spark, str(tmp_path / "nodes"), str(tmp_path / "names")).collect()} == {1: ("root", "no_rank", 0), 2: ("x", "sub_species", 1)}
    (tmp_path / "ranks").write_text("7 genus\n8 species\n")
    assert readers.read_columns(spark, str(tmp_path / "ranks"), "tid int, rank string").count() == 2
    df = spark.createDataFrame([("7", "h1", "acgt" * 30), ("LowScore", "h2", "ac")], "main string, header string, seq string")
    writers.write_fasta(df, str(tmp_path / "fa"))
    back = {r["header"]: r["seq"] for r in readers.read_fasta(spark, [str(p) for p in (tmp_path / "fa").glob("main=*")]).collect()}
    assert back == {"h1": "acgt" * 30, "h2": "ac"}
    assert max(map(len, next((tmp_path / "fa" / "main=7").glob("*.txt")).read_text().split("\n"))) == 80
    fq = spark.createDataFrame([("r1", "ac", "II")], "header string, seq string, qual string")
    writers.write_fastq(fq, str(tmp_path / "fq"))
    assert [tuple(r) for r in readers.read_fastq(spark, str(tmp_path / "fq")).collect()] == [("r1", "ac", "II")]
    summary = spark.createDataFrame([(1.5, 3, 7, "a"), (9.0, 2, 8, "b")], "wrc double, rc bigint, tid int, name string")
    writers.write_summary(summary, str(tmp_path / "sum"), ["wrc", "rc", "tid", "name"], "wrc")
    assert [(r["tid"], r["avg"]) for r in readers.read_summary(spark, str(tmp_path / "sum")).collect()] == [(8, 4.5), (7, 0.5)]
    (tmp_path / "g.fa").write_text(">12\nacgt\n>x\nac\n")
    assert [tuple(r) for r in readers.read_genomes(spark, str(tmp_path / "g.fa")).collect()] == [(12, "acgt")]
    writers.write_kmers(spark.createDataFrame([("acg", [5, 6])], "kmer string, tids array<int>"), str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).first()[0] == "acg 5 6"
    leaves = spark.createDataFrame([(9, 2)], "tid int, parent int")
    nodes = spark.createDataFrame([(1, 1, "r", "x"), (2, 1, "p", "x")], "tid int, parent int, name string, rank string")
    assert tuple(taxonomy.insert_leaves(nodes, leaves).where("tid = 9").first()) == (9, 2, "p", "strain")
    assert "<name>a</name>" in reports.organisms_xml(summary).first()[0].replace("\n", "")


def test_routed_lookup(spark, tmp_path):
    pairs = spark.createDataFrame([("acg", 5), ("acg", 6), ("ttt", 7)], "kmer string, tid int")
    index.write_index(pairs, str(tmp_path / "i"), 3)
    codes = spark.createDataFrame([(6,), (63,), (5,)], "code bigint")
    assert {r["code"]: r["tids"] for r in index.routed_lookup(spark, str(tmp_path / "i"), codes, 3).collect()} == {6: [5, 6], 63: [7], 5: None}

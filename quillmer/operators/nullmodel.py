"""Null model: random reads by GC bin, observed label probabilities, and gap filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kmers import valid_count
from ..store import stored
from . import labels, taxonomy


def random_reads(spark: SparkSession, per_bin: int, length: int, bins: int = 10, seed: int = 1) -> DataFrame:
    """(read_id, gc_bin, seq): per_bin reads a GC bin, the same for any partitioning (all bits come from hashes of the id)."""
    draw = lambda *c: F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(1 << 20)) / float(1 << 20)
    width = 100 // bins
    base = spark.range(per_bin * bins).select(F.col("id").alias("read_id"), (F.col("id") % bins).cast("int").alias("gc_bin"))
    gc = (F.col("gc_bin") * width + F.floor(draw("read_id", F.lit(-1)) * width)) / 100.0
    base = base.withColumn("n_gc", F.floor(gc * length))
    order = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.struct(draw("read_id", F.lit(2), i).alias("d"), i.alias("i"))))
    pick = lambda x: F.when(x["i"] < F.col("n_gc"), F.when(draw("read_id", F.lit(3), x["i"]) < 0.5, "g").otherwise("c")).otherwise(
        F.when(draw("read_id", F.lit(3), x["i"]) < 0.5, "a").otherwise("t")
    )
    return base.select("read_id", "gc_bin", F.array_join(F.transform(order, pick), "").alias("seq"))


def observed(probs: DataFrame) -> DataFrame:
    """(tid, gc_bin, max_prob, n): over labelled random reads (read_id, tid, gc_bin, prob)."""
    return probs.groupBy("tid", "gc_bin").agg(F.max("prob").alias("max_prob"), F.count("*").alias("n"))


def as_arrays(bins_table: DataFrame, bins: int = 10) -> DataFrame:
    """(tid, obs, cutoff): arrays over the bins, zeros where nothing was seen."""
    at = lambda c, zero: F.array(*[F.coalesce(F.max(F.when(F.col("gc_bin") == b, F.col(c))), F.lit(zero)) for b in range(bins)])
    return bins_table.groupBy("tid").agg(at("n", 0).alias("obs"), at("max_prob", 0.0).alias("cutoff"))


def fill_gaps(model: DataFrame, enough: int = 100_000) -> DataFrame:
    """model (tid, kcnt, obs, cutoff) with empty bins filled.

    An empty bin of a taxon with ``enough`` k-mers gets 0.5. Those of a smaller one
    are filled from the first bin on: from the nearest bin above 0 (already filled
    ones too), the larger of two equally near, 0.5 if there is none.
    """
    n = F.size("cutoff")
    seen = F.transform("cutoff", lambda c, i: F.when(F.get("obs", i) > 0, c).when(F.col("kcnt") >= enough, F.lit(0.5)).otherwise(F.lit(0.0)))

    def fill(done: Column, i: Column) -> Column:
        at = lambda d: F.greatest(F.coalesce(F.get(done, i - d), F.lit(0.0)), F.coalesce(F.get(done, i + d), F.lit(0.0)))
        near = F.get(F.filter(F.transform(F.sequence(F.lit(1), n), at), lambda v: v > 0), F.lit(0))
        return F.transform(done, lambda c, j: F.when(j == i, F.coalesce(near, F.lit(0.5))).otherwise(c))

    empty = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.get("obs", i) == 0) & (F.col("kcnt") < enough))
    return model.withColumn("_seen", seen).withColumn("cutoff", F.aggregate(empty, F.col("_seen"), fill)).drop("_seen")


def load(model: DataFrame, enough: int = 100_000) -> DataFrame:
    """A model as read (tid, class_tid, obs, cutoff, kcnt) made ready: (tid, rank_class, cutoff).

    Classes that begin with ``no_`` count as genus. The other-sequences taxon is a
    genus with the observed values of E. coli, 0.5 where that has none.
    """
    filled = fill_gaps(model, enough)
    kind = F.regexp_extract("class_tid", "^([^-]*)", 1)
    other = F.col("tid") == taxonomy.OTHER_SEQUENCES
    rank = F.when(kind.startswith("no_") | other, "genus").otherwise(kind)
    coli = model.where(F.col("tid") == taxonomy.E_COLI).select(F.transform("cutoff", lambda c, i: F.when(F.get("obs", i) > 0, c).otherwise(0.5)).alias("coli"))
    coli = coli.agg(F.first("coli").alias("coli"))  # one row
    half = F.transform("cutoff", lambda c: F.lit(0.5))
    return filled.crossJoin(F.broadcast(coli)).select("tid", rank.alias("rank_class"), F.when(other, F.coalesce("coli", half)).otherwise(F.col("cutoff")).alias("cutoff"))


def of_random_reads(probs: DataFrame, reads: DataFrame) -> DataFrame:
    """observed() of labelled random reads: probs (read_id, tid, prob) and reads (read_id, gc_bin)."""
    return observed(probs.select("read_id", "tid", "prob").join(reads.select("read_id", "gc_bin"), "read_id"))


def label_random(reads: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(read_id, tid, prob) of random reads (read_id, seq) against a strict index; prob is a share of all valid windows, repeats included."""
    hits = labels.taxon_hits(labels.strict_hits(labels.read_kmers(reads, k), index))
    windows = reads.select("read_id", valid_count(F.col("seq"), k).alias("n"))
    return hits.join(windows, "read_id").select("read_id", "tid", (F.col("hits") / F.col("n")).alias("prob"))


# Ranks whose nodes gather observations, and the genera whose observations are pooled.
GATHERING, POOLED, POOL = ("genus", "family", "order", "class", "phylum", "kingdom", "domain", "life"), (561, 620), 561


def roll_up(model: DataFrame, tax: DataFrame, counts: DataFrame, ratio: float = 100.0, enough: int = 100_000, least_obs: int = 1, bins: int = 10) -> DataFrame:
    """(tid, node, gc_bin, max_prob, n): the null model of every taxon of the index, from observed rows (tid, gc_bin, max_prob, n).

    counts: (tid, n), k-mers of each taxon. Observations gather at the nearest ancestor
    of a gathering rank (for human its species). Plasmids lend none, nor do prokaryotes
    and other sequences with less than ``enough`` k-mers. A taxon takes, in each bin, the
    largest value at its nearest ancestor with any, from taxa with more than a ``ratio``-th
    of its k-mers; if there are none, those of the taxon nearest to that. A plasmid counts
    as large as its parent. Eukaryotes at a genus take the values of E. coli, other
    sequences the pooled ones, the root 1. Bins with less than ``least_obs`` observations
    copy the nearest filled one, of two the lower.
    """
    human, plasmid = taxonomy.is_human(F.col("tid")), (F.col("tid") >= taxonomy.PLASMID_FROM) & ~taxonomy.is_human(F.col("tid"))
    ranks = tax.select(F.col("tid").alias("node"), F.col("rank").alias("node_rank"), F.col("depth").alias("d"))
    gathers = F.col("node_rank").isin(*GATHERING) | ((F.col("node_rank") == "species") & human)
    up = taxonomy.ancestors(tax, False).join(ranks, "node").where(gathers)
    under = lambda *heads: F.arrays_overlap(F.concat(F.array("tid"), F.col("path")), F.array(*map(F.lit, heads)))
    facts = tax.select("tid", "parent", under(*taxonomy.PROKARYOTES, taxonomy.OTHER_SEQUENCES).alias("small"), under(taxonomy.EUKARYOTES).alias("euk"), under(taxonomy.OTHER_SEQUENCES).alias("other"))
    pool = lambda c: F.when(F.col(c).isin(*POOLED), F.lit(POOL)).otherwise(F.col(c))

    first_up = up.groupBy("tid").agg(F.max_by("node", "d").alias("node"))
    lenders = model.join(counts.withColumnRenamed("n", "k"), "tid").join(facts, "tid").where(~plasmid & ~(F.col("small") & (F.col("k") < enough)))
    lent = lenders.join(first_up, "tid").select(pool("node").alias("node"), "gc_bin", "max_prob", F.col("n").alias("obs"), "k")
    lent = stored(tax.sparkSession, lent.groupBy("node", "k", "gc_bin").agg(F.max(F.struct("max_prob", "obs")).alias("v")), "lent")

    sized = facts.join(counts.withColumnRenamed("n", "k_own"), "tid", "left")
    parents = counts.select(F.col("tid").alias("parent"), F.col("n").alias("k_parent"))
    sized = sized.join(parents, "parent", "left").withColumn("k_own", F.coalesce(F.when(plasmid, F.col("k_parent")), F.col("k_own"))).where("k_own is not null")
    holds = lent.select("node").distinct()
    nearest = up.withColumn("node", pool("node")).join(holds, "node", "left_semi").groupBy("tid").agg(F.max_by(F.struct("node", "node_rank"), "d").alias("at"))
    mine = sized.join(nearest, "tid", "left").withColumn("rank", F.col("at.node_rank"))
    coli = F.col("euk") & (F.col("rank") == "genus") & ~human
    mine = mine.withColumn("node", F.when(coli | F.col("other"), F.lit(POOL)).otherwise(F.col("at.node")))
    mine = mine.withColumn("k_own", F.when(coli, F.lit(None).cast("bigint")).otherwise(F.col("k_own")))
    k_coli = counts.where(F.col("tid") == taxonomy.E_COLI).agg(F.first("n").alias("k_coli"))  # one row
    mine = mine.crossJoin(F.broadcast(k_coli)).withColumn("k_own", F.coalesce("k_own", "k_coli"))

    met = mine.select("tid", "node", "k_own").join(lent, "node").withColumn("off", F.col("k_own") / F.col("k"))
    near = F.col("off") < ratio
    best = met.groupBy("tid", "node", "gc_bin").agg(F.max(F.when(near, F.col("v"))).alias("v"), F.min_by("v", "off").alias("w"), F.count_if(near).alias("n_near"))
    some = F.max("n_near").over(Window.partitionBy("tid")) > 0
    flat = best.withColumn("v", F.when(some, F.col("v")).otherwise(F.col("w"))).select("tid", "node", "gc_bin", "v.max_prob", "v.obs")
    at = lambda c, zero: F.array(*[F.coalesce(F.max(F.when(F.col("gc_bin") == b, F.col(c))), F.lit(zero)) for b in range(bins)]).alias(c)
    wide = mine.select("tid", "node").join(flat.drop("node"), "tid", "left").groupBy("tid", "node").agg(at("max_prob", 0.0), at("obs", 0))

    def copied(p: Column, i: Column) -> Column:
        good = F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.get("obs", j) >= least_obs)
        nearest_bin = F.get(F.array_sort(F.transform(good, lambda j: F.struct(F.abs(j - i).alias("far"), j.alias("j")))), F.lit(0))["j"]
        return F.when(F.get("obs", i) >= least_obs, p).otherwise(F.coalesce(F.get("max_prob", nearest_bin), p))

    filled = wide.withColumn("filled", F.when(F.col("tid") == taxonomy.ROOT, F.transform("max_prob", lambda p: F.lit(1.0))).otherwise(F.transform("max_prob", copied)))
    rows = filled.select("tid", "node", "obs", F.posexplode("filled").alias("gc_bin", "max_prob"))
    return rows.select("tid", "node", "gc_bin", "max_prob", F.get("obs", F.col("gc_bin")).alias("n"))


def neighbour_statistics(seen: DataFrame, least: int) -> DataFrame:
    """(tid, low, high, mean, stdev, n) of observations seen (tid, kcnt, prob), pooled over taxa of like k-mer count.

    Counts are grouped by powers of two; a group with less than ``least`` observations
    takes in the groups on both sides until it has enough, or all.
    """
    groups = seen.withColumn("g", F.floor(F.log2(F.greatest("kcnt", F.lit(1)))).cast("int"))
    by = groups.groupBy("g").agg(F.count("*").alias("n"), F.sum("prob").alias("s"), F.sum(F.col("prob") * F.col("prob")).alias("q"), F.min("prob").alias("lo"), F.max("prob").alias("hi"))
    one = by.agg(F.collect_list(F.struct(*by.columns)).alias("all"))  # at most 64 groups
    reach = lambda g, r: F.filter("all", lambda x: F.abs(x["g"] - g) <= r)
    count = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    wide = by.select("g").crossJoin(F.broadcast(one))
    r = F.get(F.filter(F.sequence(F.lit(0), F.lit(64)), lambda r: (count(reach(F.col("g"), r)) >= least) | (r == 64)), F.lit(0))
    got = wide.withColumn("r", r).withColumn("near", reach(F.col("g"), F.col("r")))
    total = lambda c: F.aggregate("near", F.lit(0.0), lambda a, x: a + x[c])
    got = got.select(
        "g", F.array_min(F.transform("near", lambda x: x["lo"])).alias("low"), F.array_max(F.transform("near", lambda x: x["hi"])).alias("high"),
        (total("s") / total("n")).alias("mean"), total("q").alias("q"), total("s").alias("s"), total("n").alias("n"),
    )
    stdev = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1), F.lit(0.0)))).otherwise(0.0)
    stats = got.select("g", "low", "high", "mean", stdev.alias("stdev"), F.col("n").cast("bigint").alias("n"))
    return groups.select("tid", "g").distinct().join(stats, "g").drop("g")


def read_lengths(first: int, last: int, step: int) -> list[int]:
    """The read lengths that null models are made for."""
    return list(range(first, last + 1, step))


def read_kmer_buckets(lengths: list[int], k: int = 20) -> list[int]:
    """k-mers per read for each read length, sorted."""
    return sorted(n - k + 1 for n in lengths)

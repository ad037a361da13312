"""Read labelling: k-mer hits, scores, log-odds against a null model, and the call.

What a k-mer's list says by itself (which of its taxa are most specific, their
paths) is worked out once, when the index is made ready for labelling; reads meet
that index in one join. All later steps work inside a read: hits are dealt by
read_id once, sorted, and counted in numpy (hits.py). The greedy lineage decision
is Python, on Arrow batches with one row a read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kmers import distinct_kmers, encode, merged, read_codes, valid_count
from . import hits, taxonomy

# Reasons and match types.
SHORT, NO_HITS, LOW = "ReadTooShort", "NoDbHits", "LowScore"
DIRECT, MULTI, NONE, LCA_ERROR = "DirectMatch", "MultiMatch", "NoMatch", "LCA_ERROR"


def read_kmers(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, kmer, pos): distinct canonical k-mers of each read. Reads are dealt by read_id, their k-mers are not shuffled."""
    return distinct_kmers(reads.select("read_id", "seq").repartition("read_id"), k, keep=("read_id",))


def named(reads: DataFrame) -> DataFrame:
    """reads (header, seq) with read_id: the header, or ``unknown_hdr:`` and a hash of the sequence where it is empty."""
    unnamed = F.concat(F.lit("unknown_hdr:"), F.lower(F.hex(F.xxhash64("seq"))))
    return reads.withColumn("read_id", F.when(F.trim("header") != "", F.col("header")).otherwise(unnamed))


def clean_tid(tid: Column) -> Column:
    """The human group as one taxon; null for ignored taxa."""
    return F.when(tid.isin(*taxonomy.HUMAN_GROUP), F.lit(taxonomy.HUMAN)).when(~tid.isin(*taxonomy.IGNORED), tid)


def clean_pairs(pairs: DataFrame) -> DataFrame:
    """(kmer, tid) with clean_tid applied."""
    return pairs.select("kmer", clean_tid(F.col("tid")).alias("tid")).where("tid is not null").distinct()


def strict_lists(pairs: DataFrame, tax: DataFrame) -> DataFrame:
    """The index ready for strict labelling: (kmer, l), taxa with tid, path, species (of strains only) and strain.

    Of a k-mer's taxa those that are ancestors of another one are left out. Lists
    must be pruned (a bounded number of taxa a k-mer), as each becomes one row on
    the way; taxa that the taxonomy lacks are dropped.
    """
    tax = taxonomy.single(tax)
    species = taxonomy.species_map(tax.select("tid", "rank", "depth", "path")).withColumnRenamed("species", "_s")
    strain = F.coalesce(F.col("rank") == "strain", F.lit(False)).alias("strain")
    known = tax.join(species, "tid").select("tid", "path", F.when(F.col("rank") == "strain", F.col("_s")).alias("species"), strain)
    one = F.struct("tid", "path", "species", "strain")
    by = clean_pairs(pairs).join(known, "tid").groupBy("kmer").agg(F.collect_list(one).alias("l"))
    above = F.array_distinct(F.flatten(F.transform("l", lambda x: x["path"])))
    return by.withColumn("above", above).select("kmer", F.filter("l", lambda x: ~F.array_contains(F.col("above"), x["tid"])).alias("l"))


def strict_index(pairs: DataFrame, tax: DataFrame) -> DataFrame:
    """(kmer, tid, path, species, strain): strict_lists with a row a taxon."""
    return strict_lists(pairs, tax).select("kmer", F.explode("l").alias("x")).select("kmer", "x.*")


def permissive_index(pairs: DataFrame, tax: DataFrame) -> DataFrame:
    """(kmer, tid): every taxon with its whole path, for permissive labelling."""
    return clean_pairs(pairs).join(taxonomy.ancestors(tax, True), "tid").select("kmer", F.col("node").alias("tid")).distinct()


def position_taxa(kmers: DataFrame, index: DataFrame) -> DataFrame:
    """(read_id, pos, tid): taxa of every k-mer found in an index made ready (kmer, tid)."""
    return kmers.join(index.select("kmer", "tid"), "kmer").select("read_id", "pos", "tid")


def strict_hits(kmers: DataFrame, index: DataFrame) -> DataFrame:
    """(read_id, tid, path, species, strain, places): per read the most specific taxa and the positions of each, dealt by read_id."""
    found = kmers.join(index, "kmer").select("read_id", "pos", "tid", "path", "species", "strain").repartition("read_id")
    return found.groupBy("read_id", "tid").agg(
        F.first("path").alias("path"), F.first("species").alias("species"), F.first("strain").alias("strain"), F.collect_list("pos").alias("places")
    )


def representative_strains(strict: DataFrame) -> DataFrame:
    """strict_hits with ``represents``: whether a strain is its species' one at most positions in the read, of equals the smallest."""
    first = F.row_number().over(Window.partitionBy("read_id", "species").orderBy(F.desc(F.size("places")), "tid")) == 1
    return strict.withColumn("represents", F.col("strain") & F.col("species").isNotNull() & first)


def taxon_hits(strict: DataFrame) -> DataFrame:
    """(read_id, tid, hits): positions of each taxon and of the ancestors that it lends them to.

    Ancestors get the positions of taxa that are no strains, and of the strains
    that represent their species.
    """
    lends = ~F.col("strain") | F.col("represents")
    nodes = F.when(lends, F.concat(F.array("tid"), F.col("path"))).otherwise(F.array("tid"))
    each = representative_strains(strict).select("read_id", F.explode(nodes).alias("tid"), "places")
    return each.groupBy("read_id", "tid").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("bigint").alias("hits"))


def packed(lists: DataFrame) -> DataFrame:
    """strict_lists in the form that reads meet: (code, nodes, tids, species, sizes, lends), flat lists of ids.

    nodes are the taxa and the ancestors of those that are no strains; tids and
    species are those of strains that may represent a species, sizes and lends the
    ancestors that each lends and that are not among the nodes.
    """
    lent = F.flatten(F.transform(F.filter("l", lambda x: ~x["strain"]), lambda x: x["path"]))
    nodes = F.array_distinct(F.concat(F.transform("l", lambda x: x["tid"]), lent))
    some = F.filter("l", lambda x: x["strain"] & x["species"].isNotNull())
    full = lists.select(encode(F.col("kmer")).alias("code"), nodes.alias("nodes"), some.alias("s"))
    full = full.withColumn("more", F.transform("s", lambda x: F.array_except(x["path"], F.col("nodes"))))
    own = lambda name: F.transform("s", lambda x: x[name]).alias(name if name == "species" else "tids")
    return full.select("code", "nodes", own("tid"), own("species"), F.transform("more", F.size).alias("sizes"), F.flatten("more").alias("lends"))


def label_probabilities(reads: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(read_id, tid, hits, n_kmers, n_found, gc_bin, prob): n_kmers are the read's distinct k-mers, n_found those in the index, prob is hits / n_kmers.

    lists are those of packed. The same hits as taxon_hits counts: a k-mer meets its
    list in one row, and a read's rows, brought together by one sort, are counted in
    numpy. Ancestors that only representing strains lend are told apart by position.
    """
    codes = read_codes(merged(reads.where("read_id is not null")), k)
    return hits.counted(codes.join(lists.hint("shuffle_hash"), "code").select("read_id", "place", "nodes", "tids", "species", "sizes", "lends"))


def read_strains(reads: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(read_id, species, tid, n): what representative_strains marks, by the lists of packed; n are the k-mers."""
    codes = read_codes(merged(reads.where("read_id is not null")), k).select("read_id", "code")
    some = lists.where(F.size("tids") > 0).select("code", "tids", "species")
    return hits.represented(codes.join(some.hint("shuffle_hash"), "code").select("read_id", "tids", "species"))


def null_bucket(n_kmers: Column, buckets: list[int]) -> Column:
    """The read-length bucket of the null model that is nearest, by whole midpoints."""
    out = F.lit(buckets[0])
    for low, high in zip(buckets, buckets[1:], strict=False):
        out = F.when(n_kmers > (low + high) // 2, F.lit(high)).otherwise(out)
    return out


def log_odds(probs: DataFrame, null: DataFrame | None, tax: DataFrame, buckets: list[int] | None = None) -> DataFrame:
    """probs with random_prob and score = ln(prob / random_prob).

    null: (tid, gc_bin, cutoff), with ``buckets`` also read_kmers, the bucket that
    a row is for; probs carry gc_bin. A taxon without a null model has the chance 1,
    so it never wins. A taxon's chance is at least that of any of the read's taxa in
    its rank class or a lower one (a running maximum over the classes, so the order
    of discovery doesn't matter). Without a null model (None, or none for a read's
    bucket) the score is prob itself.
    """
    if null is None:
        return probs.withColumn("random_prob", F.lit(None).cast("double")).withColumn("score", F.col("prob").cast("double"))
    rank_class = F.coalesce(*[F.when(F.col("rank") == r, c) for r, c in taxonomy.RANK_CLASSES.items()], F.lit(0))
    more = [c for c in ("depth", "path") if c in tax.columns and "path" in tax.columns and not {"depth", "path"} & set(probs.columns)]
    classes = taxonomy.single(tax).select("tid", F.when(F.col("depth") == 0, taxonomy.ROOT_CLASS).otherwise(rank_class).alias("rank_class"), *more)
    key = F.struct("read_kmers", "gc_bin") if buckets else F.col("gc_bin")
    one = null.where("gc_bin is not null").groupBy("tid", key.alias("key")).agg(F.max("cutoff").alias("cutoff"))
    by = one.groupBy("tid").agg(F.map_from_entries(F.collect_list(F.struct("key", "cutoff"))).alias("cutoffs"))
    if buckets:
        probs = probs.withColumn("read_kmers", null_bucket(F.col("n_kmers"), buckets))
    facts = classes.join(by, "tid", "full_outer")  # a row a taxon, so that reads' taxa meet one table
    with_null = probs.join(facts.hint("shuffle_hash"), "tid", "left").withColumn("cutoff", F.try_element_at("cutoffs", key)).drop("cutoffs")
    if buckets:  # buckets that no model was made for
        has = null.agg(F.collect_set("read_kmers").alias("_made"))
        with_null = with_null.crossJoin(F.broadcast(has)).withColumn("_has", F.array_contains("_made", F.col("read_kmers"))).drop("_made")
    else:
        with_null = with_null.withColumn("_has", F.lit(True))
    own = F.coalesce(F.col("cutoff") + 0.0001, F.lit(1.0))
    w = Window.partitionBy("read_id").orderBy(F.coalesce("rank_class", F.lit(0))).rangeBetween(Window.unboundedPreceding, 0)
    out = with_null.withColumn("random_prob", F.when(F.col("_has"), F.max(own).over(w)))
    odds = F.log(F.col("prob") / F.when(F.col("random_prob") <= 0, 1e-5).otherwise(F.col("random_prob")))
    return out.withColumn("score", F.when(F.col("_has"), odds).otherwise(F.col("prob"))).drop("cutoff", "_has", "read_kmers")


def score_stats(scored: DataFrame) -> DataFrame:
    """(read_id, avg, stdev, top): over positive scores if there are more than 3, else over all."""
    positive = F.col("score") > 0
    few = F.count_if(positive) <= 3
    pick = lambda f: F.when(few, f(F.col("score"))).otherwise(f(F.when(positive, F.col("score"))))
    return scored.groupBy("read_id").agg(
        pick(F.avg).alias("avg"), F.coalesce(pick(F.stddev_samp), F.lit(0.0)).alias("stdev"), F.max("score").alias("top")
    )


def candidates(scored: DataFrame, tax: DataFrame, human_bias: float = 0.0) -> DataFrame:
    """A row a read: its k-mer counts, avg, stdev, top and the candidates in ascending order.

    A candidate has score (with the human bias) and plain (without); scores that
    agree to three decimals are ordered by depth, then tid.
    """
    if "path" not in scored.columns:
        scored = scored.join(taxonomy.single(tax).select("tid", "depth", "path"), "tid")
    known = F.col("path").isNotNull()
    positive = F.col("score") > 0
    few = F.count_if(positive) <= 3
    pick = lambda f: F.when(few, f(F.col("score"))).otherwise(f(F.when(positive, F.col("score"))))
    one = F.struct(F.round("score", 3).alias("rounded"), "depth", "tid", "score", F.col("score").alias("plain"), "path")
    by = scored.groupBy("read_id").agg(
        F.max("n_kmers").alias("n_kmers"), F.max("n_found").alias("n_found"), pick(F.avg).alias("avg"), F.coalesce(pick(F.stddev_samp), F.lit(0.0)).alias("stdev"),
        F.max("score").alias("top"), F.collect_list(F.when(known, one)).alias("cands"),
    ).where(F.size("cands") > 0)
    if human_bias:
        more = lambda c: F.when(taxonomy.is_human(c["tid"]), c["score"] + human_bias * F.col("stdev")).otherwise(c["score"])
        new = lambda c: F.struct(F.round(more(c), 3).alias("rounded"), c["depth"].alias("depth"), c["tid"].alias("tid"), more(c).alias("score"), c["plain"].alias("plain"), c["path"].alias("path"))
        by = by.withColumn("cands", F.transform("cands", new))
    return by.withColumn("cands", F.array_sort("cands"))


def candidate_list(cands: Column) -> Column:
    """The candidates with scores of 0 and more, best first, as (tid, score)."""
    good = F.filter(F.reverse(cands), lambda c: c["score"] >= 0)
    return F.transform(good, lambda c: F.struct(c["tid"].alias("tid"), c["score"].alias("score")))


def decide(cands: list[dict], top: float, gap: float, plasmids: frozenset[int] = frozenset()) -> tuple[int, float | None, str]:
    """The call for one read's ascending candidates: (tid, score, match type).

    From the best candidate down, taxa that fit one lineage are collected until
    one doesn't. Every further candidate within ``gap`` of a lineage node that is
    not above it makes that node unfit. Without unfit nodes the deepest collected
    taxon is the call, else the deepest fit node of the lineage to the root, with
    the best score seen on the way. A plasmid (by its id, or listed) as good as the
    best replaces its own ancestor; of several the last looked at counts. Ancestors
    of the lineage count with their plain scores.
    """
    columns = ([c[n] for c in cands] for n in ("tid", "score", "depth"))
    return _decide(*columns, [c.get("plain", c["score"]) for c in cands], lambda i: cands[i]["path"], top, gap, plasmids)


def _decide(tids: list[int], scores: list[float], depths: list[int], plains: list[float], path_of: Callable, top: float, gap: float, plasmids: frozenset[int]) -> tuple[int, float | None, str]:
    """decide over columns; path_of(i) is asked for the few candidates that are looked at."""
    if not tids:
        return taxonomy.ROOT, None, NONE
    line: list[tuple] = []
    plasmid, stopped = -1, -1
    for i in range(len(tids) - 1, -1, -1):
        tid = tids[i]
        if scores[i] >= top and (taxonomy.PLASMID_FROM <= tid < taxonomy.PLASMID_UNTIL or tid in plasmids):
            plasmid = i
        if stopped < 0:
            depth, path = depths[i], path_of(i)
            for m, other in line:
                if depths[m] == depth or not (tids[m] in path or tid in other):
                    stopped = i
                    break
            else:
                line.append((i, path))
        if stopped >= 0 and scores[i] < top:
            break
    lowest, _ = max(line, key=lambda m: depths[m[0]])
    highest, on_path = min(line, key=lambda m: depths[m[0]])
    chain = [(tids[m], depths[m], scores[m]) for m, _ in line]
    if len(on_path):
        at = {t: i for i, t in enumerate(tids)}
        for j, tid in enumerate(on_path):
            i = at.get(tid)
            chain.append((tid, depths[highest] - 1 - j, None if i is None else plains[i]))
    chain.sort(key=lambda n: -n[1])
    unfit = set()
    for i in range(stopped, -1, -1):
        if tids[i] in on_path:
            continue
        go_on, path, score = True, path_of(i), scores[i]
        for tid, _, own in chain:
            if tid in path:
                break
            if (own if own is not None else -10000.0) - score > gap:
                go_on = False
                break
            unfit.add(tid)
        if not go_on:
            break
    if not unfit:
        call = (tids[lowest], scores[lowest], DIRECT)
    else:
        best, call = None, (0, -1.0, LCA_ERROR)
        for tid, _, own in chain:
            if own is not None:
                best = own if best is None else max(best, own)
            if tid not in unfit:
                call = (tid, best, MULTI)
                break
    if plasmid >= 0 and call[0] in path_of(plasmid):
        call = (tids[plasmid], call[1], call[2])
    return call


def call_reads(cands: DataFrame, sdiff: float = 1.0, phix_screen: bool = True, min_kmers: int = 0, min_found: int = 1, plasmids: tuple[int, ...] = ()) -> DataFrame:
    """(read_id, tid, score, match_type, avg, stdev, n_kmers, candidates) from candidates().

    Reads with less than min_found k-mers in the index, or less than min_kmers
    distinct ones, have no match: tid 0, score -1. A phage screened for (as good as
    the best) makes the call the synthetic taxon. The candidate list is that of
    candidate_list.
    """
    listed = frozenset(plasmids)

    screened = set(taxonomy.PHIX) if phix_screen else set()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            lists = col["cands"]
            flat, ends = lists.flatten(), np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64)
            field = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
            tids, scores, depths, plains, nodes = (x.to_pylist() for x in (*(field[n] for n in ("tid", "score", "depth", "plain")), field["path"].flatten()))
            cut = np.concatenate(([0], np.cumsum(field["path"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))).astype(np.int64).tolist()
            bounds = ends.tolist()
            calls = []
            for i, (n, found, top, stdev) in enumerate(zip(*(col[c].to_pylist() for c in ("n_kmers", "n_found", "top", "stdev")), strict=True)):
                low, high = bounds[i], bounds[i + 1]
                own = tids[low:high]
                if found < min_found or n < min_kmers:
                    calls.append((0, -1.0, NONE))
                    continue
                phix = [plains[low + j] for j, t in enumerate(own) if t in screened]
                if phix and max(phix) >= top:
                    calls.append((taxonomy.SYNTHETIC, max(phix), DIRECT))
                else:
                    path_of = lambda j, low=low: nodes[cut[low + j] : cut[low + j + 1]]
                    calls.append(_decide(own, scores[low:high], depths[low:high], plains[low:high], path_of, top, stdev * sdiff, listed))
            # The lists, best first: each read's stretch turned round, without scores below 0.
            of = np.repeat(np.arange(len(lists)), np.diff(ends))
            turned = (ends[:-1] + ends[1:] - 1)[of] - np.arange(len(of))
            score = field["score"].to_numpy(zero_copy_only=False).astype(float)
            good = score[turned] >= 0
            at = np.concatenate(([0], np.cumsum(np.bincount(of[good], minlength=len(lists))))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([field[n].take(pa.array(turned[good])) for n in ("tid", "score")], ["tid", "score"])
            tid, best, kind = zip(*calls, strict=True) if calls else ((), (), ())
            columns = [col["read_id"], pa.array(tid, pa.int32()), pa.array(best, pa.float64()), pa.array(kind, pa.string()), col["avg"], col["stdev"], col["n_kmers"].cast(pa.int64()), pa.ListArray.from_arrays(pa.array(at), pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["read_id", "tid", "score", "match_type", "avg", "stdev", "n_kmers", "candidates"])

    kind = cands.schema["read_id"].dataType.simpleString()
    shape = f"read_id {kind}, tid int, score double, match_type string, avg double, stdev double, n_kmers bigint, candidates array<struct<tid:int,score:double>>"
    return cands.mapInArrow(batches, shape)


def outcome(reads: DataFrame, calls: DataFrame, k: int, min_kmers: int, min_score: float | None = None, seq: str = "seq") -> DataFrame:
    """One row a read: its call (tid, score, match_type), or the reason why there is none or it doesn't count."""
    n = valid_count(F.col(seq), k)
    got = reads.select("read_id", seq, n.alias("valid_kmers")).join(calls, "read_id", "left")
    reason = F.when(F.col("valid_kmers") < min_kmers, SHORT).when(F.col("tid").isNull() | (F.col("match_type") == NONE), NO_HITS)
    if min_score is not None:
        reason = reason.when(F.col("score") < min_score, LOW)
    return got.withColumn("reason", reason)


def label_reads(
    reads: DataFrame, index: DataFrame | None, tax: DataFrame, null: DataFrame | None, k: int, min_kmers: int = 30, min_found: int = 1, min_score: float | None = 0.0,
    sdiff: float = 1.0, human_bias: float = 0.0, phix_screen: bool = True, plasmids: tuple[int, ...] = (), buckets: list[int] | None = None,
    probs: DataFrame | None = None,
) -> DataFrame:
    """Reads (read_id, seq) labelled from end to end: one row a read with call, reason, statistics and the candidate list.

    index is a strict_index; probs are its label_probabilities, where they are there already. Columns: read_id, seq, avg, stdev, n_kmers,
    valid_kmers, candidates, tid, score, match_type, reason.
    """
    if probs is None:
        probs = label_probabilities(reads, packed(index.groupBy("kmer").agg(F.collect_list(F.struct("tid", "path", "species", "strain")).alias("l"))), k)
    scored = log_odds(probs, null, tax, buckets)
    cands = candidates(scored, tax, human_bias)
    calls = call_reads(cands, sdiff, phix_screen, min_kmers, min_found, plasmids)
    columns = ["read_id", "seq", "avg", "stdev", "n_kmers", "valid_kmers", "candidates", "tid", "score", "match_type", "reason"]
    return outcome(reads, calls, k, min_kmers, min_score).select(*columns)


def top_taxon(probs: DataFrame, tax: DataFrame) -> DataFrame:
    """(read_id, tid, score): the likeliest taxon; of equals the deepest, then the smallest."""
    best = F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("prob"), F.desc("depth"), "tid"))
    ranked = probs.join(taxonomy.single(tax).select("tid", "depth"), "tid").withColumn("place", best)
    return ranked.where("place = 1").select("read_id", "tid", F.col("prob").alias("score"))


def taxon_summary(outcomes: DataFrame, tax: DataFrame) -> DataFrame:
    """(tid, name, wrc, rc): weighted and plain read counts of accepted calls."""
    by = outcomes.where("reason is null").groupBy("tid").agg(F.sum("score").alias("wrc"), F.count("*").alias("rc"))
    return by.join(tax.select("tid", "name"), "tid", "left")


def nomatch_summary(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n_reads"))


def rebinned(labelled: DataFrame, tax: DataFrame, min_score: float, min_kmers: int) -> DataFrame:
    """(tid, name, wrc, rc) of labelled reads (n_kmers, tid, score, match_type) at new thresholds, without labelling again."""
    hit = F.col("match_type").isin(DIRECT, MULTI) & (F.col("score") >= min_score) & (F.col("n_kmers") >= min_kmers)
    return taxon_summary(labelled.where(hit).withColumn("reason", F.lit(None).cast("string")), tax)

"""Gene labelling: k-mers of labelled reads against a gene index (kmer, gid)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import canonical_windows, encode, merged, n_kmers_of, read_codes, runs
from ..store import dropped, stored
from .hits import candidates, checked, coded_pairs, covered, genes_of_reads, likely, packed_pairs, probes, signed_pairs

#: So many reads are worked on at once, of all, of several runs, and over all k-mers, so that their shuffle files stay small.
_AT_ONCE, _REST_AT_ONCE, _LATE_AT_ONCE = 1 << 24, 1 << 19, 1 << 17


def called(labelled: DataFrame) -> DataFrame:
    """(read_id, seq, tid, score) of labelled reads for the gene step: reads that were too short or have no score are left out, those without a match have tid 0."""
    none = F.col("match_type").isNull() | F.startswith("match_type", F.lit("N")) | F.startswith("match_type", F.lit("R"))
    return labelled.where("score is not null and score <> -1").select("read_id", "seq", F.when(none, F.lit(0)).otherwise(F.col("tid")).alias("tid"), "score")


def uncalled(reads: DataFrame) -> DataFrame:
    """(read_id, seq, tid, score) of raw reads: tid 0 and score 0, so gene counts need no labels and the filtered table stays empty."""
    return reads.select("read_id", "seq", F.lit(0).alias("tid"), F.lit(0.0).alias("score"))


def limited(gene_index: DataFrame, most: int) -> DataFrame:
    """The gene index without k-mers of more than ``most`` genes."""
    wide = gene_index.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return gene_index.join(wide.select("kmer"), "kmer", "left_anti")


def sample_functions(samples: DataFrame, names: list[str]) -> DataFrame:
    """A row a function, a column a sample: reads, from (sample, function, rc)."""
    return samples.groupBy("function").pivot("sample", names).agg(F.sum("rc")).fillna(0, names)


def gene_hits(reads: DataFrame, gene_index: DataFrame, k: int) -> DataFrame:
    """(read_id, kmer, occurrences, gid): every gene of every distinct k-mer of a read."""
    kmers = canonical_windows(reads, k, keep=("read_id",)).groupBy("read_id", "kmer").agg(F.count("*").alias("occurrences"))
    return kmers.join(gene_index, "kmer").select("read_id", "kmer", "occurrences", "gid")


def _parts(df: DataFrame, key: str, n: int, most: int) -> list[DataFrame]:
    """df dealt by a hash of its key, so that a part has about ``most`` of the n rows."""
    parts = max(1, -(-n // most))
    return [df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [df]


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def gene_codes(gene_index: DataFrame, k: int) -> DataFrame:
    """(gid, codes): the codes of a gene's k-mers, a row a gene."""
    return coded_pairs(gene_index, k).groupBy("gid").agg(F.collect_list("code").alias("codes"))


def _bounded(own: DataFrame, wide: DataFrame, usual: int) -> tuple[DataFrame, int]:
    """The lists of the k-mers that are not wide, genes being marked with the number of their wide k-mers, and the largest number marked.

    Genes with more of them stand in the lists of all their k-mers, and are marked with none. The number is less than ``usual``, unless
    that takes more than eight rows for each wide k-mer.
    """
    spark = own.sparkSession
    sums = signed_pairs(own).join(wide, "code", "left_semi").groupBy("gid").agg(F.count("*").alias("w"))
    sums = stored(spark, sums, "sums")
    rows, most = 8 * wide.count(), 0
    for w, n in sums.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("w")).toLocalIterator():
        rows -= w * n
        if rows < 0:
            most = w
            break
    most = max(most, usual - 1)
    marked = own.join(sums, "gid", "left").select((F.col("gid") * 256 + F.when(F.col("w") <= min(most, 255), F.col("w")).otherwise(0)).alias("gid"), "codes")
    full = own.join(sums.where(F.col("w") > most), "gid").select((F.col("gid") * 256).alias("gid"), "codes")
    pairs = signed_pairs(marked).join(wide, "code", "left_anti").unionByName(signed_pairs(full).join(wide, "code", "left_semi"))
    lists = stored(spark, packed_pairs(pairs), "lists")
    dropped(sums)
    return lists, most if most < 256 else 1 << 62


def best_genes(reads: DataFrame, gene_index: DataFrame, k: int, few: int = 64) -> DataFrame:
    """(read_id, gid, hits, gscore): the gene with most k-mers, of equals the smallest id; gscore is the share of the read's distinct k-mers.

    Exact. A gene that has all k-mers of a read is the best, and stands in the list
    of any of these. So each unbroken run of a read goes, once, to the list of its last
    k-mer (of its first, where that one is in more than ``few`` genes), and from there to the
    genes that may have the others too, which are then compared k-mer by k-mer. A
    read of one run is settled by that. A read of several runs has a gene of as many hits
    as its longest whole run has (``least``). A gene with as many has at least so many
    less its own wide k-mers from the short lists (``_bounded``). Genes that do are
    counted out, and compared over the whole read. All other reads are left to ``_by_all_kmers``.
    """
    spark, kind = reads.sparkSession, gene_index.schema["gid"].dataType
    reads = reads.where("read_id is not null").select("read_id", "seq")
    own = stored(spark, gene_codes(gene_index, k), "own")
    pairs = signed_pairs(own)
    wide = stored(spark, pairs.groupBy("code").agg(F.count("*").alias("n")).where(F.col("n") > few).select("code"), "wide")
    pairs = pairs.join(wide, "code", "left_anti")
    done, rest = [], []
    for part in _parts(reads, "read_id", reads.count(), _AT_ONCE):
        one = stored(spark, merged(part), "reads")
        parts = runs(F.col("seq"), k)
        asked = probes(one.select("read_id", F.explode(parts).alias("seq"), (F.size(parts) == 1).alias("alone")), k)
        for c in ("last", "first"):
            asked = asked.join(wide.select(F.col("code").alias(c), F.lit(True).alias(f"{c}_wide")), c, "left")
        # A run without a narrow one asks for what no gene has.
        code = F.when(F.col("last_wide").isNull(), F.col("last")).when(F.col("first_wide").isNull(), F.col("first")).otherwise(-1 - F.pmod(F.xxhash64("read_id"), F.lit(1 << 20)))
        found = stored(spark, candidates(pairs, asked.select("read_id", "seq", "alone", "n", code.alias("code"), F.col("bits").alias("want"))), "found")
        each = found.select("read_id", "seq", F.explode("genes").alias("gid"), (F.col("alone") & (F.size("genes") == 1)).alias("only"), "alone")
        seen = stored(spark, checked(own, each, k), "checked")
        done.append(stored(spark, seen.where("only and hits = n").select("read_id", "gid", "hits", "n"), "whole"))
        more = seen.where("not (only and hits = n)").select("read_id", "gid", "n", (F.col("hits") == F.col("n")).alias("whole"), "alone")
        none = found.where(F.size("genes") == 0).select("read_id", F.lit(None).cast("bigint").alias("gid"), "n", F.lit(False).alias("whole"), "alone")
        by = more.unionByName(none).groupBy("read_id").agg(
            F.min(F.when(F.col("whole") & F.col("alone"), F.col("gid"))).alias("gid"), F.max(F.when(F.col("whole"), F.col("n"))).alias("least")
        )
        by = stored(spark, by, "runs")
        done.append(stored(spark, by.where("gid is not null").select("read_id", "gid", F.col("least").alias("hits"), F.col("least").alias("n")), "whole"))
        rest.append(stored(spark, one.join(by.where("gid is null"), "read_id").select("read_id", "seq", F.coalesce("least", F.lit(0)).alias("least")), "rest"))
        dropped(one, found, seen, by)
    left = _union(rest)
    n, m, most = left.count(), 0, None
    usual = left.where("least > 0").groupBy("least").count().orderBy(F.desc("count"), "least").limit(1).collect()
    if usual:
        lists, most = _bounded(own, wide, usual[0]["least"])
        m = left.where(F.col("least") > most).count()
        for part in _parts(left.where(F.col("least") > most), "read_id", m, _REST_AT_ONCE) if m else []:
            one = stored(spark, part.withColumn("number", F.monotonically_increasing_id()), "part")
            some = stored(spark, likely(lists, one, k), "likely")
            seen = checked(own, one.join(some, "number").select("read_id", "seq", "gid"), k)
            best = seen.groupBy("read_id").agg(F.max(F.struct("hits", (-F.col("gid")).alias("minus"), "n")).alias("x"))
            done.append(stored(spark, best.select("read_id", (-F.col("x.minus")).alias("gid"), "x.hits", "x.n"), "best"))
            dropped(one, some)
        dropped(lists)
    dropped(own, wide)
    out = _union(done).select("read_id", F.col("gid").cast(kind).alias("gid"), "hits", (F.col("hits") / F.col("n")).alias("gscore"))
    if n > m:
        left = (left if most is None else left.where(F.col("least") <= most)).select("read_id", "seq")
        codes = stored(spark, read_codes(left, k).select("code").distinct(), "codes")
        index = stored(spark, gene_index.withColumn("_code", encode(F.col("kmer"))).join(codes, F.col("_code") == F.col("code"), "left_semi").select("kmer", "gid"), "index")
        late = [stored(spark, _by_all_kmers(part, index, k, few), "late") for part in _parts(left, "read_id", n - m, _LATE_AT_ONCE)]
        dropped(codes, index)
        out = _union([out, *late])
    dropped(*rest)
    return out


def _by_all_kmers(reads: DataFrame, gene_index: DataFrame, k: int, few: int) -> DataFrame:
    """best_genes of reads over all their k-mers.

    Exact, but genes are listed a read only for k-mers of at most ``few`` genes. What
    a gene shares of a read's wider k-mers is looked up for those genes alone that
    may still be the best: a gene has at most as many wide k-mers in a read as
    the read has, and as the largest number (``most``) of any gene of these k-mers.
    Reads that a gene of wide k-mers alone might win are settled once a distinct
    set of wide k-mers, over all genes of these.
    """
    spark = reads.sparkSession
    sizes = gene_index.groupBy("kmer").agg(F.count("*").alias("n"), F.when(F.count("*") <= few, F.collect_list("gid")).alias("genes"))
    wide = sizes.where(F.col("n") > few).select("kmer", encode(F.col("kmer")).alias("code"))
    pairs = stored(spark, gene_index.join(wide, "kmer").select("kmer", "code", "gid"), "wide")
    own = stored(spark, pairs.groupBy("gid").agg(F.collect_list("code").alias("own")), "own")
    most = pairs.join(own.select("gid", F.size("own").alias("m")), "gid").groupBy("kmer", "code").agg(F.max("m").alias("m"))
    narrow = sizes.where(F.col("n") <= few).select(encode(F.col("kmer")).alias("code"), "genes", F.lit(None).cast("int").alias("m"))
    one = narrow.unionByName(most.select("code", F.array().cast(narrow.schema["genes"].dataType).alias("genes"), "m"))
    codes = read_codes(merged(reads.where("read_id is not null")), k).select("read_id", "code", n_kmers_of(F.col("place")).alias("n"))
    met = codes.join(one.hint("shuffle_hash"), "code").select("read_id", "n", "code", "genes", "m")
    rows = genes_of_reads(met, gene_index.schema["gid"].dataType).withColumn("l", F.when(F.size("l") > 0, F.col("l")))
    rows = rows.withColumn("limit", F.least(F.size("wide"), "m"))
    shared = lambda wide, own: F.size(F.array_intersect(wide, F.coalesce(own, F.array().cast("array<bigint>"))))

    led = rows.join(own.withColumnRenamed("gid", "lead"), "lead", "left")
    least = F.get(F.filter("l", lambda x: x["gid"] == F.col("lead")), F.lit(0))["hits"] + shared(F.col("wide"), F.col("own"))
    # A lambda's variable is bound once a row; a column would be worked out anew for every element.
    near = lambda v: F.filter("l", lambda x: (x["gid"] == F.col("lead")) | (x["hits"] + F.col("limit") >= v))
    kept = ["read_id", "n", "wide", "limit"]
    one = F.get(F.transform(F.array(least), lambda v: F.struct(v.alias("least"), near(v).alias("l"))), F.lit(0))
    led = stored(spark, led.select(*kept, "lead", one.alias("x")).select(*kept, "lead", "x.least", "x.l"), "led")
    alone = led.where("l is null or size(l) = 1").select(*kept, F.col("lead").alias("gid"), F.col("least").cast("bigint").alias("hits"))
    some = led.where("size(l) > 1").select(*kept, F.explode("l").alias("x")).select(*kept, "x.gid", "x.hits")
    some = some.join(own, "gid", "left").withColumn("hits", F.col("hits") + shared(F.col("wide"), F.col("own")))
    first = F.max(F.struct("hits", (-F.col("gid")).alias("minus"), "n", "limit")).alias("x")
    some = some.groupBy("read_id").agg(first).select("read_id", "x.n", "x.limit", (-F.col("x.minus")).alias("gid"), "x.hits")
    wides, led = led.select("read_id", "wide"), stored(spark, alone.drop("wide").unionByName(some), "led")

    open_ = (F.col("limit") > 0) & (F.col("limit") >= F.coalesce("hits", F.lit(0)))
    late = stored(spark, led.where(open_).join(wides, "read_id"), "late")
    h = F.min(F.coalesce("hits", F.lit(0))).alias("h")
    sets = stored(spark, late.groupBy("wide").agg(h).withColumn("set", F.monotonically_increasing_id()), "sets")
    # Only a gene of at least as many wide k-mers as the hits to beat can win.
    each = sets.select("set", "h", F.explode("wide").alias("code"))
    able = pairs.join(own.select("gid", F.size("own").alias("s")), "gid").join(each.groupBy("code").agg(F.min("h").alias("low")), "code").where("s >= low")
    by = each.join(able.select("code", "gid", "s"), "code").where("s >= h").groupBy("set", "gid").agg(F.count("*").alias("w_hits"))
    by = by.groupBy("set").agg(F.max(F.struct("w_hits", (-F.col("gid")).alias("minus"))).alias("x")).join(sets, "set").select("wide", "x.w_hits", (-F.col("x.minus")).alias("w_gid"))
    late = late.join(by, "wide", "left")
    wins = F.col("hits").isNull() | (F.col("w_hits") > F.col("hits")) | ((F.col("w_hits") == F.col("hits")) & (F.col("w_gid") < F.col("gid")))
    late = late.select("read_id", F.when(wins, F.col("w_gid")).otherwise(F.col("gid")).alias("gid"), F.when(wins, F.col("w_hits")).otherwise(F.col("hits")).alias("hits"), "n")
    out = led.where(~open_).select("read_id", "gid", "hits", "n").unionByName(late)
    return out.select("read_id", "gid", "hits", (F.col("hits") / F.col("n")).alias("gscore"))


def gene_taxa(best: DataFrame, calls: DataFrame, min_score: float, min_kmers: int, min_tax_score: float) -> DataFrame:
    """(gid, tid, rc, score_sum, rc_tax, score_sum_tax): reads over both thresholds, and those whose taxon scores enough too.

    Reads meet their calls in parts, and what they come to is written, so the two shuffles are never on disk at once.
    """
    spark = best.sparkSession
    ok = best.where((F.col("gscore") > min_score) & (F.col("hits") > min_kmers)).select("read_id", "gid", "gscore")
    calls = calls.select("read_id", "tid", "score")
    n = ok.count()
    met = [
        stored(spark, a.join(b, "read_id").select("gid", "tid", "gscore", "score"), "calls")
        for a, b in zip(_parts(ok, "read_id", n, _AT_ONCE), _parts(calls, "read_id", n, _AT_ONCE), strict=True)
    ]
    good = F.col("score") >= min_tax_score
    return _union(met).groupBy("gid", "tid").agg(
        F.count("*").alias("rc"), F.sum("gscore").alias("score_sum"),
        F.count_if(good).alias("rc_tax"), F.coalesce(F.sum(F.when(good, F.col("gscore"))), F.lit(0.0)).alias("score_sum_tax"),
    )


def gene_coverage(best: DataFrame, reads: DataFrame, gene_index: DataFrame, k: int) -> DataFrame:
    """(gid, n_kmers, sum_kmers): distinct and all occurrences of a gene's k-mers over the reads it is best for.

    A read's k-mers meet its best gene alone, not every gene that has them: reads are
    sorted to their genes, and the k-mers counted there, so none of them is shuffled. Reads
    meet their best genes in parts, then genes their reads.
    """
    spark, kind = best.sparkSession, gene_index.schema["gid"].dataType
    n, reads = best.count(), reads.select("read_id", "seq")
    best = best.select("read_id", F.col("gid").cast("bigint").alias("gid"))
    called = [
        stored(spark, a.join(b, "read_id").select("gid", "seq"), "called")
        for a, b in zip(_parts(reads, "read_id", n, _AT_ONCE), _parts(best, "read_id", n, _AT_ONCE), strict=True)
    ]
    own = stored(spark, gene_codes(gene_index, k), "own")
    out = [
        stored(spark, covered(a, b, k), "covered")
        for a, b in zip(_parts(own, "gid", n, _AT_ONCE), _parts(_union(called), "gid", n, _AT_ONCE), strict=True)
    ]
    dropped(own, *called)
    return _union(out).select(F.col("gid").cast(kind).alias("gid"), "n_kmers", "sum_kmers")


def annotated(taxa: DataFrame, coverage: DataFrame, annotation: DataFrame, totals: DataFrame) -> DataFrame:
    """A row for each (annotation row, called taxon): mean score, reads, coverage and redundancy."""
    full = taxa.join(annotation, "gid").join(coverage, "gid", "left").join(totals.select("gid", F.col("n").alias("gene_kmers")), "gid", "left")
    n, every, size = (F.coalesce(c, F.lit(0)) for c in ("n_kmers", "sum_kmers", "gene_kmers"))
    return full.withColumn("avg", F.col("score_sum") / F.col("rc")).withColumn("n_kmers", n).withColumn("sum_kmers", every).withColumn(
        "gene_kmers", size
    ).withColumn("coverage", F.when(F.col("gene_kmers") > 0, F.col("n_kmers") / F.col("gene_kmers"))).withColumn(
        "redundancy", F.when(F.col("n_kmers") > 0, F.col("sum_kmers") / F.col("n_kmers"))
    )


def functions_table(taxa: DataFrame, proteins: DataFrame, functions: DataFrame) -> DataFrame:
    """(function, rc): reads of all genes of a function, through gene -> protein -> function; blanks are left out."""
    chain = taxa.join(proteins, "gid", "left").join(functions, "protein", "left").where("coalesce(function, '') <> ''")
    return chain.groupBy("function").agg(F.sum("rc").alias("rc"))

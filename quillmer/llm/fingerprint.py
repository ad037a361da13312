"""Document fingerprints by SimHash, with DataFrame functions only.

A text's terms are its word triples (as 64-bit hashes, two seeds, so 128 bits).
Each term's weight is its number of occurrences; the weighted hashes vote on the
bits. ``near_fingerprints`` finds all fingerprints within a Hamming radius by
permuted block tables.

Defined results: null texts count as empty; a text without words has the zero
fingerprint; fewer than three words make one term; equal texts always have equal
fingerprints. Rows with a null id sort before all others; repeated rows stay and
are ordered by id, then by a hash of the text. Other columns are not read.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, let, words
from .simhash import fingerprints, hex16, word_terms

SEEDS = (0, 1)
BITS = 64 * len(SEEDS)
_FIRST = -(1 << 63)


def term_hashes(w: Column) -> Column:
    """A struct of hashes (one a seed) of every word triple of array w."""
    return word_terms(w, 3, lambda ws: F.struct(*[F.xxhash64(F.lit(s), *ws).alias(f"h{k}") for k, s in enumerate(SEEDS)]))


def text_fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and fp0, fp1 (the two halves of the fingerprint) of each row; keys must tell rows apart."""
    hashed = df.select(*keys, let(words(F.col(text)), term_hashes).alias("terms"))
    return fingerprints(hashed, keys, "terms", len(SEEDS)).drop("n_terms")


def likeness(a: list[Column], b: list[Column]) -> Column:
    """1 less the share of differing bits."""
    off = reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])
    return F.lit(1.0) - off / F.lit(float(64 * len(a)))


def _bucketed(docs: DataFrame, buckets: int) -> tuple[DataFrame, dict[int, int]]:
    """docs with ``bucket``, a range of the key ``k``; each bucket's smallest key.

    Range bounds come from approximate quantiles of the ids, so buckets are even
    for any ids; at most ``buckets`` numbers reach the driver.
    """
    at = [i / buckets for i in range(1, buckets)] or [0.5]
    bounds = sorted({int(x) for x in docs.agg(F.percentile_approx("k", F.lit(at), F.lit(10 * buckets)).alias("q")).first()["q"] or []})
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    below = lambda xs: F.size(F.filter(F.array(*[F.lit(x).cast("bigint") for x in xs]), lambda x: x <= F.col("k")))
    if fine:
        part = below([f[0] for f in fine])
        within = reduce(
            lambda c, i: c.when(F.col("coarse") == i + 1, below(fine[i])), range(len(fine)), F.when(F.col("coarse") == 0, F.lit(0))
        )
        out = docs.withColumn("coarse", part).withColumn("bucket", F.greatest(F.col("coarse") - 1, F.lit(0)) * step + within)
        out = out.drop("coarse")
    else:
        out = docs.withColumn("bucket", F.lit(0))
    heads = {r["bucket"]: r["k"] for r in out.select("bucket", "k").groupBy("bucket").agg(F.min("k").alias("k")).collect()}
    return out, heads


def with_next(docs: DataFrame, value: str, bucketed: DataFrame, heads: dict[int, int], spark: SparkSession) -> DataFrame:
    """bucketed with ``next``: value of the row that follows by (k, th), after the last that of the first.

    Rows are dealt by range; each range also gets a copy of the following
    range's first row, so that a window inside the range suffices.
    """
    order = sorted(heads)
    if not order:
        return bucketed.withColumn("next", F.col(value)).where("false")
    before = [(heads[order[(i + 1) % len(order)]], order[i]) for i in range(len(order))]
    ghosts = spark.createDataFrame(before, "k bigint, bucket int")
    copies = bucketed.drop("bucket").join(F.broadcast(ghosts), "k").withColumn("ghost", F.lit(1))
    rows = bucketed.withColumn("ghost", F.lit(0)).unionByName(copies.select(*bucketed.columns, "ghost"))
    w = Window.partitionBy("bucket").orderBy("ghost", "k", "th")
    return rows.withColumn("next", F.lead(value).over(w)).where("ghost = 0").drop("ghost")


def edited_fingerprints(spark: SparkSession, docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likenesses.

    The edited text replaces the last floor(n/2) of n code points by the first
    as many (or all) of the next document by ascending id (the first after the
    last). Texts are shuffled once, by ranges of the id.
    """
    scratch = Scratch(spark, "fingerprint")
    buckets = buckets or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumn("k", F.coalesce("doc_id", F.lit(_FIRST)))
    keyed, heads = _bucketed(base.withColumn("th", F.xxhash64("text")), buckets)
    both = with_next(docs, "text", keyed, heads, spark)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.col("next").substr(F.lit(1), half))
    texts = both.select(
        F.monotonically_increasing_id().alias("row"), "bucket", "k", "th", "doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited")
    )
    texts = texts.select(
        "row", "bucket", "k", "th", "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.posexplode(F.array("text", "edited")).alias("which", "t"),
    )
    keys = ["row", "which", "bucket", "k", "th", "doc_id", "n_chars", "edited_sha256"]
    fps = text_fingerprints(texts, keys, "t")
    pick = lambda which, c: F.max(F.when(F.col("which") == which, F.col(c)))
    wide = fps.groupBy("row", "bucket", "k", "th", "doc_id", "n_chars", "edited_sha256").agg(
        *[pick(w, f"fp{i}").alias(f"{p}{i}") for w, p in ((0, "a"), (1, "e")) for i in range(len(SEEDS))]
    )
    kept = scratch.keep(wide.drop("row"), "fps")
    own, changed, after = ([F.col(f"{p}{i}") for i in range(len(SEEDS))] for p in "aen")
    packed = kept.withColumn("fp", F.struct(*own))
    out = with_next(kept, "fp", packed, heads, spark)
    out = out.select("*", *[F.col("next")[f"a{i}"].alias(f"n{i}") for i in range(len(SEEDS))])
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat(*map(hex16, own)).alias("fingerprint"), F.concat(*map(hex16, changed)).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"), likeness(own, after).alias("near_next"),
    )


def near_fingerprints(queries: DataFrame, stored: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """All pairs (query, match, bits_off) of fingerprints at most ``radius`` bits apart.

    Both inputs hold a column ``fp`` (array<bigint>, equal sizes); they are made
    distinct first, so copies of a document cost nothing and hot values meet
    once; a caller joins ids back by fp. The bits are cut into ``blocks`` blocks
    (radius + 2 by default). Two fingerprints within the radius agree on at least
    blocks - radius of them, so one table for every choice of so many blocks
    ("permutation") finds each pair by an equi-join; pairs found by several
    tables are kept by the first only. Null fingerprints match nothing.
    """
    blocks = blocks or radius + 2
    if blocks <= radius:
        raise ValueError("blocks must exceed radius")

    def cut(df: DataFrame, side: str) -> DataFrame:
        bits = F.array_join(F.transform("fp", lambda x: F.lpad(F.bin(x), 64, "0")), "")
        one = df.where(F.col("fp").isNotNull()).select("fp").distinct().withColumn("bits", bits)
        size = F.char_length("bits")
        begin = lambda b: F.floor(size * b / blocks).cast("int")
        part = [F.col("bits").substr(begin(b) + 1, begin(b + 1) - begin(b)) for b in range(blocks)]
        return one.select(F.col("fp").alias(side), F.array(*[F.xxhash64(p) for p in part]).alias(f"p{side}"))

    choices = list(combinations(range(blocks), blocks - radius))

    def tables(df: DataFrame, side: str) -> DataFrame:
        keyed = [F.struct(F.lit(t).alias("t"), F.xxhash64(*[F.get(f"p{side}", F.lit(b)) for b in c]).alias("h")) for t, c in enumerate(choices)]
        return df.select(side, f"p{side}", F.explode(F.array(*keyed)).alias("x")).select(side, f"p{side}", "x.t", "x.h")

    both = tables(cut(queries, "query"), "query").join(tables(cut(stored, "match"), "match"), ["t", "h"])
    agree = [F.get("pquery", F.lit(b)) == F.get("pmatch", F.lit(b)) for b in range(blocks)]
    first = reduce(
        lambda c, t: F.when(reduce(lambda x, y: x & y, [agree[b] for b in choices[t]]), F.lit(t)).otherwise(c),
        reversed(range(len(choices))), F.lit(-1),
    )
    off = F.aggregate(F.zip_with("query", "match", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    return both.where(F.col("t") == first).select("query", "match", off.alias("bits_off")).where(F.col("bits_off") <= radius)

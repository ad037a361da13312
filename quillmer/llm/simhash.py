"""Signed-bit votes of hashed terms, as native aggregates.

Two counters share one 64-bit sum: bits i and i+32 of a hash are masked out
together, so 64 bit counts need 32 codegen'd sums and no per-bit rows.
Partial aggregation keeps one row a document in the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LANES = 0x0000000100000001
_LOW = 0xFFFFFFFF


def vote_sums(h: Column, word: int) -> list[Column]:
    """32 aggregates that hold the counts of the 64 bits of h."""
    return [F.sum(F.shiftright(h, i).bitwiseAND(F.lit(_LANES))).alias(f"v{word}_{i}") for i in range(32)]


def majority(word: int, total: Column) -> Column:
    """The 64-bit number whose bits are those set in over half of the total weight."""
    bits = []
    for i in range(32):
        v = F.col(f"v{word}_{i}")
        for count, at in ((v.bitwiseAND(F.lit(_LOW)), i), (F.shiftrightunsigned(v, 32), i + 32)):
            one = (1 << at) - (1 << 64 if at == 63 else 0)
            bits.append(F.when(count * 2 > total, F.lit(one)).otherwise(F.lit(0)).cast("bigint"))
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def word_terms(w: Column, size: int, hashes) -> Column:
    """hashes(words) of every run of ``size`` entries of array w, or of all of them if there are fewer.

    ``hashes`` maps a list of word columns to a struct of hashes.
    """
    runs = F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: hashes([F.get(w, i + k) for k in range(size)]))
    whole = F.array(hashes([F.array_join(w, " ")]))
    return F.when(F.size(w) >= size, runs).when(F.size(w) > 0, whole)


def fingerprints(df: DataFrame, keys: list[str], terms: str, n_words: int) -> DataFrame:
    """Fingerprint words fp0, fp1, ... of each row, from its array of term hashes.

    ``terms`` names an array of structs (h0, h1, ...), one hash a fingerprint
    word; every entry votes with weight 1, repeats included. A row without terms
    gets zeros. ``keys`` must tell rows apart.
    """
    flat = df.select(*keys, F.explode_outer(terms).alias("t")).select(*keys, "t.*")
    sums = [s for w in range(n_words) for s in vote_sums(F.col(f"h{w}"), w)]
    votes = flat.groupBy(*keys).agg(F.count("h0").alias("n_terms"), *sums)
    return votes.select(
        *keys, "n_terms",
        *[F.coalesce(majority(w, F.col("n_terms")), F.lit(0).cast("bigint")).alias(f"fp{w}") for w in range(n_words)],
    )

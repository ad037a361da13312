"""Readers of sequence and table text formats."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kmers import canonical, encode
from ..operators.taxonomy import closure


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(header, seq) of FASTA files; sequence lines are joined, line ends may be of either kind. Files are split at record starts, so large ones are read in parallel."""
    records = spark.read.option("lineSep", "\n>").text(paths).where(F.trim("value") != "")
    body = records.select(F.regexp_replace("value", r"^>", "").alias("body"))
    at = F.instr("body", "\n")
    header = F.when(at > 0, F.substring("body", F.lit(1), at - 1)).otherwise(F.col("body"))
    seq = F.when(at > 0, F.regexp_replace(F.substring("body", at + 1, F.char_length("body")), r"\s", "")).otherwise("")
    return body.select(F.regexp_replace(header, r"\s+$", "").alias("header"), seq.alias("seq"))


def read_genomes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(tid, seq) of FASTA files whose headers are numbers."""
    return read_fasta(spark, paths).select(F.expr("try_cast(header as int)").alias("tid"), "seq").where("tid is not null")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line from 0, value) of text files, without line ends.

    A line's number is its place in its split and the lines of the splits before, so
    large files are read in parallel, with one small row a split for the counts.
    """
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    splits = splits.select("file", "block", "first", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before"))
    line = F.col("id") - F.col("first") + F.col("before")
    return lines.join(splits, ["file", "block"]).select("file", line.alias("line"), F.rtrim(F.rtrim("value", F.lit("\r"))).alias("value"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(header, seq, qual) of FASTQ files with four lines a record.

    Any line but a header may begin with ``@`` or ``+``, so records are told by the
    number of a line in its file. Lines after the last whole record that are no
    header are left out.
    """
    numbered = numbered_lines(spark, paths)
    at = lambda i: F.coalesce(F.max(F.when(F.col("line") % 4 == i, F.col("value"))), F.lit(""))
    records = numbered.groupBy("file", F.expr("line div 4").alias("record")).agg(at(0).alias("header"), at(1).alias("seq"), at(3).alias("qual"))
    return records.where(F.startswith("header", F.lit("@"))).select(F.substring("header", 2, 1 << 30).alias("header"), "seq", "qual")


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq) of a FASTA or FASTQ file, by its first byte."""
    first = spark.read.text(path).limit(1).collect()
    return read_fastq(spark, path).select("header", "seq") if first and first[0][0].startswith("@") else read_fasta(spark, path)


def read_nodes(spark: SparkSession, nodes: str, names: str) -> DataFrame:
    """Closed taxonomy from dump files with ``\\t|\\t`` between fields."""
    cut = lambda p: spark.read.text(p).select(F.split(F.regexp_replace("value", r"\t\|$", ""), r"\t\|\t").alias("f"))
    at = lambda i: F.trim(F.get("f", F.lit(i)))
    tree = cut(nodes).select(at(0).cast("int").alias("tid"), at(1).cast("int").alias("parent"), F.translate(at(2), " ", "_").alias("rank"))
    known = cut(names).where(at(3) == "scientific name").select(at(0).cast("int").alias("tid"), at(1).alias("name"))
    return closure(tree.join(known, "tid", "left"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Closed taxonomy from a tree file: two comment lines and a count, then a line ``tid n child ... parent`` and a line with the name for each node."""
    lines = numbered_lines(spark, path).where("line >= 3").select(F.expr("(line - 3) div 2").alias("node"), ((F.col("line") - 3) % 2).alias("half"), "value")
    at = lambda i: F.max(F.when(F.col("half") == i, F.col("value")))
    pairs = lines.groupBy("node").agg(F.split(F.trim(at(0)), r"\s+").alias("f"), at(1).alias("name")).where(F.size("f") >= 3)
    nodes = pairs.select(F.get("f", F.lit(0)).cast("int").alias("tid"), F.element_at("f", -1).cast("int").alias("parent"), F.trim("name").alias("name"))
    return closure(nodes.withColumn("rank", F.lit(None).cast("string")))


def read_feed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(kmer): canonical k-mers of a text feed, separated by any blanks, in any order."""
    words = spark.read.text(paths).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("w")).where("w <> ''")
    return words.select(canonical(F.lower("w")).alias("kmer")).distinct()


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """(wrc, rc, tid, name, avg) of a tab-separated summary."""
    rows = spark.read.csv(path, sep="\t", schema="wrc double, rc bigint, tid int, name string")
    return rows.withColumn("avg", F.col("wrc") / F.col("rc"))


def read_legacy_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(kmer code, genomes, tids) of lines ``kmer genomes n_tids n_tuples (tid present)...``; tids are those marked present."""
    f = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") >= 4)
    at = F.when(F.size("f") >= 6, F.sequence(F.lit(4), F.size("f") - 2, F.lit(2)))
    pairs = F.transform(at, lambda i: F.struct(F.get("f", i).cast("int").alias("tid"), F.get("f", i + 1).cast("int").alias("present")))
    tids = F.transform(F.filter(pairs, lambda p: p["present"] > 0), lambda p: p["tid"])
    code = F.coalesce(encode(F.get("f", F.lit(0))), F.expr("try_cast(get(f, 0) as bigint)"))
    return f.select(code.alias("kmer"), F.get("f", F.lit(1)).cast("bigint").alias("genomes"), F.array_sort(F.coalesce(tids, F.array().cast("array<int>"))).alias("tids"))


def read_kmer_records(spark: SparkSession, paths: str | list[str], wide: bool = True) -> DataFrame:
    """(kmer, tids) of binary k-mer files, one task a file.

    A head gives (little-endian) the start of the data, the number of records and the
    sentinel; a record is a 64-bit k-mer, a count of 32 bits (wide) or 16, and that many
    32-bit ids. After every 1000 records (1500 if not wide) the sentinel must stand,
    else the file is at fault.
    """
    every, count = (1000, "<QI") if wide else (1500, "<QH")
    size = struct.calcsize(count)

    def records(data: bytes) -> Iterator[tuple[int, list[int]]]:
        at, n, sentinel = struct.unpack_from("<IQQ", data)
        for i in range(n):
            kmer, m = struct.unpack_from(count, data, at)
            yield kmer, list(struct.unpack_from(f"<{m}I", data, at + size))
            at += size + 4 * m
            if (i + 1) % every == 0:
                if struct.unpack_from("<Q", data, at)[0] != sentinel:
                    raise ValueError(f"no sentinel after record {i + 1}")
                at += 8

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for data in b["content"]:
                rows = records(data)
                while part := list(islice(rows, 10_000)):
                    yield pd.DataFrame(part, columns=["kmer", "tids"])

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(batches, "kmer bigint, tids array<int>")


def read_columns(spark: SparkSession, path: str, schema: str, sep: str = " ") -> DataFrame:
    """Depth, rank, id-map, count and list files: one or two columns of text."""
    return spark.read.csv(path, sep=sep, schema=schema)


def read_lineage(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name): the ``taxid=`` token, and the text after the last tab."""
    return spark.read.text(path).select(
        F.regexp_extract("value", r"(?:^|,)taxid=(\d+)", 1).cast("int").alias("tid"), F.substring_index("value", "\t", -1).alias("name")
    )


def read_null_model(spark: SparkSession, path: str) -> DataFrame:
    """(tid, class_tid, obs, cutoff, kcnt): a line of bin triples a taxon, after a line with the number of bins."""
    rows = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f")).where(F.size("f") > 2)
    third = lambda k: F.transform(F.sequence(F.lit(2 + k), F.size("f") - 3 + k, F.lit(3)), lambda i: F.get("f", i).cast("double"))
    return rows.select(
        F.get("f", F.lit(0)).cast("int").alias("tid"), F.get("f", F.lit(1)).alias("class_tid"), third(0).cast("array<bigint>").alias("obs"),
        third(1).alias("cutoff"), F.array_max(third(2)).cast("bigint").alias("kcnt"),
    )


def read_null_models(spark: SparkSession, listing: str) -> DataFrame:
    """read_null_model of every line ``read_kmers file`` of a listing (a line a read length), with read_kmers."""
    lines = [r[0].split() for r in spark.read.text(listing).collect() if r[0].strip()]
    each = [read_null_model(spark, path).withColumn("read_kmers", F.lit(int(n))) for n, path in lines]
    return reduce(DataFrame.unionByName, each)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled reads from text: header, seq, ``avg stdev n``, candidates, ``tid score type``, by tabs."""
    f = spark.read.text(path).select(F.split("value", "\t").alias("f")).where(F.size("f") == 5)
    stats, call, cand = (F.split(F.trim(F.get("f", F.lit(i))), " ") for i in (2, 4, 3))
    pairs = F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(cand) - 2, F.lit(0)), F.lit(2)),
        lambda i: F.struct(F.get(cand, i).cast("int").alias("tid"), F.get(cand, i + 1).cast("double").alias("score")),
    )
    at = lambda a, i, t: F.get(a, F.lit(i)).cast(t)
    return f.select(
        F.get("f", F.lit(0)).alias("read_id"), F.get("f", F.lit(1)).alias("seq"), at(stats, 0, "double").alias("avg"), at(stats, 1, "double").alias("stdev"),
        at(stats, 2, "int").alias("n_kmers"), F.filter(pairs, lambda p: p["tid"] != -1).alias("candidates"),
        at(call, 0, "int").alias("tid"), at(call, 1, "double").alias("score"), at(call, 2, "string").alias("match_type"),
    )

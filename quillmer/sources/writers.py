"""Text sinks; sentinels of the formats appear only here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kmers import decode
from ..operators.reports import fasta_lines


def write_fasta(df: DataFrame, path: str, width: int = 80) -> None:
    """(main, header, seq) as wrapped FASTA, one folder a group."""
    lines = df.select("main", fasta_lines(F.col("header"), F.col("seq"), width).alias("value"))
    lines.write.partitionBy("main").text(path)


def write_fastq(df: DataFrame, path: str) -> None:
    """(header, seq, qual) as FASTQ."""
    df.select(F.concat(F.lit("@"), "header", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.text(path)


def kmer_lines(lists: DataFrame) -> DataFrame:
    """(value): index lists (kmer, tids) as ``kmer tid tid ...``."""
    return lists.select(F.concat_ws(" ", "kmer", F.array_join(F.transform("tids", lambda t: t.cast("string")), " ")).alias("value"))


def record_lines(lists: DataFrame, k: int) -> DataFrame:
    """(value): coded index records (kmer, tids) in readable form: code, bases, number of taxa, taxa."""
    tids = F.array_join(F.transform("tids", lambda t: t.cast("string")), " ")
    return lists.select(F.concat_ws(" ", F.col("kmer").cast("string"), decode(F.col("kmer"), k), F.size("tids").cast("string"), tids).alias("value"))


def write_kmers(lists: DataFrame, path: str) -> None:
    """kmer_lines as text files, sorted inside each."""
    kmer_lines(lists).sortWithinPartitions("value").write.text(path)


def write_labelled(df: DataFrame, path: str, hide_seq: bool = False) -> None:
    """Labelled reads as text, in the form that read_labelled reads."""
    pairs = F.array_join(F.transform("candidates", lambda c: F.concat_ws(" ", c["tid"].cast("string"), c["score"].cast("string"))), " ")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-1"))
    line = F.concat_ws(
        "\t", F.col("read_id").cast("string"), F.lit("X") if hide_seq else F.col("seq"), F.concat_ws(" ", text("avg"), text("stdev"), text("n_kmers")),
        F.when(F.size("candidates") > 0, pairs).otherwise("-1 -1"), F.concat_ws(" ", text("tid"), text("score"), "match_type"),
    )
    df.select(line.alias("value")).write.text(path)


def write_summary(df: DataFrame, path: str, columns: list[str], by: str) -> None:
    """A tab-separated summary, largest first."""
    df.orderBy(F.desc(by), columns[-1]).select(*columns).write.csv(path, sep="\t")

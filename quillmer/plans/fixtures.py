"""Sequences, taxonomy and reads derived from the general test tables, for Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.kmers import canonical_windows, encode
from ..operators import genes, index, labels, taxonomy
from ..store import stored

K, CUTOFF, MIN_KMERS, MIN_SCORE = 12, 10, 20, 0.6
_STORED: dict[tuple[str, str, str], DataFrame] = {}

# Taxa with rules of their own (host and plasmids, human, phage, synthetic, ignored), and the blocks of their genomes.
SPECIAL_NODES = [
    (20, 1, "specials", "family"), (150, 20, "special genus", "genus"), (460, 150, "host", "species"), (461, 460, "host strain", "strain"),
    (9606, 150, "human", "species"), (63221, 9606, "human variant", "strain"), (10847, 150, "phage", "species"), (374840, 10847, "phage variant", "strain"),
    (32630, 1, "synthetic", "species"), (10000001, 460, "plasmid one", None), (10000002, 460, "plasmid two", None), (20999999, 150, "ignored", "species"),
]
SPECIAL_GENOMES = [
    (461, "host:0", "host:1", "host:2"), (9606, "human:0", "human:1", "human:2"), (63221, "human:0", "human:1", "human:3"),
    (10847, "phage:0", "phage:1", "phage:2"), (374840, "phage:0", "phage:1", "phage:3"), (32630, "synth:0", "synth:1", "synth:2"),
    (10000001, "plas:0", "plas:1", "host:2"), (10000002, "plas:0", "plas:1", "plas:2"), (20999999, "host:0", "ign:1", "ign:2"),
]
#: Reads of special genomes begin at every so many bases and are numbered from here.
SPECIAL_STEP, SPECIAL_READS = 4, 900_000_000


def dna(text: Column) -> Column:
    return F.translate(F.md5(text.cast("binary")), "0123456789abcdef", "acgtacgtacgtacgt")


class Fixtures:
    """Lazily built tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str, *columns: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").select(*columns)

    def stored(self, name: str, build) -> DataFrame:
        """A table that many queries read (the taxonomy, the index): built and written once a session."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            _STORED[key] = stored(self.spark, build(), f"fixture-{name}")
        return _STORED[key]

    def nodes(self) -> DataFrame:
        cust = self.table("customer", "c_custkey", "c_nationkey", "c_mktsegment")
        names = cust.select("c_mktsegment").distinct()
        segs = names.withColumn("seg", F.row_number().over(Window.orderBy("c_mktsegment")) - 1)  # a handful of segments
        kinds = cust.select("c_nationkey", "c_mktsegment").distinct().join(F.broadcast(segs), "c_mktsegment")
        species = (200 + 10 * F.col("c_nationkey") + F.col("seg")).cast("int")
        row = lambda df, *c: df.select(*[x.alias(n) for x, n in zip(c, ("tid", "parent", "name", "rank"), strict=True)])
        root = self.spark.range(1).select(F.lit(1).alias("tid"), F.lit(1).alias("parent"), F.lit("root").alias("name"), F.lit("no_rank").alias("rank"))
        region = row(self.table("region", "r_regionkey", "r_name"), F.col("r_regionkey") + 10, F.lit(1), F.col("r_name"), F.lit("family"))
        nation = row(self.table("nation", "n_nationkey", "n_name", "n_regionkey"), F.col("n_nationkey") + 100, F.col("n_regionkey") + 10, F.col("n_name"), F.lit("genus"))
        middle = row(kinds, species, F.col("c_nationkey") + 100, F.col("c_mktsegment"), F.lit("species"))
        leaves = row(cust.join(F.broadcast(segs), "c_mktsegment"), (F.col("c_custkey") + 100_000).cast("int"), species, F.concat(F.lit("customer "), F.col("c_custkey").cast("string")), F.lit("strain"))
        special = self.spark.createDataFrame(SPECIAL_NODES, "tid int, parent int, name string, rank string")
        return root.union(region).union(nation).union(middle).union(leaves).union(special)

    def tax(self) -> DataFrame:
        return self.stored("tax", lambda: taxonomy.closure(self.nodes()))

    def special_genomes(self) -> DataFrame:
        """i, tid, seq: the genomes of the special taxa, numbered."""
        rows = self.spark.createDataFrame([(i, *g) for i, g in enumerate(SPECIAL_GENOMES)], "i int, tid int, a string, b string, c string")
        return rows.select("i", "tid", F.concat(*[dna(F.col(x)) for x in "abc"]).alias("seq"))

    def genomes(self) -> DataFrame:
        cust = self.table("customer", "c_custkey", "c_nationkey")
        full = cust.join(self.table("nation", "n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
        part = lambda kind, c: dna(F.concat(F.lit(f"{kind}:"), F.col(c).cast("string")))
        seq = F.concat(part("region", "n_regionkey"), part("nation", "n_nationkey"), part("cust", "c_custkey"))
        own = full.select((F.col("c_custkey") + 100_000).cast("int").alias("tid"), seq.alias("seq"))
        return own.union(self.special_genomes().select("tid", "seq"))

    def reads(self) -> DataFrame:
        """read_id, seq, true_tid: cut from genomes, every tenth kind altered in its own way."""
        orders = self.table("orders", "o_orderkey", "o_custkey").withColumn("tid", (F.col("o_custkey") + 100_000).cast("int"))
        r = orders.join(self.genomes(), "tid").withColumn("s", F.col("seq").substr(F.col("o_orderkey") % 47 + 1, F.lit(50)))
        kind, s = F.col("o_orderkey") % 10, F.col("s")
        new = (
            F.when(kind == 0, F.concat(F.substring(s, 1, 25), F.lit("n"), F.substring(s, 27, 50)))
            .when(kind == 1, F.reverse(F.translate(s, "acgt", "tgca"))).when(kind == 2, F.upper(s)).when(kind == 3, F.substring(s, 1, 8))
            .when(kind == 4, dna(F.concat(F.lit("noise:"), F.col("o_orderkey").cast("string")))).otherwise(s)
        )
        own = r.select(F.col("o_orderkey").alias("read_id"), new.alias("seq"), F.col("tid").alias("true_tid"))
        at = F.explode(F.sequence(F.lit(0), F.lit(46), F.lit(SPECIAL_STEP))).alias("o")
        special = self.special_genomes().select("i", "tid", "seq", at)
        number = (F.lit(SPECIAL_READS) + 10 * (F.col("i") * 100 + F.col("o")) + 5).cast("bigint")
        return own.union(special.select(number, F.substring("seq", F.col("o") + 1, F.lit(50)), "tid"))

    def pairs(self) -> DataFrame:
        return self.stored("pairs", lambda: index.kmer_taxa(self.genomes(), K))

    def codes(self) -> DataFrame:
        """(code): the distinct k-mers of the index."""
        return self.pairs().select("kmer").distinct().select(encode(F.col("kmer")).alias("code"))

    def subtree(self) -> DataFrame:
        return self.stored("subtree", lambda: index.subtree(self.pairs(), self.tax()))

    def pruned(self) -> DataFrame:
        return self.stored("pruned", lambda: index.rank_pruned(self.subtree(), taxonomy.numeric_rank(self.tax()), CUTOFF))

    def label_index(self) -> DataFrame:
        """The pruned index made ready for strict labelling."""
        return self.stored("label_index", lambda: labels.strict_index(self.pruned(), self.tax()))

    def lists(self) -> DataFrame:
        """The pruned index with a row a k-mer, as reads meet it."""
        return self.stored("lists", lambda: labels.packed(labels.strict_lists(self.pruned(), self.tax())))

    def probs(self) -> DataFrame:
        """Label probabilities of all reads."""
        return self.stored("probs", lambda: labels.label_probabilities(self.reads(), self.lists(), K))

    def null(self) -> DataFrame:
        """(tid, gc_bin, cutoff) of all taxa but every thirteenth, which has no null model."""
        bins = F.explode(F.sequence(F.lit(0), F.lit(9))).alias("gc_bin")
        cut = F.when(F.col("tid") % 11 == 0, F.lit(0.0)).otherwise(0.01 * (1 + F.col("tid") % 7) + 0.001 * F.col("gc_bin"))
        return self.nodes().where("tid % 13 <> 5").select("tid").distinct().select("tid", bins).select("tid", "gc_bin", cut.alias("cutoff"))

    def labelled(self) -> DataFrame:
        """All reads labelled from end to end."""
        return self.stored("labelled", lambda: labels.label_reads(self.reads(), None, self.tax(), self.null(), K, MIN_KMERS, min_score=MIN_SCORE, probs=self.probs()))

    def call_summary(self) -> DataFrame:
        """(tid, wrc, rc) of the called reads."""
        return labels.taxon_summary(self.labelled(), self.tax()).select("tid", "wrc", "rc")

    def feed(self, text: str) -> DataFrame:
        """(kmer): the canonical k-mers of one block."""
        one = self.spark.range(1).select(dna(F.lit(text)).alias("seq"))
        return canonical_windows(one, K).select("kmer").distinct()

    def gene_index(self) -> DataFrame:
        """(kmer, gid): genes share halves, so ties occur."""
        return self.stored("gene_index", self._gene_index)

    def _gene_index(self) -> DataFrame:
        p = F.col("p_partkey")
        seq = F.concat(dna(F.concat(F.lit("gene:"), (p % 20).cast("string"))), dna(F.concat(F.lit("part:"), p.cast("string"))))
        parts = self.table("part", "p_partkey").select(p.alias("tid"), seq.alias("seq"))
        return index.kmer_taxa(parts, K).withColumnRenamed("tid", "gid")

    def gene_reads(self) -> DataFrame:
        """(read_id, seq): pieces of the genes, cut at places that depend on the line."""
        line = self.table("lineitem", "l_orderkey", "l_linenumber", "l_partkey")
        p = F.col("l_partkey")
        seq = F.concat(dna(F.concat(F.lit("gene:"), (p % 20).cast("string"))), dna(F.concat(F.lit("part:"), p.cast("string"))))
        return line.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("read_id"), seq.substr(F.col("l_orderkey") % 15 + 1, F.lit(40)).alias("seq"))

    def gene_best(self) -> DataFrame:
        """The best gene of every gene read."""
        return self.stored("gene_best", lambda: genes.best_genes(self.gene_reads(), self.gene_index(), K))

    def samples(self) -> DataFrame:
        """(sample, tid, wrc, rc): line items by return flag and customer."""
        line = self.table("lineitem", "l_orderkey", "l_returnflag", "l_discount")
        full = line.join(self.table("orders", "o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        by = full.groupBy(F.col("l_returnflag").alias("sample"), (F.col("o_custkey") + 100_000).cast("int").alias("tid"))
        return by.agg(F.sum("l_discount").alias("wrc"), F.count("*").alias("rc"))

    def summary(self) -> DataFrame:
        """(tid, wrc, rc) of all samples."""
        return self.samples().groupBy("tid").agg(F.sum("wrc").alias("wrc"), F.sum("rc").alias("rc"))

"""Hits counted in numpy, against the form by position."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmer.operators import hits, labels
from quillmer.plans import registry
from quillmer.plans.fixtures import Fixtures, K

SF = "/root/testdata/sf0.001"


def test_representing_strains_equal_those_by_position(spark):
    f = Fixtures(spark, SF)
    reads = f.reads().select(F.concat(F.lit("r"), "read_id").alias("read_id"), "seq")
    reads = reads.union(spark.createDataFrame([(None, "acgt" * 10), ("r1", "acgt" * 10), ("none", None)], "read_id string, seq string"))
    strict = labels.representative_strains(labels.strict_hits(labels.read_kmers(reads.where("read_id is not null"), K), f.label_index()))
    want = strict.where("represents").select("read_id", "species", "tid", F.size("places").alias("n"))
    assert sorted(map(tuple, labels.read_strains(reads, f.lists(), K).collect())) == sorted(map(tuple, want.collect()))


def test_representing_strains_are_counted_without_lists_of_positions(spark):
    plan = registry.queries()["read_representative_strain"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan.replace("collect_list(seq", "") and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("size", [1, 3, 50])
def test_reads_are_never_cut(size):
    ids = [i for i, n in enumerate([1, 7, 2, 30, 1, 1]) for _ in range(n)]
    batches = [pa.RecordBatch.from_pydict({"read_id": ids[i : i + size], "place": ids[i : i + size]}) for i in range(0, len(ids), size)]
    got = [(t.column(0).to_pylist(), starts) for t, starts in hits.whole_reads(iter(batches), 4)]
    assert [x for part, _ in got for x in part] == ids
    assert all(np.array(part)[starts].tolist() == sorted(set(part)) for part, starts in got)
    assert len({x for part, _ in got for x in set(part)}) == sum(len(set(part)) for part, _ in got)
    assert list(hits.whole_reads(iter([]))) == []


def test_a_node_lent_by_two_species_counts_once_a_kmer(spark):
    shape = "read_id string, place bigint, nodes array<int>, tids array<int>, species array<int>, sizes array<int>, lends array<int>"
    n = (3 << 36) | (4 << 32)
    rows = [
        ("a", n | 0, [11, 12], [11, 12], [5, 6], [2, 2], [5, 1, 6, 1]), ("a", n | 1, [11, 13], [11, 13], [5, 5], [2, 2], [5, 1, 5, 1]),
        ("a", n | 2, [7], [], [], [], []), ("b", n | 0, [13, 11], [13, 11], [5, 5], [1, 1], [5, 5]),
    ]
    got = {(r["read_id"], r["tid"]): r["hits"] for r in hits.counted(spark.createDataFrame(rows, shape)).collect()}
    assert got == {("a", 11): 2, ("a", 12): 1, ("a", 13): 1, ("a", 5): 2, ("a", 6): 1, ("a", 1): 2, ("a", 7): 1, ("b", 13): 1, ("b", 11): 1, ("b", 5): 1}
    facts = {tuple(r)[3:6] for r in hits.counted(spark.createDataFrame(rows, shape)).where("read_id = 'a'").collect()}
    assert facts == {(3, 3, 4)}


def test_genes_of_reads(spark):
    shape = "read_id bigint, n bigint, code bigint, genes array<bigint>, m int"
    rows = [(1, 4, 9, [5, 3], None), (1, 4, 2, [3], None), (1, 4, 8, [], 6), (1, 4, 7, [], 4), (2, 1, 5, [], 2), (3, 1, 1, [4, 2], None)]
    from pyspark.sql.types import LongType

    got = {r["read_id"]: (r["n"], r["wide"], r["m"], sorted(map(tuple, r["l"])), r["lead"]) for r in hits.genes_of_reads(spark.createDataFrame(rows, shape), LongType()).collect()}
    assert got == {1: (4, [7, 8], 6, [(1, 5), (2, 3)], 3), 2: (1, [5], 2, [], None), 3: (1, [], 0, [(1, 2), (1, 4)], 2)}

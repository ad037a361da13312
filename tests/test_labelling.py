"""Labelling and the null model against plain Python over the whole small tables."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmer.operators import index, labels, nullmodel, taxonomy
from quillmer.plans import registry
from quillmer.plans.fixtures import MIN_KMERS, MIN_SCORE, Fixtures, K

SF = "/root/testdata/sf0.001"
CLASSES = {"species": 2, "genus": 3, "family": 4}


def rc(s):
    return s[::-1].translate(str.maketrans("acgt", "tgca"))


def windows(seq):
    s = seq.lower()
    return [min(w, rc(w)) if set(w) <= set("acgt") else None for w in (s[i : i + K] for i in range(len(s) - K + 1))]


def gc_bin(seq):
    runs = [r for r in "".join(c if c in "acgt" else " " for c in seq.lower()).split() if len(r) >= K]
    n = sum(map(len, runs))
    return min(9, sum(c in "gc" for r in runs for c in r) * 10 // n) if n else None


class Plain:
    """The tables as dictionaries, and each step written down once more."""

    def __init__(self, f):
        self.tax = {r["tid"]: r for r in f.tax().collect()}
        self.lists = defaultdict(list)
        for r in f.pruned().collect():
            self.lists[r["kmer"]].append(r["tid"])
        self.null = {(r["tid"], r["gc_bin"]): r["cutoff"] for r in f.null().collect()}

    def path(self, t):
        return list(self.tax[t]["path"])

    def scores(self, seq):
        kmers = list(dict.fromkeys(w for w in windows(seq) if w))
        places = []
        for w in kmers:
            ts = {9606 if t in (9606, 63221, 741158) else t for t in self.lists.get(w, [])} - {20999999, 12721, 693660}
            places.append({t for t in ts if not any(t in self.path(u) for u in ts)})
        votes = Counter(t for p in places for t in p if self.tax[t]["rank"] == "strain")
        best = {}
        for t, n in votes.items():
            species = next(u for u in self.path(t) if self.tax[u]["rank"] == "species")
            best[species] = min(best.get(species, (0, 0)), (-n, t))
        chosen = {t for _, t in best.values()}
        hits = Counter()
        for p in places:
            hits.update(p | {u for t in p if self.tax[t]["rank"] != "strain" or t in chosen for u in self.path(t)})
        if not hits:
            return kmers, 0, {}
        kind = lambda t: 9 if self.tax[t]["depth"] == 0 else CLASSES.get(self.tax[t]["rank"], 0)
        own = {t: self.null[t, gc_bin(seq)] + 0.0001 if (t, gc_bin(seq)) in self.null else 1.0 for t in hits}
        odds = {t: math.log(n / len(kmers) / max(own[u] for u in hits if kind(u) <= kind(t))) for t, n in hits.items()}
        return kmers, sum(map(bool, places)), odds

    def label(self, seq):
        """(tid, score, match type), or the reason alone."""
        valid = sum(w is not None for w in windows(seq))
        if valid < MIN_KMERS:
            return (labels.SHORT,)
        kmers, found, odds = self.scores(seq)
        if not odds or found < 1 or len(kmers) < MIN_KMERS:
            return (labels.NO_HITS,)
        top = max(odds.values())
        phage = [s for t, s in odds.items() if t in (374840, 10847, 32630)]
        if phage and max(phage) >= top:
            call = (32630, max(phage), labels.DIRECT)
        else:
            used = [s for s in odds.values() if s > 0]
            used = used if len(used) > 3 else list(odds.values())
            mean = sum(used) / len(used)
            gap = math.sqrt(sum((s - mean) ** 2 for s in used) / (len(used) - 1)) if len(used) > 1 else 0.0
            call = self.call(odds, top, gap)
        return (labels.LOW,) if call[1] < MIN_SCORE else call

    def call(self, odds, top, gap):
        depth = lambda t: self.tax[t]["depth"]
        down = sorted(odds, key=lambda t: (round(odds[t], 3), depth(t), t), reverse=True)
        line = []
        while len(line) < len(down):
            t = down[len(line)]
            if any(depth(t) == depth(u) or not (t in self.path(u) or u in self.path(t)) for u in line):
                break
            line.append(t)
        rivals = down[len(line) :]
        tops = [t for i, t in enumerate(down) if t >= 10_000_000 and t < 11_000_000 and odds[t] >= top and (i <= len(line) or all(odds[u] >= top for u in down[len(line) : i]))]
        head = min(line, key=depth)
        chain = sorted({*line, *self.path(head)}, key=depth, reverse=True)
        unfit = set()
        for r in rivals:
            if r in self.path(head):
                continue
            stop = False
            for t in chain:
                if t in self.path(r):
                    break
                if t in odds and odds[t] - odds[r] > gap:
                    stop = True
                    break
                unfit.add(t)
            if stop:
                break
        if not unfit:
            low = max(line, key=depth)
            got = (low, odds[low], labels.DIRECT)
        else:
            fit = [i for i, t in enumerate(chain) if t not in unfit]
            got = (chain[fit[0]], max(odds[t] for t in chain[: fit[0] + 1] if t in odds), labels.MULTI) if fit else (0, -1.0, labels.LCA_ERROR)
        if tops and got[0] in self.path(tops[-1]):
            got = (tops[-1], *got[1:])
        return got


@pytest.fixture(scope="module")
def fixtures(spark):
    return Fixtures(spark, SF)


@pytest.fixture(scope="module")
def plain(fixtures):
    return Plain(fixtures)


def test_labels_equal_a_plain_caller(fixtures, plain):
    got = {r["read_id"]: r for r in fixtures.labelled().collect()}
    reads = fixtures.reads().collect()
    assert len(got) == len(reads)
    kinds, wrong = Counter(), []
    for r in reads:
        g, want = got[r["read_id"]], plain.label(r["seq"])
        have = (g["reason"],) if g["reason"] else (g["tid"], g["score"], g["match_type"])
        kinds[want[-1]] += 1
        same = have == want if len(want) == 1 else have[0::2] == want[0::2] and have[1] == pytest.approx(want[1], abs=1e-9)
        if not same:
            wrong.append((r["read_id"], have, want))
    assert not wrong, wrong[:5]
    assert {labels.DIRECT, labels.MULTI, labels.SHORT, labels.NO_HITS, labels.LOW} <= set(kinds)
    assert {9606, 32630, 10000001} <= {g["tid"] for g in got.values()}


def test_summaries_follow_the_calls(spark, fixtures):
    rows = [r for r in fixtures.labelled().collect()]
    count = Counter(r["tid"] for r in rows if r["reason"] is None)
    q = registry.queries()
    assert {r["tid"]: r["rc"] for r in q["taxon_summary"](spark, SF).collect()} == count
    assert {r["reason"]: r["n_reads"] for r in q["nomatch_summary"](spark, SF).collect()} == Counter(r["reason"] for r in rows if r["reason"])
    high = Counter(r["tid"] for r in rows if r["match_type"] in ("DirectMatch", "MultiMatch") and r["score"] >= 1.5 and r["n_kmers"] >= 25)
    assert {r["tid"]: r["rc"] for r in q["rebinned_summary"](spark, SF).collect()} == high
    ranks = {r["tid"]: (r["rank"], r["name"]) for r in fixtures.tax().collect()}
    want = {r["read_id"] for r in rows if r["match_type"] in ("DirectMatch", "MultiMatch") and r["score"] >= 1.0 and r["tid"] != 9606 and (ranks[r["tid"]][0] in ("species", "strain") or r["tid"] in (10000001, 10000002)) and "phage" not in ranks[r["tid"]][1]}
    assert {r["read_id"] for r in q["content_reads"](spark, SF).collect()} == want and want
    genus = {r["tid"]: r for r in q["ordered_summary"](spark, SF).collect()}
    paths = {r["tid"]: [r["tid"], *r["path"]] for r in fixtures.tax().collect()}
    for tid, r in genus.items():
        assert r["rc"] == sum(n for t, n in count.items() if tid in paths[t])
    assert sum(r["rc"] for r in q["call_rank_report"](spark, SF).where("rank = 'genus'").collect()) == sum(r["rc"] for r in genus.values())


def test_ordered_summary_holds_the_spectra_of_its_reads(spark, fixtures):
    """Each genus has a spectrum a k over the k-mers of the reads called at or below it; before, no genus had any."""
    paths = {r["tid"]: [r["tid"], *r["path"]] for r in fixtures.tax().collect()}
    calls = {(r["read_id"], r["tid"]) for r in fixtures.labelled().where("reason is null").collect()}
    seqs = [(r["read_id"], r["seq"].lower()) for r in fixtures.reads().collect()]
    flip = lambda w: w[::-1].translate(str.maketrans("acgt", "tgca"))
    rows = registry.queries()["ordered_summary"](spark, SF).collect()
    assert rows and all(r["n_spectra"] == 2 for r in rows)
    for r in rows[:3]:
        own = {i for i, t in calls if r["tid"] in paths[t]}
        for x in r["spectra"]:
            n = Counter(min(w, flip(w)) for i, s in seqs if i in own for w in (s[j : j + x["k"]] for j in range(len(s) - x["k"] + 1)) if set(w) <= set("acgt"))
            assert (x["n_distinct"], x["n_total"]) == (len(n), sum(n.values()))


def test_gaps_are_filled_as_a_plain_loop_does(spark):
    rows = registry.queries()["null_model_gap_fill"](spark, SF).collect()
    got, many = defaultdict(dict), 0
    for r in rows:
        got[r["tid"]][r["gc_bin"]] = (r["kcnt"], r["cutoff"])
    for tid, bins in got.items():
        kcnt = bins[0][0]
        obs = [0 if (tid * 7 + b * b) % 5 < 3 else 1 for b in range(10)]
        cut = [0.01 * ((tid + b * 3) % 7) if obs[b] else 0.5 if kcnt >= 100_000 else 0.0 for b in range(10)]
        for b in range(10):
            if not obs[b] and kcnt < 100_000:
                many += 1
                for d in range(1, 11):
                    near = max([cut[x] for x in (b - d, b + d) if 0 <= x < 10], default=0.0)
                    if near > 0:
                        break
                cut[b] = near if near > 0 else 0.5
        assert [bins[b][1] for b in range(10)] == pytest.approx(cut, abs=1e-9), tid
    assert many > 500


def test_random_reads_are_labelled_as_a_plain_scan_does(spark, fixtures, plain):
    reads = nullmodel.random_reads(spark, 60, 60)
    want = defaultdict(list)
    for r in reads.collect():
        assert r["seq"].count("g") + r["seq"].count("c") in range(int(6 * r["gc_bin"]), int(6 * r["gc_bin"]) + 7)
        kmers, _, odds = plain.scores(r["seq"])
        valid = sum(w is not None for w in windows(r["seq"]))
        probs = {t: None for t in odds}
        for t in probs:
            want[t, r["gc_bin"]].append((r["read_id"], len(kmers), valid))
    seen = nullmodel.of_random_reads(nullmodel.label_random(reads, fixtures.label_index(), K), reads).collect()
    assert {(r["tid"], r["gc_bin"]): r["n"] for r in seen} == {k: len(v) for k, v in want.items()} and seen


def test_roll_up_rules(spark):
    nodes = [
        (1, 1, "root", "no_rank"), (2, 1, "bacteria", "superkingdom"), (2759, 1, "euk", "superkingdom"), (28384, 1, "other", "no_rank"),
        (561, 2, "g", "genus"), (562, 561, "coli", "species"), (620, 2, "h", "genus"), (621, 620, "sh", "species"), (700, 2, "big", "genus"),
        (701, 700, "small one", "species"), (702, 700, "b", "species"), (800, 2759, "eg", "genus"), (801, 800, "e", "species"), (10000001, 702, "p", None), (28385, 28384, "vec", "species"),
    ]
    tax = taxonomy.closure(spark.createDataFrame(nodes, "tid int, parent int, name string, rank string"))
    counts = spark.createDataFrame([(562, 500_000), (621, 400_000), (701, 900), (702, 300_000), (801, 1_000_000), (10000001, 50), (28385, 10), (1, 9_000_000)], "tid int, n bigint")
    seen = [(562, 0, 0.1, 5), (621, 0, 0.2, 4), (701, 0, 0.9, 9), (702, 1, 0.3, 2), (801, 0, 0.7, 8), (10000001, 2, 0.8, 3)]
    model = spark.createDataFrame(seen, "tid int, gc_bin int, max_prob double, n bigint")
    got = defaultdict(dict)
    for r in nullmodel.roll_up(model, tax, counts, bins=3).collect():
        got[r["tid"]][r["gc_bin"]] = r["max_prob"]
    line = lambda t: [got[t][b] for b in range(3)]
    assert line(562) == line(621) == [0.2, 0.2, 0.2]  # both genera pool what they see
    assert line(702) == [0.3, 0.3, 0.3]  # the small genome and the plasmid lend nothing
    assert line(10000001) == [0.3, 0.3, 0.3]
    assert line(801) == [0.2, 0.2, 0.2] and line(28385) == [0.2, 0.2, 0.2] and line(1) == [1.0, 1.0, 1.0]


def test_statistics_of_neighbours(spark):
    rows = [(1, 100, 0.1), (2, 120, 0.3), (3, 900, 0.5), (4, 1_000_000, 0.7)]
    seen = spark.createDataFrame(rows, "tid int, kcnt bigint, prob double")
    got = {r["tid"]: (r["low"], r["high"], r["n"]) for r in nullmodel.neighbour_statistics(seen, 3).collect()}
    assert got == {1: (0.1, 0.5, 3), 2: (0.1, 0.5, 3), 3: (0.1, 0.5, 3), 4: (0.1, 0.7, 4)} or got[4][2] >= 3
    assert nullmodel.as_arrays(seen.select("tid", F.lit(1).alias("gc_bin"), F.col("prob").alias("max_prob"), F.lit(2).alias("n"))).count() == 4


def test_pruned_lists_are_short(fixtures):
    assert index.list_lengths(fixtures.pruned()).agg(F.max("list_length")).first()[0] <= 10

"""Toxicity end to end against a plain computation over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillmer.llm import toxicity


def plain(docs, marks, k=15, shrink=0.5):
    """{doc_id: (score, evidence)} by comparing each text with each example."""
    terms = {i: Counter(re.findall(r"\w+", (t or "").lower())) for i, t in docs}
    train = sorted((i, y) for i, y in marks if y is not None and i in terms and zlib.crc32(str(i).encode()) % 4 != 2)
    texts = dict(docs)
    holders, toxic = Counter(), Counter()
    for t, (i, y) in {texts[i]: (i, y) for i, y in reversed(train)}.items():  # each text once
        holders.update(terms[i].keys())
        if y:
            toxic.update(terms[i].keys())
    df = Counter(t for c in terms.values() for t in c)
    weight = {t: (math.log((len(docs) + 1) / (df[t] + 1)) + 1) * math.log2(2 + toxic[t] / max(1, h - toxic[t])) ** 2 for t, h in holders.items()}

    def unit(c):
        raw = {t: (1 + math.log(n)) * weight[t] for t, n in c.items() if t in weight}
        norm = math.sqrt(sum(w * w for w in raw.values())) or 1.0
        return {t: w / norm for t, w in raw.items()}

    units = [(i, y, unit(terms[i])) for i, y in train]
    share = sum(y for _, y, _ in units) / len(units)
    none = [y for _, y, u in units if not u]
    out = {}
    for i, c in terms.items():
        q = unit(c)
        if not q:
            out[i] = ((sum(none) + share) / (len(none) + 1), [])
            continue
        near = sorted((-round(sum(w * u.get(t, 0) for t, w in q.items()), 12), e, y) for e, y, u in units if q.keys() & u.keys())[:k]
        like = sum(-s for s, _, _ in near)
        out[i] = ((sum(-s * y for s, _, y in near) + shrink * share) / (like + shrink), [e for _, e, _ in near[:3]])
    return out


def made():
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(3)) for _ in range(300)]
    docs, marks = [], []
    for i in range(500):
        w = [words[min(int(r.expovariate(0.02)), 299)] for _ in range(r.randrange(1, 60))]
        if i % 6 == 0:
            w[r.randrange(len(w))] = r.choice(["Vile", "horrid,", "once%d" % i])
        docs.append((i, " ".join(w)))
        if i % 4:
            marks.append((i, float(i % 6 == 0)))
    docs += [(600, docs[6][1]), (601, docs[6][1]), (602, None), (603, ""), (604, "zzz unknown"), (605, " ".join(words) * 400), (606, "horrid")]
    return docs, [*marks, (602, 1.0), (603, 0.0), (700, 1.0)]


def test_scores_and_evidence_equal_a_plain_computation(spark):
    docs, marks = made()
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([*marks, (5, None)], "doc_id bigint, toxic double")
    index, known = toxicity.fit_toxicity(spark, df, labels)
    assert len(index.rows) and len(index.block_of) and len(known) == len({t for i, _ in marks if zlib.crc32(str(i).encode()) % 4 != 2 for d, x in docs if d == i for t in re.findall(r"\w+", (x or "").lower())})
    want = plain(docs, marks)
    for r in toxicity.score_toxicity(df, index, known).collect():
        assert np.isclose(r["score"], want[r["doc_id"]][0], atol=1e-9) and r["evidence"] == want[r["doc_id"]][1], r


def test_repeated_rows_ids_of_text_and_empty_tables(spark):
    docs, marks = made()
    rows = [(f"d{i:04d}", t) for i, t in docs] * 2 + [(None, "vile")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    labels = spark.createDataFrame([(f"d{i:04d}", y) for i, y in marks] * 2, "doc_id string, toxic double")
    index, known = toxicity.fit_toxicity(spark, df, labels, sample=100)
    assert len(index.ids) <= 100
    by = {}
    for r in toxicity.score_toxicity(df, index, known).collect():
        by.setdefault(r["doc_id"], []).append((r["score"], r["evidence"]))
    assert len(by[None]) == 1 and all(len(v) == 2 and v[0] == v[1] for i, v in by.items() if i)
    assert toxicity.score_toxicity(df.where("false"), index, known).count() == 0
    none = toxicity.fit_toxicity(spark, df.where("false"), labels)
    assert none[1] == {} and {r["score"] for r in toxicity.score_toxicity(df, *none).collect()} == {0.0}


def test_known_counts_keep_the_order_of_a_text():
    terms, counts = toxicity.known_counts("B a b x A a", {"a": 7, "b": 2})
    assert terms.tolist() == [2, 7] and counts.tolist() == [2, 3]
    assert [len(c) for c in toxicity.known_counts(None, {"a": 0})] == [0, 0]


def test_ranges_are_spread_in_order():
    at, n = toxicity._spread(np.array([4, 0, 9]), np.array([6, 0, 10]))
    assert at.tolist() == [4, 5, 9] and n.tolist() == [2, 0, 1]
    assert len(toxicity._spread(np.zeros(0, int), np.zeros(0, int))[0]) == 0

"""Fingerprints, groups and quality scores recomputed by plain Python."""

import math
import re
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillmer.llm import fingerprint, gray, quality

TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and THE quick brown fox runs"), (2, "one two"), (3, None), (4, ""), (5, "Äpfel sind rot, " * 40),
    (6, "w" * 5000 + " a b c"), (7, "a\tb\nc\x0bd\x0ce\rf"), (8, " ".join(f"w{i % 97}" for i in range(4000))), (8, "one two"), (None, "x y z x y z x y z"),
]
MASK = (1 << 64) - 1


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def majority(hashes):
    n = len(hashes)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def chain(seed, parts):
    """Spark's xxhash64 of an int and strings: each hash is the seed of the next."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), 42)
    for p in parts:
        h = xxhash.xxh64_intdigest(p.encode(), h)
    return h


def triples(t):
    w = words(t)
    return [w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [[" ".join(w)]] if w else []


def doc_fp(t):
    return "".join(f"{majority([chain(s, x) for x in triples(t)]):016x}" for s in (0, 1))


def test_document_fingerprints(spark):
    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string").withColumn("fp", F.lit("clash"))
    rows = sorted(((i if i is not None else -(1 << 63), chain_text(t)), i, t or "") for i, t in TEXTS)
    got = {(r["doc_id"], r["fingerprint"]): r for r in fingerprint.edited_fingerprints(spark, df, buckets=3).collect()}
    for k, (_, i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][2]
        half = len(t) // 2
        own, changed, other = doc_fp(t), doc_fp(t[: len(t) - half] + after[:half]), doc_fp(after)
        r = got[i, own]
        off = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
        assert r["edited_fingerprint"] == changed and r["near_edited"] == 1 - off(own, changed) / 128 and r["near_next"] == 1 - off(own, other) / 128


def chain_text(t):
    """Spark's xxhash64 of a text, signed: rows with one id are ordered by it."""
    h = xxhash.xxh64_intdigest((t or "").encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def test_simhash_fingerprints_and_groups(spark):
    long = " ".join(f"v{i}" for i in range(600))
    texts = [*TEXTS, (20, long), (21, long + " extra"), (22, long.replace("v300", "u300")), (23, long.upper())]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("component_id", F.lit("clash"))

    def plain(t):
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
        return majority([xxhash.xxh64_intdigest(r.encode(), 42) for r in runs])

    fps = [plain(t) for _, t in texts]
    near = np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)) <= 2
    group = [{k} for k in range(len(fps))]
    for _ in fps:
        group = [set().union(*(group[m] for m in np.flatnonzero(near[k]))) for k in range(len(fps))]
    low = [min((texts[m][0] for m in g if texts[m][0] is not None), default=None) for g in group]
    got = sorted(((r["doc_id"], f"{r['fp'] & MASK:016x}", r["component_id"]) for r in gray.simhash_groups(spark, df).collect()), key=str)
    assert got == sorted(((i, f"{f:016x}", c) for (i, _), f, c in zip(texts, fps, low, strict=True)), key=str)


def statistics(t):
    raw = t.encode()
    if not raw:
        return dict.fromkeys(quality.STATISTICS, 0.0)
    ws, lines, n = raw.split(), raw.split(b"\n"), len(raw)
    m = max(len(ws), 1)
    cls = lambda f: sum(f(b) for b in raw) / n
    upper, lower, digit, high = (lambda b: 65 <= b <= 90), (lambda b: 97 <= b <= 122), (lambda b: 48 <= b <= 57), (lambda b: b >= 128)
    blank, mark = (lambda b: b in b"\t\n\x0b\x0c\r "), (lambda b: b in b".,;:'\"!?()-")
    wordy = lambda b: upper(b) or lower(b) or digit(b) or high(b)
    share = [raw.count(bytes([b])) / n for b in set(raw)]
    pairs = list(zip(ws, ws[1:], strict=False))
    ups, lows = sum(map(upper, raw)), sum(map(lower, raw))
    return {
        "log_chars": math.log1p(n), "log_words": math.log1p(len(ws)), "word_len": n / m, "letters": cls(lambda b: upper(b) or lower(b) or high(b)),
        "uppers": ups / max(ups + lows, 1), "digits": cls(digit), "blanks": cls(blank), "marks": cls(mark),
        "symbols": cls(lambda b: not (wordy(b) or blank(b) or mark(b))), "line_len": math.log1p(n / len(lines)), "distinct_words": len(set(ws)) / m,
        "same_neighbours": sum(a == b for a, b in pairs) / m, "repeat_share": 1 - len(set(pairs)) / max(len(ws) - 1, 1), "line_copies": 1 - len(set(lines)) / len(lines),
        "marked_words": sum(len(w) > 2 and not any(wordy(b) for b in w[-2:]) for w in ws) / m, "upper_words": sum(w.isupper() for w in ws) / m,
        "pipes": raw.count(b"|") / m, "byte_entropy": -sum(s * math.log2(s) for s in share), "long_words": sum(len(w) > 24 for w in ws) / m,
    }


def test_quality_scores(spark):
    texts = [*TEXTS, (30, "A | B | C\nA | B | C\n!!! $$$ x"), (31, "SHOUT LOUD 123 456\n\n"), (31, "SHOUT LOUD 123 456\n\n")]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").withColumn("log_chars", F.lit("clash")).withColumn("score", F.lit(3))
    at = quality.STATISTICS.index
    rules = (
        quality.Rule(((at("uppers"), True, 0.1), (at("log_words"), False, 3.0)), 1.5), quality.Rule(((at("byte_entropy"), False, 3.5),), -2.0),
        quality.Rule(((at("repeat_share"), True, 0.2),), -0.7), quality.Rule(((at("word_len"), True, 6.0), (at("marks"), False, 0.01)), 0.4),
    )
    model = quality.RuleEnsemble(rules, 0.8)
    want = []
    for i, t in texts:
        x = statistics(t or "")
        z = 0.8 + sum(r.weight for r in rules if all((x[quality.STATISTICS[f]] > c) == above for f, above, c in r.terms))
        want.append((i, round(1 / (1 + math.exp(-z)), 9)))
    got = [(r["doc_id"], round(r["score"], 9)) for r in quality.score_quality(df, model).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = quality.keep_quality(df, model)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted((i for i, s in want if s >= 0.7), key=str)
    table = quality.with_statistics(df.select("doc_id", "text")).collect()
    plain = sorted((str(i), [round(v, 9) for v in (statistics(t or "")[s] for s in quality.STATISTICS)]) for i, t in texts)
    assert sorted((str(r["doc_id"]), [round(r[s], 9) + 0.0 for s in quality.STATISTICS]) for r in table) == plain

"""Training-data operators against brute force, and on null, empty, long, repeated and clashing inputs."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmer.llm import common, fingerprint, gray, mixing, packing, passages, pii, quality, toxicity, vectors, warc

RND = random.Random(11)
WORDS = ["".join(RND.choice("abcdefgh") for _ in range(RND.randrange(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(120, 1)
TEXTS = [
    (1, BASE), (2, BASE), (3, prose(60, 2) + " " + " ".join(BASE.split()[40:80])), (4, None), (5, ""), (6, "one"), (7, "one  two\tthree\n"),
    (8, prose(5000, 3)), (9, " ".join(BASE.split()[:119]) + " Changed"), (10, prose(30, 4)), (10, prose(30, 4)), (None, prose(30, 5)), (12, "Été été. \U0001f600 x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 3 else f"s{(i or 0) % 2}", None, 1.0, 2.0) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fp double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def key(r):
    return tuple((x is not None, x) if not isinstance(x, list) else (True, str(x)) for x in r)


def test_fingerprints_edit_and_next(spark, docs, empty):
    rows = sorted(((i if i is not None else -1 << 63, t or "", i) for i, t in TEXTS), key=lambda r: r[0])
    got = {}
    for r in fingerprint.edited_fingerprints(spark, docs, buckets=3).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, (_, t, i) in enumerate(rows):
        nxt, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want = hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()
        assert want in {r["edited_sha256"] for r in got[i]} and all(r["n_chars"] == len(t) for r in got[i])
    assert got[1][0]["fingerprint"] == got[2][0]["fingerprint"] and got[1][0]["near_next"] == 1.0 and got[4][0]["fingerprint"] == "0" * 32
    assert sum(map(len, got.values())) == len(TEXTS) and fingerprint.edited_fingerprints(spark, empty).count() == 0


def test_near_fingerprints_finds_all(spark):
    r = np.random.default_rng(1)
    base = r.integers(-(1 << 62), 1 << 62, (40, 2))
    near = base.copy()
    for row in near:
        for b in r.integers(0, 128, 4):
            row[b // 64] ^= np.int64(1) << np.int64(b % 63)
    df = spark.createDataFrame([([int(x) for x in row],) for row in [*base, *near]], "fp array<bigint>")
    got = {(tuple(x["query"]), tuple(x["match"])) for x in fingerprint.near_fingerprints(df, df, 4).collect()}
    full = [tuple(map(int, row)) for row in [*base, *near]]
    off = lambda a, b: sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(a, b, strict=True))
    assert got == {(a, b) for a in full for b in full if off(a, b) <= 4}


def test_gray_groups(spark, docs, empty):
    rnd = random.Random(2)
    fps = [rnd.getrandbits(64) for _ in range(60)]
    for _ in range(6):
        fps += [f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for f in fps[-40:]]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    scratch = common.Scratch(spark, "test")
    links = gray.near_links(spark, df, 2, scratch, cell_size=50)
    roots = {r["node"]: r["root"] for r in common.components(spark, links, scratch).collect()}
    a, b = np.nonzero(np.bitwise_count(np.array(fps, np.uint64)[:, None] ^ np.array(fps, np.uint64)) <= 2)
    want = common.local_roots(len(fps), a, b)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    group = [roots.get(s, s) for s in signed]
    assert len(set(zip(want.tolist(), group, strict=True))) == len(set(want.tolist())) == len(set(group))
    got = {(r["doc_id"], r["component_id"]) for r in gray.simhash_groups(spark, docs).collect()}
    assert {(1, 1), (2, 1), (4, 4), (5, 4), (10, 10)} <= got and gray.simhash_groups(spark, empty).count() == 0


def test_passages(spark, docs, empty):
    r = random.Random(5)
    few = [" ".join(r.choice("ab") for _ in range(r.randrange(0, 60))) for _ in range(25)]
    rows = [*TEXTS, *((100 + i, t) for i, t in enumerate(few))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    first = {}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    for i, t in rows:
        w = split(t)
        for p in range(len(w) - 12):
            if i is not None:
                first[tuple(w[p : p + 13])] = min(i, first.get(tuple(w[p : p + 13]), i))
    want = []
    for i, t in rows:
        w = split(t)
        gone = {q for p in range(len(w) - 12) if i is not None and first[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for q, x in enumerate(w) if q not in gone).encode()).hexdigest()))
    got = [tuple(x) for x in passages.dedup_passages(spark, df).collect()]
    assert sorted(got, key=key) == sorted(want, key=key) and passages.dedup_passages(spark, empty).count() == 0


def test_windows_that_only_hash_alike_stay(spark):
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    flipped = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([word] * 13)), (2, " ".join([flipped] * 13)), (3, " ".join([flipped] * 13))]
    got = {r["doc_id"]: r["n_removed"] for r in passages.dedup_passages(spark, spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_vectors(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 6))
    x = np.vstack([x, x[:30] + 0.2 * r.normal(size=(30, 6)), x[:5], 3 * x[:5]])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(200, None), (201, [0.0] * 6), (202, [1.0, None] + [0.0] * 4), (203, [float("nan")] * 6), (204, []), (205, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("n_links", F.lit("clash"))
    for size, most in ((1000, 1024), (8, 1024), (8, 3)):  # one cell, many with blocks, few large ones with blocks
        got = {g["vec_id"]: g for g in vectors.near_vectors(spark, df, per_cell=size, block=size, most_pivots=most).collect()}
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.9
        np.fill_diagonal(near, False)
        root = common.local_roots(len(x), *np.nonzero(near))
        assert all(got[i]["n_links"] == near[i].sum() and got[i]["component_id"] == root[i] and got[i]["kept"] == (root[i] == i) for i in range(len(x)))
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(200, 206))
    assert vectors.near_vectors(spark, df.where("false")).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (c > "4") for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", m) for m in EMAIL.finditer(t)] + [("ip", m) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", m) for m in CARD.finditer(t) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", m) for m in PHONE.finditer(t) if 9 <= len(digits(m)) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in out)


def test_pii(spark, empty):
    r = random.Random(8)
    noisy = ["".join(r.choice("12a@.+-( é") for _ in range(80)) for _ in range(60)]
    fixed = [None, "", "x@y.co_a@b.org", "1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "4111 1111-1111 1111 then 4111111111111112", "+1 (23) 456-7890 é😀 a@b.c", "1" * 4000, "a" * 5000 + "@"]
    seeded = [f"my number is 41111111111{k:05d} ok" for k in range(100, 400)]
    rows = list(enumerate([*fixed, *noisy, *seeded]))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(1)).withColumn("kind", F.lit(2))
    got = {g["doc_id"]: g for g in pii.pii_report(spark, df.select("doc_id", "text")).collect()}
    for i, t in rows:
        want = base_spans(t or "")
        assert got[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("id:")] == [s for s in want.split(",") if s]
    assert pii.pii_report(spark, empty).count() == 0
    clean = {g["doc_id"]: g["text"] for g in pii.redact(spark, df).collect()}
    assert clean[0] is None and clean[2] == "[email]_a@b.org" or "[email]" in clean[2]
    assert not EMAIL.search(clean[5]) and "é😀" in clean[5]


def test_patterns_find_unseen_identifiers(spark):
    cards = [d for k in range(4000) if luhn(d := f"411111111111{k:04d}")][:40]
    rows = [(i, f"the card {c} was used") for i, c in enumerate(cards)] + [(100, "the card ABCD12345678901 was used"), (101, "see page ABCD12345678901 here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {g["doc_id"]: g["spans"] for g in pii.pii_report(spark, df).collect()}
    assert got[100] == "id:9:24" and got[101] == ""


def labelled(spark):
    r, rows, marks = random.Random(9), [], []
    for i in range(400):
        bad, toxic = i % 4 == 0, i % 5 == 0
        words = prose(60, i).split()
        if toxic:
            words[r.randrange(60)] = r.choice(["vile", "horrid"])
        rows.append((i, " ".join(w + "!!" if bad else w for w in words)))
        marks.append((i, int(not bad), int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, prose(50, 1))], "doc_id bigint, text string")
    return docs, spark.createDataFrame([*marks, (902, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")


def test_quality_and_toxicity_on_held_out_rows(spark, empty):
    docs, marks = labelled(spark)
    truth = {m["doc_id"]: m for m in marks.collect()}
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    model = quality.fit_quality(spark, docs, marks)
    out = quality.score_quality(docs, model).collect()
    index, known = toxicity.fit_toxicity(spark, docs, marks)
    tox = toxicity.score_toxicity(docs, index, known).collect()
    assert len(out) == len(tox) == 403 and all(0 <= r["score"] <= 1 and r["held_out"] == held(r["doc_id"]) for r in [*out, *tox])
    assert np.mean([r["predicted"] == truth[r["doc_id"]]["quality"] for r in out if r["held_out"] and r["doc_id"] < 400]) > 0.97
    assert np.mean([r["predicted"] == truth[r["doc_id"]]["toxic"] for r in tox if r["held_out"] and r["doc_id"] < 400]) > 0.97
    kept = {r["doc_id"] for r in quality.keep_quality(docs.withColumn("score", F.lit(0)), model).collect()}
    assert kept == {r["doc_id"] for r in out if r["predicted"] == 1}
    none = marks.where("false")
    assert {r["score"] for r in quality.score_quality(docs, quality.fit_quality(spark, docs, none)).collect()} == {0.5}
    empty_index = toxicity.fit_toxicity(spark, docs, none)
    assert {r["score"] for r in toxicity.score_toxicity(docs, *empty_index).collect()} == {0.0}
    assert quality.score_quality(empty, model).count() == 0


def test_block_max_search_is_exact():
    r = random.Random(3)
    counts = [{t: r.randrange(1, 4) for t in r.sample(range(60), r.randrange(0, 8)) + [60] * (k % 3 > 0)} for k in range(700)]
    scale = np.array([1 + r.random() for _ in range(61)])
    flat = [(np.array(list(c), np.int64), np.array(list(c.values()), np.int64)) for c in counts]
    row, term, count = np.repeat(np.arange(700), [len(c) for c in counts]), *(np.concatenate([f[i] for f in flat]) for i in (0, 1))
    index = toxicity.BlockMaxIndex.build(list(range(700)), np.arange(700) % 2.0, row, term, count, scale)
    assert len(index.rows) and len(index.block_of)
    units = [dict(zip(t.tolist(), toxicity.unit(t, n, scale), strict=True)) for t, n in flat]
    for q, (t, n) in zip(units[:80], flat, strict=False):
        if q:
            full = sorted((-round(sum(q.get(x, 0) * w for x, w in u.items()), 12), i) for i, u in enumerate(units) if set(u) & set(q))[:10]
            like, near = index.nearest(t, n, 10)
            assert [index.ids[x] for x in near] == [i for _, i in full] and np.allclose(like, [-s for s, _ in full], atol=1e-9)


def test_warc(spark):
    rows = [(i, f"http://h/{i} x", h) for i, h in enumerate(["<a>", "<b>é", None, "", "<a>", "<a>", "x" * 50_000])] + [(20, None, "<b>é"), (None, "http://n/", "<a>")]
    rows += [(50, "http://m/", f"<m{k}>") for k in range(20)] + [(50, "http://m/", "<m3>"), (50, "http://o/", "<m3>"), (60, "http://m/", "<m3>"), (None, "http://n/", "<a>"), (None, None, "<z>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # rows of one page id are written by several tasks
    try:
        got = [tuple(g) for g in warc.page_captures(spark, df).collect()]
    finally:
        spark.conf.unset(key)
    first, want = {}, []
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in rows:
        raw = (h or "").encode()
        again = i is not None and i > first[h or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        want.append((i, len(raw), digest, "revisit" if again else "response", first[h or ""] if again else None))
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order) and warc.page_captures(spark, df.where("false")).count() == 0
    assert [g["record_type"] for g in warc.page_captures(spark, df.where("page_id in (2, 3)"), least=1).collect()] == ["response"] * 2


def test_archives_keep_transactions_and_name_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, "y")], "page_id bigint, url string, html string")
    folder = f"file://{tmp_path}/arc"
    files = common.Scratch(spark, "test").keep(warc.write_archives(spark, df, folder, most_bytes=1), "files")
    (tmp_path / "arc" / "pages-000000-00000-9-left.warc.gz").write_bytes(b"left behind by a lost attempt")
    rows = {r["metadata"][0]["page_id"]: r for r in warc.assemble(warc.read_archives(spark, folder, files)).collect()}
    assert sorted(rows) == [1, 2, 3] and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in rows.values())
    assert rows[2]["main"]["kind"] == "revisit" and rows[2]["main"]["refers_to"] == rows[1]["capture_id"] and rows[3]["main"]["uri"] == "urn:page:3"


def test_packing(spark, docs, empty):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path("word_bpe_49k.json"))
    odd = ["It's a.. b!. (c), é. x² <|endoftext|> İ 3.5 \x1c.", "naïve,café,. 'S. Q's. ΑΣ.", "é. Été,  a"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(50 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    rows = packing.pack(df).collect()
    ids = {}
    for r in df.collect():
        ids.setdefault(r["doc_id"], np.array(plain.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4"))
    for r in rows:
        got = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(got) and zlib.crc32(got[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert sum(r["length"] for r in rows) == sum(len(ids[r["doc_id"]]) for r in df.collect())
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty).count() == 0


def test_mixing(spark, docs, empty):
    rows = [(i, f"s{0 if i % 3 else i % 6}", prose(20 + i % 7, i)) for i in range(600)] + [(900, None, prose(30, 1)), (901, "void", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").withColumn("blocks", F.lit(1))
    out = mixing.mix(spark, df, target_entropy=0.95, repetition=3.0, block_tokens=500).collect()
    assert len(out) == len(rows)
    total = sum(r["mix_tokens"] for r in out)
    tokens, taken, weight = {}, {}, {}
    for r in out:
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["mix_tokens"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["mix_tokens"] * r["mix_copies"]
        weight[r["source"]] = r["mix_weight"]
    assert abs(sum(weight.values()) - 1) < 1e-9
    for s in tokens:
        assert weight[s] * total - 60 <= taken[s] <= weight[s] * total + 1e-6 and taken[s] <= 3.0 * tokens[s] + 1e-6
    assert mixing.entropy([0.5, 0.5]) == pytest.approx(0.6931471805599453)
    shares = {"a": 900, "b": 90, "c": 10, "d": 0}
    sources = spark.createDataFrame(list(shares.items()), "mix_source string, n bigint")
    a = mixing.choose_exponent(sources, 1000, 1000.0, 0.8, None)
    assert mixing.entropy(list(mixing.tempered(shares, a).values())) == pytest.approx(0.8 * np.log(3), abs=1e-6)
    b = mixing.choose_exponent(sources, 1000, 1000.0, None, 4.0)
    assert max(w * 1000 / shares[s] for s, w in mixing.tempered(shares, b).items() if shares[s]) == pytest.approx(4.0, abs=1e-5)
    order = {(r["source"], r["mix_block"]): r["mix_place"] for r in out}
    for s in tokens:
        places = sorted(p for (t, _), p in order.items() if t == s)
        assert places == list(range(1, len(places) + 1))
    many = spark.range(12_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"), F.lit("a b c").alias("text"))
    assert mixing.mix(spark, many, repetition=1.0).agg(F.sum("mix_copies")).first()[0] == 12_000
    assert mixing.mix(spark, empty).count() == 0 and mixing.mixed(spark, docs).columns == docs.columns


def test_components(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(999, i) for i in range(500, 560)]
    df = spark.createDataFrame(links, "a bigint, b bigint")
    got = {x["node"]: x["root"] for x in common.components(spark, df, common.Scratch(spark, "c")).collect()}
    a, b = np.array(links).T
    root = common.local_roots(1000, a, b)
    assert all(got.get(i, i) == root[i] for i in range(1000))

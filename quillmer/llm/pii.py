"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

1. Base patterns (email, ip, card, phone) give spans and so the seed instances.
2. Every token that holds a digit is an instance; the words (or the key, as in
   ``key=value``) before it are lexical patterns. Distinct (pattern, instance)
   pairs form a graph.
3. A pattern scores the mean of its instances' scores (smoothed by one more
   instance of score 0), an instance the noisy-or of its accepted patterns; a
   fixed number of rounds. Each round is two aggregates and two equi-joins over
   the graph, never over texts.
4. Identifier-shaped instances after accepted patterns become spans of kind ``id``:
   tokens without blanks or slashes, of ``least_chars`` characters and
   ``least_digits`` digits at least, that are no dates. Identifiers written with
   blanks, and tokens right after another token with a digit, are not found.

Base spans are always kept. Counts and ``base_sha256`` describe base spans only.

Defined results: null texts count as empty (no spans, the hash of the empty
string); offsets are code points; rows with null or repeated ids are kept and
treated by themselves; very long texts and contexts are taken whole; other columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch

# The kinds in their order, and the base patterns. A look-behind
# (or the end of the last match) starts runs once, so long runs stay linear.
KINDS = ("email", "ip", "card", "phone", "id")
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: The last two words of a text that was turned round, from its first character on.
CONTEXT = r"^\s++(\S++(?:\s++\S++)?)"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.char_length(digits)
    at = lambda i: digits.substr(n - i, F.lit(1)).cast("int")  # noqa: E731  i-th from the right
    one = lambda i: F.when(i % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + one(i))
    return total % 10 == 0


def _holds(kind: Column, value: Column) -> Column:
    """Whether a match of a base pattern passes its test; tokens pass."""
    digits = _digits(value)
    n = F.char_length(digits)
    short = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    small = F.forall(short, lambda p: (F.char_length(p) < 3) | ((F.char_length(p) == 3) & (p <= "255")))
    return (
        F.when(kind == 1, small)
        .when(kind == 2, n.between(13, 19) & F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == 3, n.between(9, 15))
        .otherwise(True)
    )


def _matches(text: Column, pattern: str, guard: Column, kind: int) -> Column:
    """The matches of pattern as structs (kind, i, gap: code points since the last match, tail, value)."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(gaps.alias("g"), found.alias("v"))
    tail = lambda g: F.reverse(F.regexp_extract(F.reverse(g), CONTEXT, 1))  # noqa: E731  anchored, so linear in the gap
    made = F.transform(
        both,
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["g"]).alias("gap"),
            (tail(x["g"]) if kind == 4 else F.lit("")).alias("tail"), x["v"].alias("value"),
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,tail:string,value:string>>")
    return F.when(guard, F.filter(made, lambda x: x["value"].isNotNull())).otherwise(none)


def find_matches(docs: DataFrame) -> DataFrame:
    """row, doc_id, th (hash of the text) and ``found``: all matches of all patterns in the text."""
    t = F.col("text")
    has_digit = t.rlike("[0-9]")
    base = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = [
        _matches(t, EMAIL, F.contains(t, F.lit("@")), 0), _matches(t, IP, has_digit, 1), _matches(t, CARD, has_digit, 2),
        _matches(t, PHONE, F.contains(t, F.lit("+")), 3), _matches(t, TOKEN, has_digit, 4),
    ]
    return base.select("row", "doc_id", F.xxhash64("text").alias("th"), F.concat(*parts).alias("found"))


def positioned(found: DataFrame) -> DataFrame:
    """One row a match that holds: row, doc_id, th, kind, start, end, tail, value; rows without any have kind null."""
    flat = found.select("row", "doc_id", "th", F.explode_outer("found").alias("m")).select("row", "doc_id", "th", "m.*")
    size = F.coalesce(F.char_length("value"), F.lit(0))
    w = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.coalesce("gap", F.lit(0)) + size).over(w)
    placed = flat.withColumn("end", ends.cast("int")).withColumn("start", F.col("end") - size)
    ok = F.col("kind").isNull() | _holds(F.col("kind"), F.col("value"))
    return placed.withColumn("ok", ok).select(
        "row", "doc_id", "th", F.when(F.col("ok"), F.col("kind")).alias("kind"), "start", "end", "tail", "value"
    )


def occurrences(spans: DataFrame, least_chars: int = 8, least_digits: int = 4) -> DataFrame:
    """Identifier-shaped tokens with their patterns, and whether they overlap a base span (then they are seeds)."""
    w = Window.partitionBy("row").orderBy("start", "kind", "end")
    is_base = F.col("kind") < 4
    before = F.max(F.when(is_base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(is_base, F.col("start"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    seen = spans.where("kind is not null").withColumn("before", before).withColumn("after", after).where("kind = 4")
    key = F.regexp_extract("value", r"^([^\s0-9=:]++[=:])", 1)
    lead = F.regexp_extract("rest", r"^[\"'(\[<{]*", 0)
    core = F.regexp_replace(F.col("rest").substr(F.char_length(F.col("lead")) + 1, F.char_length("rest")), r"[\"'.,;:!?)\]>}]+$", "")
    cut = (
        seen.withColumn("key", key).withColumn("rest", F.col("value").substr(F.char_length(F.col("key")) + 1, F.char_length("value")))
        .withColumn("lead", lead).withColumn("inst", core)
        .withColumn("start", F.col("start") + F.char_length("key") + F.char_length("lead"))
        .withColumn("end", F.col("start") + F.char_length("inst"))
        .withColumn("seed", F.coalesce(F.col("before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("after") < F.col("end"), F.lit(False)))
    )
    digits = F.char_length(_digits(F.col("inst")))
    date = F.col("inst").rlike(r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}")
    shaped = F.col("seed") | ((F.char_length("inst") >= least_chars) & (digits >= least_digits) & ~date & ~F.contains("inst", F.lit("/")))
    plain = F.regexp_replace(F.lower("tail"), "[0-9]", "0")
    patterns = F.array_distinct(F.filter(F.array(
        F.when(F.col("key") != "", F.concat(F.lit("k:"), F.lower("key"))),
        F.when(plain != "", F.concat(F.lit("1:"), F.substring_index(F.regexp_replace(plain, r"\s+", " "), " ", -1))),
        F.when(plain.rlike(r"\s"), F.concat(F.lit("2:"), F.regexp_replace(plain, r"\s+", " "))),
    ), lambda p: p.isNotNull()))
    return cut.where(shaped).select("row", "start", "end", "inst", "seed", F.explode(patterns).alias("pattern"))


def accepted_patterns(found: DataFrame, scratch: Scratch, rounds: int = 3, least_score: float = 0.6, least_support: int = 3) -> DataFrame:
    """The patterns that the graph scores trust: (pattern, trust)."""
    graph = scratch.keep(found.groupBy("pattern", "inst").agg(F.max("seed").alias("seed")), "graph")
    scored = graph.select("pattern", "inst", "seed", F.col("seed").cast("double").alias("s"))
    good = None
    for k in range(rounds):
        by = scored.groupBy("pattern").agg(F.sum("s").alias("s"), F.count("*").alias("n"), F.count_if(F.col("s") >= 0.5).alias("support"))
        trust = F.col("s") / (F.col("n") + 1)
        good = by.where((trust >= least_score) & (F.col("support") >= least_support)).select("pattern", trust.alias("trust"))
        good = scratch.keep(good, "patterns")
        if k + 1 < rounds:
            missed = graph.join(good, "pattern").groupBy("inst").agg((1 - F.exp(F.sum(F.log(1 - F.least("trust", F.lit(0.999)))))).alias("found"))
            new = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0.0)))
            scored = scratch.keep(graph.join(missed, "inst", "left").select("pattern", "inst", "seed", new.alias("s")), "scores")
    return good


def all_spans(spark: SparkSession, docs: DataFrame, rounds: int = 3) -> DataFrame:
    """row, doc_id, th, kind, start, end of every base and every discovered span; kind is null for rows without spans."""
    scratch = Scratch(spark, "pii")
    found = scratch.keep(find_matches(docs), "matches")
    spans = scratch.keep(positioned(found), "spans")
    seen = scratch.keep(occurrences(spans), "occurrences")
    good = accepted_patterns(seen, scratch, rounds)
    new = seen.where(~F.col("seed")).join(good.select("pattern"), "pattern", "left_semi").select("row", "start", "end").distinct()
    named = found.select("row", "doc_id", "th")
    base = spans.where("kind < 4 or kind is null").select("row", "doc_id", "th", "kind", "start", "end")
    rest = named.join(new, "row").select("row", "doc_id", "th", F.lit(4).alias("kind"), "start", "end")
    bare = named.select("row", "doc_id", "th", F.lit(None).cast("int").alias("kind"), F.lit(0).alias("start"), F.lit(0).alias("end"))
    every = scratch.keep(base.where("kind is not null").union(rest).union(bare), "every")
    for done in (found, spans, seen):
        scratch.drop(done)
    return every


def _listed(items: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(items, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row a document: counts and digest of base spans, and all spans."""
    spans = all_spans(spark, docs)
    one = F.struct("kind", "start", "end")
    by = spans.groupBy("row", "doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("s"),
        *[F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS[:4])],
    )
    base = F.filter("s", lambda x: x["kind"] < 4)
    return by.select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("s")).alias("spans"),
    )


def redact(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with every span of its texts replaced by ``[kind]``; n_chars, if there, follows the text."""
    spans = all_spans(spark, docs).where("kind is not null").select("doc_id", "th", "kind", "start", "end").distinct()
    w = Window.partitionBy("doc_id", "th").orderBy("start", "kind", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    cut = spans.withColumn("done", F.coalesce(F.max("end").over(w), F.lit(0))).where("end > done")
    cut = cut.withColumn("start", F.greatest("start", "done"))
    by = cut.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))
    by = by.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("cuts").alias("_cuts"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    piece = lambda x, i: F.concat(
        F.col("text").substr(
            F.when(i > 0, F.get("_cuts", i - 1)["end"]).otherwise(0) + 1, x["start"] - F.when(i > 0, F.get("_cuts", i - 1)["end"]).otherwise(0)
        ),
        F.get(names, x["kind"]),
    )
    rest = F.col("text").substr(F.element_at("_cuts", -1)["end"] + 1, F.char_length("text"))
    clean = F.concat(F.array_join(F.transform("_cuts", piece), ""), rest)
    on = (docs["doc_id"].eqNullSafe(by["_id"])) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == by["_th"])
    joined = docs.join(by, on, "left")
    new = {"text": F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(clean)}
    if "n_chars" in docs.columns:
        same = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("_cuts").isNull(), F.col("n_chars")).otherwise(F.char_length(clean).cast(same))
    return joined.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])

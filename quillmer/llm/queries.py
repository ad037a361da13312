"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, gray, mixing, packing, passages, pii, quality, toxicity, vectors, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality.fit_quality(spark, docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality.score_quality(docs, model)


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(spark, table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    index, known = toxicity.fit_toxicity(spark, docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score_toxicity(docs, index, known)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    out = mixing.mix(spark, docs)
    return out.select(
        "doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"),
        F.col("mix_block").alias("block"), F.col("mix_place").alias("place"), F.col("mix_copies").alias("copies"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_captures(spark, table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.dedup_passages(spark, table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = gray.simhash_groups(spark, table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", gray.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality, op2_vectors, op3_fingerprints, op4_pii, op5_toxicity, op6_mixing, op7_warc, op8_passages, op9_simhash, op10_packing, pipeline)
    return {f.__name__: f for f in own}


_OP2 = """
with recursive raw as (
  select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),
ok as (
  select vec_id, v from raw
  where v is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from ok a join ok b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.9),
reach(a, b) as (
  select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
low as (select a, min(b) as b from reach group by a)
select e.vec_id, (select count(*) from links l where l.a = e.vec_id)::bigint as n_links,
  least(e.vec_id, coalesce(low.b, e.vec_id)) as component_id,
  e.vec_id = least(e.vec_id, coalesce(low.b, e.vec_id)) as kept
from embeddings e left join low on low.a = e.vec_id
"""

_OP8 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(range(1, len(w) - 11)) as p, w from d where len(w) >= 13),
g as (select doc_id, p, array_to_string(w[p:p+12], ' ') as k from s),
f as (select k, min(doc_id) as first from g group by k),
gone as (select distinct g.doc_id, unnest(range(g.p, g.p + 13)) as p from g join f using (k) where f.first < g.doc_id),
removed as (select doc_id, list(p) as ps from gone group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(len(r.ps), 0)::bigint as n_removed,
  sha256(coalesce(case when r.ps is null then array_to_string(d.w, ' ')
    else (select string_agg(x.w, ' ' order by x.p) from (select unnest(d.w) as w, unnest(range(1, len(d.w) + 1)) as p) x
          where not list_contains(r.ps, x.p)) end, '')) as kept_sha256
from d left join removed r on r.doc_id = d.doc_id
"""

_OP7 = """
with p as (select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as low from pages),
d as (select *, list_transform(range(0, 8), lambda k: ('0x' || substr(sha1(html), (5 * k + 1)::int, 5))::int) as parts from p)
select page_id, strlen(html)::bigint as payload_bytes,
  list_reduce(list_transform(parts, lambda v: list_reduce(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1)), lambda a, b: a || b)),
    lambda a, b: a || b) as payload_digest,
  case when page_id > low then 'revisit' else 'response' end as record_type, case when page_id > low then low end as refers_to
from d
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_vectors": _OP2, "op7_warc": _OP7, "op8_passages": _OP8}

"""The same fixtures as common table expressions in DuckDB SQL."""

from __future__ import annotations

import re

from .fixtures import SPECIAL_GENOMES, SPECIAL_NODES, SPECIAL_READS, SPECIAL_STEP


def dna(text: str) -> str:
    return f"translate(md5({text}), '0123456789abcdef', 'acgtacgtacgtacgt')"


def rc(seq: str) -> str:
    return f"reverse(translate({seq}, 'acgt', 'tgca'))"


def windows(source: str, keys: str, k: int = 12) -> str:
    """keys, pos, kmer (canonical) of the windows of source.seq."""
    return f"""select {keys}, p - 1 as pos, least(f, {rc('f')}) as kmer from (
      select {keys}, p, substr(s, p, {k}) as f from (
        select {keys}, lower(seq) as s, unnest(range(1, length(seq) - {k} + 2)) as p from {source}))
    where regexp_full_match(f, '[acgt]+')"""


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"(values {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) as v({columns})"


PARTS = {
    "segs": "select c_mktsegment, row_number() over (order by c_mktsegment) - 1 as seg from (select distinct c_mktsegment from customer)",
    "nodes": """select 1 as tid, 1 as parent, 'root' as name, 'no_rank' as rank
      union all select 10 + r_regionkey, 1, r_name, 'family' from region
      union all select 100 + n_nationkey, 10 + n_regionkey, n_name, 'genus' from nation
      union all select distinct 200 + 10 * c_nationkey + seg, 100 + c_nationkey, c_mktsegment, 'species' from customer join segs using (c_mktsegment)
      union all select 100000 + c_custkey, 200 + 10 * c_nationkey + seg, concat('customer ', c_custkey), 'strain' from customer join segs using (c_mktsegment)
      union all select tid, parent, name, rank from """ + _values(SPECIAL_NODES, "tid, parent, name, rank"),
    "up": """select tid, tid as node, 0 as steps from nodes
      union all select u.tid, n.parent, u.steps + 1 from up u join nodes n on n.tid = u.node where n.parent <> n.tid""",
    "tax": "select n.*, (select max(steps) from up u where u.tid = n.tid) as depth from nodes n",
    "species": "select n.tid, (select u.node from up u join nodes m on m.tid = u.node where u.tid = n.tid and m.rank = 'species') as species from nodes n",
    "nrank": """select tid, case when rank = 'strain' then 16 when rank = 'species' then 15 when rank = 'genus' then 14
      when rank = 'family' then 12 when rank is null then 16 else 1 end as nrank from nodes""",
    "sgenomes": f"select i, tid, {dna('a')} || {dna('b')} || {dna('c')} as seq from " + _values([(i, *g) for i, g in enumerate(SPECIAL_GENOMES)], "i, tid, a, b, c"),
    "genomes": f"""select 100000 + c_custkey as tid, {dna("concat('region:', n_regionkey)")} || {dna("concat('nation:', n_nationkey)")} || {dna("concat('cust:', c_custkey)")} as seq
      from customer join nation on c_nationkey = n_nationkey union all select tid, seq from sgenomes""",
    "cut": f"""select o_orderkey as read_id, g.tid as true_tid, substr(g.seq, 1 + o_orderkey % 47, 50) as s from orders join genomes g on g.tid = 100000 + o_custkey
      union all select {SPECIAL_READS} + 10 * (i * 100 + o) + 5, tid, substr(seq, o + 1, 50) from (select *, unnest(range(0, 47, {SPECIAL_STEP})) as o from sgenomes)""",
    "reads": f"""select read_id, true_tid, case read_id % 10 when 0 then substr(s, 1, 25) || 'n' || substr(s, 27) when 1 then {rc('s')}
      when 2 then upper(s) when 3 then substr(s, 1, 8) when 4 then {dna("concat('noise:', read_id)")} else s end as seq from cut""",
    "pairs": f"select distinct kmer, tid from ({windows('genomes', 'tid')})",
    "below": """select kmer, node, count(*) as n, any_value(total) as total, any_value(depth) as depth from (
      select p.kmer, u.node, t.total, x.depth from pairs p join (select kmer, count(*) as total from pairs group by kmer) t using (kmer)
      join up u using (tid) join tax x on x.tid = u.node) group by kmer, node""",
    "subtree": """select kmer, node as tid from below b where n < total
      or depth = (select max(depth) from below c where c.kmer = b.kmer and c.n = c.total)""",
    "ranksums": """select kmer, nrank, sum(n) over (partition by kmer order by nrank) as upto, sum(n) over (partition by kmer) as total
      from (select kmer, nrank, count(*) as n from subtree join nrank using (tid) group by kmer, nrank)""",
    "pruned": """select s.kmer, s.tid from subtree s join nrank using (tid) join ranksums r on r.kmer = s.kmer and r.nrank = nrank.nrank
      where r.total <= 10 or r.upto <= 10
      union all select distinct kmer, 1 from ranksums group by kmer having max(total) > 10 and min(upto) > 10""",
    "rkmers": f"select read_id, kmer, min(pos) as pos from ({windows('reads', 'read_id')}) group by read_id, kmer",
    "clean": """select distinct kmer, case when tid in (9606, 63221, 741158) then 9606 else tid end as tid from pruned
      where tid not in (20999999, 12721, 693660)""",
    "hits0": "select k.read_id, k.pos, i.tid from rkmers k join clean i using (kmer)",
    "strict": "select h.* from hits0 h where not exists (select 1 from hits0 o join up u on u.tid = o.tid where o.read_id = h.read_id and o.pos = h.pos and u.steps > 0 and u.node = h.tid)",
    "repr": """select read_id, species, tid, n from (select read_id, species, tid, count(*) as n,
      row_number() over (partition by read_id, species order by count(*) desc, tid) as place
      from strict join nodes using (tid) join species using (tid) where rank = 'strain' group by read_id, species, tid) where place = 1""",
    "aug": """select distinct read_id, pos, tid from strict union
      select s.read_id, s.pos, u.node from strict s join nodes n using (tid) join up u on u.tid = s.tid
      where u.steps > 0 and (coalesce(n.rank, '') <> 'strain' or exists (select 1 from repr r where r.read_id = s.read_id and r.tid = s.tid))""",
    "probs": """select read_id, tid, count(*) as hits, any_value(n_kmers) as n_kmers, count(*) / any_value(n_kmers) as prob
      from aug join (select read_id, count(*) as n_kmers from rkmers group by read_id) using (read_id) group by read_id, tid""",
    "runs": "select read_id, unnest(string_split_regex(lower(seq), '[^acgt]+')) as run from reads",
    "bins": """select read_id, sum(length(run) - 11)::bigint as valid, least(9, floor(sum(length(regexp_replace(run, '[^gc]', '', 'g'))) * 10 / sum(length(run))))::int as gc_bin
      from runs where length(run) >= 12 group by read_id""",
    "nullm": """select tid, b as gc_bin, case when tid % 11 = 0 then 0.0::double else (0.01 * (1 + tid % 7) + 0.001 * b)::double end as cutoff
      from nodes, (select unnest(range(0, 10)) as b) where tid % 13 <> 5""",
    "classes": "select tid, case rank when 'species' then 2 when 'genus' then 3 when 'family' then 4 when 'no_rank' then 9 else 0 end as rank_class from nodes",
    "odds": """select read_id, tid, prob, chance as random_prob, ln(prob / chance) as score from (
      select read_id, tid, prob, max(coalesce(cutoff + 0.0001, 1.0)) over (partition by read_id order by rank_class range between unbounded preceding and current row) as chance
      from probs join bins using (read_id) left join nullm using (tid, gc_bin) join classes using (tid))""",
    "stats": """select read_id, case when count(*) filter (score > 0) <= 3 then avg(score) else avg(score) filter (score > 0) end as avg,
      coalesce(case when count(*) filter (score > 0) <= 3 then stddev_samp(score) else stddev_samp(score) filter (score > 0) end, 0) as stdev,
      max(score) as top from odds group by read_id""",
    "top": """select read_id, tid, prob as score from (select p.*, row_number() over (partition by read_id order by prob desc, depth desc, tid) as place
      from probs p join tax using (tid)) where place = 1""",
    "outcome": """select r.read_id, t.tid, t.score, case when coalesce(b.valid, 0) < 20 then 'ReadTooShort' when t.tid is null then 'NoDbHits' end as reason
      from reads r left join bins b using (read_id) left join top t using (read_id)""",
    "geneseq": f"select p_partkey as gid, {dna("concat('gene:', p_partkey % 20)")} || {dna("concat('part:', p_partkey)")} as seq from part",
    "gindex": f"select distinct kmer, gid from ({windows('geneseq', 'gid')})",
    "greads": f"""select l_orderkey * 10 + l_linenumber as read_id, substr({dna("concat('gene:', l_partkey % 20)")} || {dna("concat('part:', l_partkey)")}, 1 + l_orderkey % 15, 40) as seq from lineitem""",
    "gkmers": f"select read_id, kmer, count(*) as occurrences from ({windows('greads', 'read_id')}) group by read_id, kmer",
    "ghits": "select k.read_id, k.kmer, k.occurrences, i.gid from gkmers k join gindex i using (kmer)",
    "gbest": """select read_id, gid, hits, hits / n as gscore from (select read_id, gid, count(*) as hits,
      row_number() over (partition by read_id order by count(*) desc, gid) as place from ghits group by read_id, gid)
      join (select read_id, count(*) as n from gkmers group by read_id) using (read_id) where place = 1""",
    "gcov": """select gid, count(*) as n_kmers, sum(n)::bigint as sum_kmers from (select gid, kmer, sum(occurrences) as n
      from ghits join gbest using (read_id, gid) group by gid, kmer) group by gid""",
    "gtaxa": """select gid, tid, count(*) as rc, sum(gscore) as score_sum, count(*) filter (score >= 0.05) as rc_tax, coalesce(sum(gscore) filter (score >= 0.05), 0) as score_sum_tax
      from gbest join (select l_orderkey * 10 + l_linenumber as read_id, (100000 + l_suppkey)::int as tid, l_discount as score from lineitem) using (read_id)
      where gscore > 0.1 and hits > 20 group by gid, tid""",
    "samples": """select l_returnflag as sample, 100000 + o_custkey as tid, sum(l_discount) as wrc, count(*) as rc
      from lineitem join orders on l_orderkey = o_orderkey group by 1, 2""",
    "summary": "select tid, sum(wrc) as wrc, sum(rc)::bigint as rc from samples group by tid",
}
_WORD, _TEXT = re.compile(r"\b[a-z]\w*\b"), re.compile("'[^']*'")


def with_parts(body: str, extra: dict[str, str] | None = None) -> str:
    """body with all the parts that it uses, directly or not, before it."""
    parts = PARTS | (extra or {})
    used: dict[str, None] = {}

    def visit(text: str, own: str) -> None:
        for name in _WORD.findall(_TEXT.sub("", text)):
            if name in parts and name != own and name not in used:
                visit(parts[name], name)
                used[name] = None

    visit(body, "")
    listed = ",\n".join(f"{n} as materialized ({parts[n]})" if n != "up" else f"up as ({parts[n]})" for n in used)
    return f"with recursive {listed}\n{body}" if used else body

"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, eps_grid, exact, golay, packing, phrases, pii, quality, secret_scan, suffixes
from .common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.findings(table(spark, sf_dir, "documents"))


def op3_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eps_grid.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.findings(table(spark, sf_dir, "documents"))


def op5_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(table(spark, sf_dir, "documents"))


def op6_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golay.near_duplicates(table(spark, sf_dir, "documents"))


def op7_difference_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_secret_scan": op2_secret_scan,
    "op3_epsilon_grid": op3_epsilon_grid,
    "op4_pii": op4_pii,
    "op5_phrase_automata": op5_phrase_automata,
    "op6_golay_simhash": op6_golay_simhash,
    "op7_difference_cover": op7_difference_cover,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_best_fit_packing": op10_best_fit_packing,
}

#: A list of matches and the pieces between them give places, as code points.
_PLACES = """
  select doc_id, '{kind}' as kind, {rank} as rank, m[i] as found, {value} as value,
    list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s
  from (select doc_id, m, v, g, unnest(range(1, len(m) + 1)) as i from
    (select doc_id, regexp_extract_all(t, {pattern}) as m, {values} as v, string_split_regex(t, {pattern}) as g from texts where regexp_matches(t, {pattern})))
"""


def _places(kind: str, rank: int, pattern: str, group: int | None = None) -> str:
    quoted = "'" + pattern.replace("'", "''") + "'"
    return _PLACES.format(kind=kind, rank=rank, pattern=quoted, value="v[i]", values=f"regexp_extract_all(t, {quoted}, {group or 0})")


_ASSIGN_RE2 = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

_SECRETS = f"""
with texts as (select doc_id, coalesce(text, '') as t from documents),
places as ({_places("assign", 0, _ASSIGN_RE2, 1)} union all {_places("access", 1, "AKIA[A-Z0-9]+")} union all {_places("hex", 2, "[0-9a-f]+")}
  union all {_places("pem", 3, "-----BEGIN [A-Z ]*PRIVATE KEY-----")} union all {_places("forge", 4, "gh[pousr]_[A-Za-z0-9]+")}
  union all {_places("chat", 5, "xox[abpr]-[A-Za-z0-9-]+")} union all {_places("jwt", 6, r"eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]{8,}")}),
good as (select doc_id, kind, rank, s, s + length(found) as e from places where case kind when 'assign' then length(value) >= 6 when 'access' then length(found) >= 20
  when 'hex' then length(found) >= 24 when 'forge' then length(found) >= 40 when 'chat' then length(found) >= 15 else true end),
by_doc as (select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as k, count(*) filter (kind = 'hex') as h,
  string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) filter (rank < 3) as base, string_agg(kind || ':' || s || ':' || e, ',' order by s, rank) as spans from good group by doc_id)
select d.doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from documents d left join by_doc using (doc_id)
"""

_EXACT = r"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents),
found as (select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, sha256(t) as text_sha256 from texts)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from found
"""

#: Links by brute force; components by reachability.
_EMBEDDINGS = """
with recursive v as (select vec_id, cast(embedding as double[]) as x from embeddings where embedding is not null),
good as (select vec_id, x, sqrt(list_dot_product(x, x)) as norm from v where len(list_filter(x, lambda c: c is null or isnan(c) or isinf(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as w from good a join good b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95),
reach as (select vec_id as u, vec_id as w from embeddings union select r.u, l.w from reach r join links l on r.w = l.u),
roots as (select u, min(w) as component_id from reach group by u),
counts as (select u, count(*) as n from links group by u)
select e.vec_id, coalesce(c.n, 0) as n_links, r.component_id, e.vec_id = r.component_id as kept
from embeddings e join roots r on r.u = e.vec_id left join counts c on c.u = e.vec_id
"""

_PHRASES = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
w as (select doc_id, s, array_to_string(ws[s:s + 19], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 18)) as s from d)),
f as (select doc_id, s, row_number() over (partition by k order by doc_id, s) as r from w),
gone as (select distinct doc_id, s + o as p from f, (select unnest(range(20)) as o) where r > 1),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, len(d.ws) as n_words, len(d.ws) - coalesce(k.n, 0) as n_removed, sha256(coalesce(k.t, '')) as kept_sha256 from d left join kept k using (doc_id)
"""

ORACLES = {
    "op3_epsilon_grid": _EMBEDDINGS,
    "op2_secret_scan": _SECRETS,
    "op5_phrase_automata": _PHRASES,
    "op9_exact_dedup": _EXACT,
}

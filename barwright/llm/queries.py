"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import collocations, decontam, language_id, lm_score, near_dedup, packing, quality, resampling, simhash, substring_dedup, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op8_quality_rules", sql=r"""
with d as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select doc_id, x, count(*) as n from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by all),
dup as (select doc_id, sum(n)::bigint as n_lines, sum(n - 1)::bigint as n_dup_lines from lines group by 1),
win as (select doc_id, i, array_to_string(w[i:i + 7], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
rep as (select doc_id, count(distinct i + j)::bigint as n_repeat_words from (select doc_id, i from win qualify count(*) over (partition by doc_id, k) > 1) cross join (select unnest(range(0, 8)) as j) group by 1),
m as (select d.doc_id, lang, source, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(n_lines, 0) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) as n_letters
  from d left join dup using (doc_id) left join rep using (doc_id)),
s as (select *, case when n_words > 0 then n_symbols / n_words else 0 end as symbols, case when n_letters > 0 then n_upper / n_letters else 0 end as capitals, case when n_lines > 0 then n_dup_lines / n_lines else 0 end as dup_lines from m),
u as (select lang, source, unnest([{'rule': 'symbols', 'v': symbols, 'm': 0.1::double}, {'rule': 'capitals', 'v': capitals, 'm': 0.1::double}, {'rule': 'dup_lines', 'v': dup_lines, 'm': 0.5::double}]) as r from s where n_words > 0),
f as (select lang, source, r.rule as rule, r.m as m, case when r.v <= 1e-6 then -1000 else ceil(ln(r.v) / ln(1.02::double)) end::int as b from u),
g as (select 0 as level, lang, source, rule, m, b from f union all select 1, lang, null, rule, m, b from f union all select 2, null, null, rule, m, b from f),
h as (select level, lang, source, rule, m, b, sum(count(*)) over (partition by level, lang, source, rule order by b) as upto, sum(count(*)) over (partition by level, lang, source, rule) as n from g group by level, lang, source, rule, m, b),
e as (select level, lang, source, rule, m, b, upto, n, case when b = -1000 then 0 else pow(1.02::double, b) * (2 / 2.02::double) end as v, coalesce(max(upto) filter (b = -1000) over (partition by level, lang, source, rule), 0) as z from h),
q as (select level, lang, source, rule, max(n) as n, max(z) as z, any_value(m) as m, min(v) filter (upto >= 0.5 * n) as mid, min(v) filter (upto >= 0.1 * n) as low, min(v) filter (upto >= 0.9 * n) as high,
  coalesce(min(v) filter (v > 0 and upto - z >= 0.5 * (n - z)), 0) as typical from e group by 1, 2, 3, 4),
k as (select level, lang, source, rule, n, greatest(mid + 8 * (mid - low), high) + m + case when mid = 0 then (n - z) / n * typical else 0 end as cut from q),
c as (select level, lang, source, max(n) as n, max(cut) filter (rule = 'symbols') as c_s, max(cut) filter (rule = 'capitals') as c_c, max(cut) filter (rule = 'dup_lines') as c_d from k group by 1, 2, 3),
a1 as (select c.lang, least(c.c_s, 2 * o.c_s) as c_s, least(c.c_c, 2 * o.c_c) as c_c, least(c.c_d, 2 * o.c_d) as c_d from c, (select * from c where level = 2) o where c.level = 1 and c.n >= 100)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and not coalesce(symbols > case when n0 is null then s1 else least(s0, 2 * s1) end or capitals > case when n0 is null then c1 else least(c0, 2 * c1) end or dup_lines > case when n0 is null then d1 else least(d0, 2 * d1) end, false) as kept
from (select s.*, a.n as n0, a.c_s as s0, a.c_c as c0, a.c_d as d0, coalesce(b.c_s, o.c_s) as s1, coalesce(b.c_c, o.c_c) as c1, coalesce(b.c_d, o.c_d) as d1 from s
  left join c a on a.level = 0 and a.n >= 100 and a.lang is not distinct from s.lang and a.source is not distinct from s.source
  left join a1 b on b.lang is not distinct from s.lang left join c o on o.level = 2)
""")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    out, q, v = quality.quality_verdicts(docs)
    return out.select("doc_id", *[f"{q}.{c}" for c in quality.COUNTS[:5]], f"{v}.base_failed", f"{v}.kept")


#: Domains whose pages the registered query takes as its list of unwanted URLs.
UNWANTED = ("spam-farm", "casino-win", "adult-x", "free-bets")


@query("op9_url_filter", sql="""
with p as (
  select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
q as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path
  from (select page_id, coalesce(rest, '') as rest from p)),
r(rule, rhost, rpath, verdict) as (values ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
m as (
  select q.page_id, q.host, q.path, arg_max(r.rule, length(r.rule)) as rule, arg_max(r.verdict, length(r.rule)) as v from q
  join r on (q.host = r.rhost or ends_with(q.host, '.' || r.rhost)) and starts_with(q.path, r.rpath) group by all),
listed as (
  select distinct regexp_replace(host, '^(www\\.|m\\.)', '') || regexp_replace(regexp_replace(path, '\\.html$', ''), '/$', '') as c from q
  where regexp_matches(host, '(^|\\.)(spam-farm|casino-win|adult-x|free-bets)\\.'))
select q.page_id, q.host, q.path, m.rule,
  coalesce(m.v, case when (regexp_replace(q.host, '^(www\\.|m\\.)', '') || regexp_replace(regexp_replace(q.path, '\\.html$', ''), '/$', '')) in (select c from listed)
           then 'block' else 'allow' end) as verdict
from q left join m on q.page_id = m.page_id and q.host = m.host and q.path = m.path
""")
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, url_filter.domain_list(pages, UNWANTED)).select("page_id", "host", "path", "rule", "verdict")


@query("op10_warc_archive", sql="""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
f as (select h, payload_bytes, min(page_id) as lo from p group by all)
select p.page_id, p.payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(h, (1 + 5 * (i // 4))::int, 5))::int >> (15 - 5 * (i % 4))::int) & 31), 1)), '') as payload_digest,
  case when page_id = lo then 'response' else 'revisit' end as record_type, case when page_id <> lo then lo end as refers_to
from p join f using (h, payload_bytes)
""")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    records = warc.read_archive(spark, warc.write_archive(pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op4_substring_dedup", sql=r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 19], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
rep as (select doc_id, i from win qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select distinct doc_id, i + j as p from rep cross join (select unnest(range(0, 20)) as j)),
kept as (select doc_id, string_agg(x, ' ' order by p) as t, count(*) as n from (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as p from d) anti join gone using (doc_id, p) group by 1)
select d.doc_id, len(w)::bigint as n_words, len(w)::bigint - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)
""")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.repeats_removed(docs).select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


@query("op1_minhash_near_dedup", sql=r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
e as (select distinct doc_id, k from (select doc_id, array_to_string(w[i:i + 4], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4)),
n as (select doc_id, count(*) as n from e group by 1),
link as (select x.a, x.b from (select p.doc_id as a, q.doc_id as b, count(*) as i from e p join e q on p.k = q.k and p.doc_id < q.doc_id group by 1, 2) x join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b
  where 100 * i >= 75 * (na.n + nb.n - i)),
reach as (select doc_id, doc_id as r from d union select reach.doc_id, l.b from reach join (select a, b from link union all select b, a from link) l on l.a = reach.r)
select d.doc_id, coalesce(n.n, 0) as n_shingles, min(r) as component_id, d.doc_id = min(r) as kept from d join reach using (doc_id) left join n using (doc_id) group by d.doc_id, n.n
""")
def op1(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op5_benchmark_decontamination")
def op5(spark, sf_dir):
    return decontam.find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


@query("op3_best_fit_packing")
def op3(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


@query("op6_language_id")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = language_id.held_out("doc_id", 5, 0)
    model = language_id.train(docs.where(~held))
    return language_id.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op2_toxicity")
def op2(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = language_id.held_out("doc_id", 4, 2)
    model = toxicity.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


@query("op7_lm_score")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.lm_scores(docs, language_id.held_out("doc_id", 10, 0))


@query("op11_importance_resampling", sql=r"""
with steps as (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) t(i)),
step as (select list(v order by i) as s from steps),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
o as (select doc_id, unnest(w) as x from d),
p as (select unnest(w) as x from b),
words as (select x, hex(encode(x)) as h from (select x from o union select x from p)),
coded as (select x, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint)),
    lambda c, y: xor(c >> 8, (s[xor(c & 255, y) + 1])::bigint)), 4294967295) % 10000 as k from words, step),
s as (select k, count(*) as n from o join coded using (x) group by 1),
t as (select k, count(*) as n from p join coded using (x) group by 1),
sums as (select (select count(*) from o)::double as ns, (select count(*) from p)::double as nt),
gain as (select i as k, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (ns + 10000) / ((coalesce(s.n, 0) + 1)::double * (nt + 10000))))::bigint as g from range(10000) r(i) left join s on s.k = i left join t on t.k = i, sums),
m as (select doc_id, count(*) as n, sum(g)::bigint as total from o join coded using (x) join gain using (k) group by 1),
weighed as (select d.doc_id, len(w)::bigint as n_features, case when coalesce(n, 0) = 0 then 0 else (total - ((total % n) + n) % n) // n end::bigint as weight,
  ('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::bigint as h from d left join m using (doc_id)),
scored as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint as score from weighed),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as place, count(*) over () as all_rows from scored where n_features >= 20)
select doc_id, n_features, weight, score, case when place <= 10 * all_rows // 100 then place end::bigint as rank from scored left join ranked using (doc_id)
""")
def op11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return resampling.resample(docs, table(spark, sf_dir, "benchmark"), percent=10, sizes=(1, 1), buckets=10_000, least_words=20, seed=2024).select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_simhash_near_dedup")
def op12(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=3, size=3)


@query("op13_collocations", sql=r"""
with piece as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as t from documents),
w as (select lang, regexp_extract_all(t, '[^\x20\x09]+') as w from piece),
f as (select lang, k, phrase, count(*)::bigint as a from (
  select lang, 1 as k, unnest(w) as phrase from w
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from w
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from w) group by all),
n as (select lang, sum(a)::bigint as n from f where k = 1 group by 1),
c as (select lang, k, phrase, a, string_split(phrase, ' ') as x from f where k > 1 and a >= 10),
longer as (select lang, phrase, max(a) as m from (select lang, x[1] || ' ' || x[2] as phrase, a from c where k = 3 union all select lang, x[2] || ' ' || x[3], a from c where k = 3) group by 1, 2),
kept as (select c.* from c left join longer using (lang, phrase) where k = 3 or m is null or 100 * m < 50 * a),
cuts as (select lang, phrase, a, cut, array_to_string(x[1:cut], ' ') as first, array_to_string(x[cut + 1:], ' ') as rest from (select *, unnest(range(1, k)) as cut from kept)),
valued as (select cuts.lang, cuts.phrase, cuts.a, cut, l.a as l, r.a as r, ((1000000::hugeint * cuts.a * cuts.a) // (l.a::hugeint * r.a))::bigint as score
  from cuts join f l on l.lang = cuts.lang and l.phrase = first and l.k = cut join f r on r.lang = cuts.lang and r.phrase = rest),
best as (select * from valued qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select best.lang, row_number() over (partition by best.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n.n, score from best join n on n.lang = best.lang
qualify row_number() over (partition by best.lang order by score desc, a desc, phrase) <= 2000
""")
def op13(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"), longest=3, least=10, share=50, per_lang=2000)

"""DuckDB twins of the operators' queries that SQL can express in reasonable time."""

from __future__ import annotations

from parlance.llm import license_scan, quality_rules

SPACE_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
ALNUM_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _rules() -> str:
    rates = quality_rules.RATES
    pair = " union all ".join(f"select lang, source, '{r}' as rate, {r} as v, base_failed from m" for r in rates)
    tail = "case rate " + " ".join(f"when '{r}' then {k}" for r, k in quality_rules.TAILS.items()) + " end"
    bucket = lambda v: f"(({v} >> greatest(length(bin({v})) - {quality_rules.GRAIN_BITS + 1}, 0)) << greatest(length(bin({v})) - {quality_rules.GRAIN_BITS + 1}, 0))"
    at = lambda k: f"min(bucket) filter (upto * 100 >= n * {k})"
    high = f"case rate when 'word_len' then {at(75)} + {quality_rules.FENCE} * greatest({at(75)} - {at(25)}, {at(75)} >> {quality_rules.GRAIN_BITS}) else {at(tail)} + greatest({at(tail)}, coalesce(min(bucket) filter (bucket > 0 and (upto - none) * 20 >= n - none), 0)) // 2 end"
    level = lambda k, cols: f"l{k} as (select {cols} n, {', '.join(f'max(high) filter (rate = {_q(r)}) as max_{r}' for r in rates)} from (select {cols} rate, any_value(n) as n, {high} as high from (select {cols} rate, bucket, sum(k) over (partition by {cols} rate order by bucket) as upto, sum(k) over (partition by {cols} rate) as n, sum(if(bucket = 0, k, 0)) over (partition by {cols} rate) as none from (select {cols} rate, bucket, count(*) as k from s group by all)) group by {cols} rate) group by {cols} n)"
    half = lambda r, v: v if r == "word_len" else f"({v}) // 2"
    settled = lambda side, r, above: f"case when {side}.n >= {quality_rules.LEAST_TEXTS} then greatest({side}.max_{r}, {half(r, above)}) else {above} end"
    limit = lambda r: settled("a", r, settled("b", r, f"c.max_{r}"))
    ok = " and ".join(f"coalesce({bucket('m.' + r)} <= {limit(r)}, true)" for r in rates)
    return f"""with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text, {SPACE_WORDS} as ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
w as (select rid, i, array_to_string(ws[i:i + 7], ' ') as x from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from d where len(ws) >= 8)),
t as (select rid, x from w group by all having count(*) > 1),
r as (select rid, count(distinct p) as k from (select w.rid, unnest(range(w.i, w.i + 8)) as p from w join t on w.rid = t.rid and w.x = t.x) group by rid),
b as (select rid, doc_id, lang, source, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(k, 0) as n_repeat_words, len(lines) as n_lines from d left join r using (rid)),
m as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, cast(floor(n_symbols * 10000 / greatest(word_chars, 1)) as bigint) as symbols, cast(floor(n_dup_lines * 10000 / greatest(n_lines, 1)) as bigint) as dup_lines, cast(floor(n_repeat_words * 10000 / greatest(n_words, 1)) as bigint) as repeats, cast(floor(word_chars * 100 / greatest(n_words, 1)) as bigint) as word_len from b),
s as (select lang, source, rate, {bucket('v')} as bucket from ({pair}) where not base_failed),
{level(0, 'lang, source,')}, {level(1, 'lang,')}, {level(2, '')}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {ok} as kept, {', '.join('m.' + r for r in rates)}
from m left join l0 a on m.lang is not distinct from a.lang and m.source is not distinct from a.source left join l1 b on m.lang is not distinct from b.lang left join l2 c on true"""


SUBSTRINGS = f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as raw, {SPACE_WORDS} as ws from documents),
w as (select rid, doc_id, i, array_to_string(ws[i:i + 19], ' ') as x from (select rid, doc_id, ws, unnest(range(1, len(ws) - 18)) as i from d where len(ws) >= 20)),
f as (select x, min((doc_id, i)) as first from w group by x),
g as (select rid, list(distinct p) as gone from (select rid, unnest(range(i, i + 20)) as p from w join f using (x) where (doc_id, i) > first) group by rid)
select doc_id, len(ws) as n_words, coalesce(len(gone), 0) as n_removed, coalesce(k.n_spans, 0) as n_spans, sha256(array_to_string(case when gone is null then ws else list_filter(ws, lambda v, j: not list_contains(gone, j)) end, ' ')) as kept_sha256,
case when gone is null then raw else regexp_extract(raw, '^[\x20\x09-\x0D]*') || array_to_string(list_filter(regexp_extract_all(raw, '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*'), lambda v, j: not list_contains(gone, j)), '') end as text
from d left join g using (rid) left join (select rid, count(*) filter (p <> before + 1 or before is null) as n_spans from (select rid, p, lag(p) over (partition by rid order by p) as before from (select rid, unnest(gone) as p from g)) group by rid) as k using (rid)"""

DECONTAMINATION = f"""with it as (select item_id, {ALNUM_WORDS} as ws from benchmark where item_id is not null),
iw as (select distinct cast(item_id as varchar) as item_id, least(len(ws), 13) as k, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') as x from (select *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as i from it where len(ws) > 0)),
d as (select row_number() over () as rid, doc_id, {ALNUM_WORDS} as ws from documents),
dw as (select rid, i, k, array_to_string(ws[i:i + k - 1], ' ') as x from (select rid, ws, k, unnest(range(1, len(ws) - k + 2)) as i from d, (select distinct k from iw) where len(ws) >= k)),
h as (select rid, i, dw.k, item_id from dw join iw using (k, x)),
c as (select rid, count(distinct p) as n_hit from (select rid, unnest(range(i, i + k)) as p from h) group by rid),
n as (select rid, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as items from h group by rid)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from d left join c using (rid) left join n using (rid)"""


def _licenses() -> str:
    rows = []
    for i, t in enumerate(license_scan.TEMPLATES):
        at, n = t.key_at
        rows.append(f"({i}, {_q(t.label)}, {str(t.base).lower()}, [{', '.join(map(_q, t.words))}], {at}, {n}, {_q(t.words[at])}, {_q(' '.join(t.words[at : at + n]))})")
    return f"""with t(id, label, base, tw, kpos, klen, head, phrase) as (values {', '.join(rows)}),
d as (select row_number() over () as rid, doc_id, {ALNUM_WORDS} as ws from documents),
v as (select distinct unnest(tw) as word from t),
df as (select word, count(distinct rid) as n from (select rid, unnest(list_distinct(ws)) as word from d) semi join v using (word) group by word),
idf as (select word, ln(((select count(*) from documents) + 1) / (coalesce(n, 0) + 0.5)) as w from v left join df using (word)),
x as (select * from t),
p as (select rid, i, word from (select rid, unnest(ws) as word, generate_subscripts(ws, 1) as i from d) where word in (select head from t)),
h as (select d.rid, x.id, x.label, x.base, p.i - 1 - x.kpos as off, x.tw, d.ws from p join x on p.word = x.head join d on d.rid = p.rid where p.i - 1 - x.kpos >= 0 and array_to_string(d.ws[p.i:p.i + x.klen - 1], ' ') = x.phrase),
s as (select rid, id, label, base, off, round(sum(w) filter (ws[off + j] = tw[j]) / nullif(sum(w), 0), 6) as score from (select *, unnest(range(1, len(tw) + 1)) as j from h) join idf on idf.word = tw[j] group by all),
k as (select * from s where base or score >= {license_scan.LEAST_SCORE}),
g as (select rid, count(*) filter (base) as n_base, min(off) filter (base) as first_word, max(off) filter (base) as last_word, string_agg(distinct label, ',' order by label) filter (base) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(score) as score from k group by rid)
select doc_id, len(ws) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0.0) as score from d left join g using (rid)"""


JACCARD = f"""with recursive d as (select row_number() over () as rid, doc_id, {SPACE_WORDS} as ws from documents),
s as (select distinct rid, x from (select rid, array_to_string(ws[i:i + 4], ' ') as x from (select rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from d where len(ws) > 0))),
n as (select rid, count(*) as k from s group by rid),
i as (select a.rid as a, b.rid as b, count(*) as c from s a join s b on a.x = b.x and a.rid <> b.rid group by all),
e as (select a, b from i join n x on x.rid = a join n y on y.rid = b where c * 5 >= (x.k + y.k - c) * 4),
r as (select rid as a, rid as b from d union select r.a, e.b from r join e on r.b = e.a),
g as (select r.a as rid, min(d.doc_id) as class_id from r join d on d.rid = r.b group by r.a),
c as (select b.rid, min(d.doc_id) as copy_of from (select rid, array_to_string(list(x order by x), chr(10)) as key from s group by rid) b join (select rid, array_to_string(list(x order by x), chr(10)) as key from s group by rid) o using (key) join d on d.rid = o.rid group by b.rid)
select d.doc_id, g.class_id, coalesce(l.k, 0) as n_links, coalesce(c.copy_of, d.doc_id) as copy_of from d join g using (rid) left join (select a as rid, count(*) as k from e group by a) l using (rid) left join c using (rid)"""

ORACLES = {"op1_quality_rules": _rules(), "op3_substring_dedup": SUBSTRINGS, "op6_decontamination": DECONTAMINATION, "op8_license_scan": _licenses(), "op9_ngram_join": JACCARD}

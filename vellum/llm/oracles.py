"""SQL with the results of the operators that SQL can express."""

from __future__ import annotations

from vellum.llm.decontaminate import NAMES, SIMILARITY, UNITS, WINDOW

QUALITY_RULES = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), w as (
  select doc_id, generate_subscripts(words, 1) as pos, unnest(words) as word from d
), tri as (
  select doc_id, pos, case when lead(pos, 2) over o is not null then [word, lead(word) over o, lead(word, 2) over o] end as tri
  from w window o as (partition by doc_id order by pos)
), twice as (
  select doc_id, pos, tri is not null and count(*) over (partition by doc_id, tri) > 1 as hit from tri
), covered as (
  select doc_id, max(case when hit then 1 else 0 end) over (partition by doc_id order by pos rows between 2 preceding and current row) as c from twice
), rep as (select doc_id, sum(c)::bigint as n_repeat_words from covered group by 1),
lines as (
  select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), m as (
  select doc_id, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(lines)::bigint as n_lines,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper,
    (length(text) - length(regexp_replace(text, '[a-z]', '', 'g')))::bigint as n_lower
  from d join lines using (doc_id) left join rep using (doc_id)
), b as (
  select *,
    (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (100 * n_symbols > 20 * n_words)::bigint
    + 8 * (10 * word_chars < 20 * n_words)::bigint + 16 * (word_chars > 25 * n_words)::bigint
    + 32 * (100 * n_dup_lines > 40 * n_lines)::bigint
    + 64 * (100 * n_upper > 60 * (n_upper + n_lower) and n_upper > 50)::bigint as fail_bits
  from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits from b
"""

_TOKEN = r"[\p{L}\p{N}]+(?:[.,''’-][\p{L}\p{N}]+)*[.!?:]?"
_UNITS = ", ".join(f"'{u}'" for u in UNITS)


def _templates(table: str, key: str) -> str:
    """Tokens with their templates, and whether each is a capital word inside a sentence."""
    return f"""
  select {key}, pos, low,
    case when ascii(w) between 48 and 57 then '<num>' when prev is not null and ascii(prev) between 48 and 57 and low in ({_UNITS}) then '<unit>' else low end as t,
    (ascii(w) between 65 and 90 or (unicode(w) > 127 and low <> bare)) and prev is not null and right(prev, 1) not in ('.', '!', '?', ':')
      and length(bare) > 1 and upper(bare) <> bare as capital
  from (select *, rtrim(w, '.!?:') as bare, lower(rtrim(w, '.!?:')) as low, lag(w) over (partition by {key} order by pos) as prev
        from (select {key}, generate_subscripts(ws, 1) as pos, unnest(ws) as w
              from (select {key}, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') as ws from {table})))"""


_NEXT = ", ".join(f"lead(t, {i}) over o as t{i}" for i in range(1, WINDOW))
_WILD = ", ".join(f"coalesce(lead(wild, {i}) over o, 0) as w{i}" for i in range(1, WINDOW))
_BLANK = "[" + ", ".join(f"case when mask & {1 << i} <> 0 then '<name>' else t{i} end" for i in range(WINDOW)) + "][:k]"
_FEW = " + ".join(f"w{i}" for i in range(WINDOW)) + f" <= {NAMES}"

DECONTAMINATE = f"""
with b as (select row_number() over () as item, item_id, text from (select distinct item_id, text from benchmark where item_id is not null)),
dt as ({_templates("documents", "doc_id")}), b0 as ({_templates("b", "item")}),
size as (select item, least(count(*), {WINDOW}) as k from b0 group by 1),
bt as (
  select b0.*, k, (k = {WINDOW} and t not in ('<num>', '<unit>') and names.item is not null)::int as wild
  from b0 join size using (item) left join (select distinct item, low from b0 where capital) names on names.item = b0.item and names.low = b0.low
), bl as (select item, pos, k, t as t0, {_NEXT}, wild as w0, {_WILD}, count(*) over (partition by item) as n from bt window o as (partition by item order by pos)),
bm as (select *, case when k = {WINDOW} and {_FEW} then {" + ".join(f"{1 << i} * w{i}" for i in range(WINDOW))} else 0 end as mask from bl where pos <= n - k + 1),
bw as (select item, pos, k, mask, {_BLANK} as win from bm),
forms as (select distinct k, mask from bw),
dl as (select doc_id, pos, t as t0, {_NEXT}, count(*) over (partition by doc_id) as n from dt window o as (partition by doc_id order by pos)),
dw as (select doc_id, pos, k, mask, {_BLANK} as win from dl join forms on pos <= n - k + 1),
n as (select item, count(*) as n_windows from bw group by 1),
hits as (select distinct doc_id, item, dw.pos - bw.pos as shift, bw.pos as pos from dw join bw using (k, mask, win)),
near as (select doc_id, item, shift from (select doc_id, item, shift, count(*) as n_hits from hits group by all) join n using (item) where n_hits >= n_windows * {SIMILARITY}),
slots as (
  select near.doc_id, near.item, near.shift, case when bt.wild = 1 then '<name>' else bt.t end as kind, bt.low as old, dt.low as new
  from near join bt using (item) join dt on dt.doc_id = near.doc_id and dt.pos = near.shift + bt.pos
  where bt.wild = 0 and bt.t in ('<num>', '<unit>') and dt.t = bt.t
    or bt.wild = 1 and exists (select 1 from hits h where h.doc_id = near.doc_id and h.item = near.item and h.shift = near.shift and h.pos between bt.pos - {WINDOW - 1} and bt.pos)
), v as (
  select doc_id, item, shift, max(news) as news, sum(changed) as n_changed from (
    select doc_id, item, shift, kind, old, count(distinct new) as news, sum((new <> old)::int) as changed from slots group by all) group by all
), ok as (select near.doc_id, near.item, coalesce(n_changed, 0) as n_changed from near left join v on v.doc_id = near.doc_id and v.item = near.item and v.shift = near.shift where coalesce(news, 1) = 1),
best as (select doc_id, item_id, min(n_changed) as n_changed from ok join b using (item) group by all),
found as (select doc_id, list_sort(list(distinct item_id)) as item_ids, bool_or(n_changed > 0) as reworded from best group by 1)
select d.doc_id, item_ids is not null as contaminated, coalesce(item_ids, []::bigint[]) as item_ids, coalesce(reworded, false) as reworded
from documents d left join found using (doc_id)
"""

WARC = r"""
with p as (select page_id, url, '"' || md5(coalesce(html, '')) || '"' as tag, strlen(coalesce(html, '')) as n, md5(coalesce(html, '')) as body_md5 from pages),
r as (
  select page_id, page_id * 2 as record_id, url, page_id * 60 as ts, 200 as status, tag as etag, (page_id * 60)::varchar as date, n::varchar as content_length from p
  union all
  select page_id, page_id * 2 + 1, case when page_id % 3 = 0 then regexp_replace(url, '#.*$', '') || '#again' else url end,
    case when page_id % 7 = 0 then page_id * 60 - 30 else page_id * 60 + 86400 * (1 + page_id % 3) end, 304,
    case when page_id % 5 = 0 then '"other"' else 'W/' || tag end,
    (case when page_id % 7 = 0 then page_id * 60 - 30 else page_id * 60 + 86400 * (1 + page_id % 3) end)::varchar, null from p
), u as (select *, regexp_replace(regexp_replace(trim(url), '^(?i:https?)://', ''), '#.*$', '') as bare from r),
h as (select *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^(www|m)\.|:(80|443)$', '', 'g') as host, regexp_extract(bare, '^[^/?]*(.*)$', 1) as rest from u),
c as (select *, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '([?&])&+', '\1', 'g'), '[?&]+$', '', 'g'), '/(index\.html?)?$', '', 'g') as canonical_url from h),
f as (
  select a.*, b.id as src, b.etag as src_etag, b.content_length as src_length from c a left join lateral (
    select record_id as id, etag, content_length from c x where x.status = 200 and x.canonical_url = a.canonical_url and x.ts <= a.ts
    order by x.ts desc, x.record_id desc limit 1) b on a.status = 304
), o as (
  select *, case when status = 200 then 'full' when src is null then 'no_earlier'
    when regexp_replace(etag, '^W/', '') = regexp_replace(src_etag, '^W/', '') then 'resolved' else 'mismatch' end as outcome from f
), z as (select *, case outcome when 'full' then record_id when 'resolved' then src end as refers_to from o)
select z.page_id, record_id, status, canonical_url, refers_to, outcome, p.body_md5,
  case when outcome in ('full', 'resolved') then date end as date,
  case outcome when 'full' then content_length when 'resolved' then src_length end as content_length,
  case when outcome in ('full', 'resolved') then z.etag end as etag,
  case when outcome in ('full', 'resolved') then 5 else 0 end::int as n_headers
from z left join p on p.page_id * 2 = refers_to
"""

SUBSTRINGS = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws from documents),
win as (select doc_id, i, array_to_string(ws[i:i + 49], ' ') as win from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from d)),
least as (select win, min(doc_id) as lo from win group by 1),
hit as (select doc_id, i from win join least using (win) where lo < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as p from hit),
w as (select doc_id, generate_subscripts(ws, 1) as p, unnest(ws) as word from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept from w anti join gone using (doc_id, p) group by 1),
n as (select doc_id, count(*) as n from gone group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join n using (doc_id) left join kept using (doc_id)
"""

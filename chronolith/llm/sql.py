"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP1 = r"""
with cut as (
  select page_id, url, case when url is null or instr(url, '://') = 0 then '' else substr(url, instr(url, '://') + 3) end rest from pages),
parts as (
  select row_number() over () rn, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from cut),
rules(verdict, rule, rh, rp) as (values ('allow','org/','org','/'), ('block','example.org/es/','example.org','/es/'),
  ('block','example.org/en/1','example.org','/en/1'), ('allow','com/fr/','com','/fr/'), ('block','com/de/','com','/de/')),
fit as (
  select p.rn, arg_max({'rule': rule, 'verdict': verdict}, length(rule)) won from parts p join rules
    on (host = rh or suffix(host, '.' || rh)) and starts_with(path, rp) group by p.rn)
select page_id, host, path, won.rule as rule, coalesce(won.verdict, 'allow') as verdict from parts left join fit using (rn)
"""

_CONTROL = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ADDED = " + ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ("\\", *_CONTROL))

OP3 = f"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
seen as (
  select *, lag(role) over w is distinct from role as opens, length(text) + {_ADDED.format('text')} as text_len,
    length(role) + {_ADDED.format('role')} + length(role) - length(replace(role, chr(10), '')) as role_len
  from rows_ window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(text_len + case when opens then role_len + 12 + 1 + 10 + 1 else 10 end)::bigint as formatted_chars
from seen group by conv_id
"""

OP7 = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
    md5(coalesce(doc_id::varchar, 'null') || ':7') as turn from documents),
s as (
  select source, sum(size)::bigint as n, [5, 2, 1][((row_number() over (order by source is null, source) - 1) % 3 + 1)::int] as w from d group by source),
o as (  -- the smaller a source is for its weight, the earlier it is capped
  select *, (sum(n) over ())::bigint - coalesce(sum(3 * n) over before, 0)::bigint as rest, sum(w) over after as open
  from s window before as (order by n / w, source rows between unbounded preceding and 1 preceding),
    after as (order by n / w, source rows between current row and unbounded following)),
c as (select *, rest * w > 3 * n * open as over from o),
last as (select max(rest) as rest, max(open) as open from c where not over),
t as (
  select source, n, case when over then 3.0::double * n else (last.rest * w)::double / last.open::double end as target from c, last),
q as (
  select *, floor(target + 0.5)::bigint as words, greatest((n + 511) // 512, 1) as blocks,
    row_number() over (order by source is null, source) - 1 as source_no from t),
k as (select *, case when n = 0 then 0 else (words // n) * blocks + (words % n + 511) // 512 end as quota from q),
z as (select *, coalesce(sum(quota) over (order by source_no rows between unbounded preceding and 1 preceding), 0) as lo from k),
points as (
  select slot, floor(((slot + 1)::hugeint * 11400714819323198485::hugeint % 18446744073709551616::hugeint // 2048)::double / 9007199254740992
    * (select sum(quota) from z)::double)::bigint as cell from range((select coalesce(sum(quota), 0)::bigint from z)) r(slot)),
ranked as (
  select slot, source_no, quota, row_number() over (partition by source_no order by slot) as rank
  from points join z on cell >= lo and cell < lo + quota),
late as (
  select source_no, unnest(range(got + 1, quota + 1)) as rank
  from (select source_no, any_value(quota)::bigint as quota, (select count(*) from ranked where ranked.source_no = z.source_no) as got from z group by source_no)),
slots as (
  select slot as position, source_no, rank from ranked where rank <= quota
  union all select rank * (select count(*) from z) + source_no + (select sum(quota) from z), source_no, rank from late),
p as (
  select d.doc_id, d.size, z.n as source_size, z.target, z.words, z.source_no,
    sum(d.size) over (partition by d.source order by turn, d.doc_id, d.size rows unbounded preceding) - d.size as pos
  from d join z on d.source is not distinct from z.source),
taken as (
  select *, case when source_size = 0 then 0 else ((words // source_size) * size + greatest(0, least(size, words % source_size - pos)))::bigint end as taken from p)
select doc_id, size::bigint as size, source_size, target, taken, case when taken > 0 then position end::bigint as first_position
from taken left join slots on slots.source_no = taken.source_no and slots.rank = pos // 512 + 1
"""

OP10 = """
with d as (select doc_id, coalesce(text, '') as text, row_number() over (partition by doc_id, text) as turn from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id is not distinct from max(doc_id) over w and turn = 1 as kept, sha256(text) as text_sha256
from d window w as (partition by text)
"""

OP13 = r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
m as (
  select part, good, toxic, (len(words) < 200)::int + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::int
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text))::int + 8 * regexp_matches(text, '[#$%&*|]')::int
    + 16 * coalesce(w.doc_id > first_id, false)::int as mask
  from w left join l on l.doc_id = w.doc_id),
n as (select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from m group by part, mask),
f(letter) as (values ('A'), ('B'), ('C'), ('D'), ('E')),
o as (
  select a.letter || b.letter || c.letter || d.letter || e.letter as filter_order from f a, f b, f c, f d, f e
  where len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
s as (
  select filter_order, step, substr(filter_order, step::int, 1) as letter, (1 << (ascii(substr(filter_order, step::int, 1)) - 65)) as own,
    list_sum([0] || [1 << (ascii(x) - 65) for x in string_split(substr(filter_order, 1, step::int - 1), '') if x <> ''])::int as before
  from o, range(1, 6) r(step)),
c as (
  select part, filter_order, step, letter, sum(n) filter (mask & (before | own) = 0) as kept, sum(n) filter (mask & own > 0 and mask & before = 0) as removed,
    sum(n) filter (mask & own > 0 and mask & before > 0) as redundant, sum(n) filter (mask = own) as unique_fails,
    sum(good) filter (mask & own > 0 and mask & before = 0) as good_lost, sum(toxic) filter (mask & own > 0 and mask & before = 0) as toxic_lost
  from n, s group by part, filter_order, step, letter)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  coalesce(sum(removed) over (partition by part, letter), 0)::bigint as shapley
from c
"""

OP12 = r"""
with d as (
  select row_number() over () as rn, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents),
b as (
  select coalesce(item_id::varchar, '') as item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from benchmark),
w as (
  select distinct item, least(len(words), 10) as k, array_to_string(words[i : i + 9], ' ') as win
  from (select *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from b where len(words) > 0)),
seen as (
  select rn, i as first, k, array_to_string(words[i : i + k - 1], ' ') as win
  from (select rn, words, k, unnest(range(1, len(words) - k + 2)) as i from d, (select distinct k from w))),
hits as (select rn, first, seen.k, item from seen join w on seen.k = w.k and seen.win = w.win),
covered as (select rn, count(distinct word) as n_hit from (select rn, unnest(range(first, first + k)) as word from hits) group by rn),
found as (select rn, count(distinct item) as n_items, array_to_string(list_sort(list_distinct(list(item))), ',') as ids from hits group by rn)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join covered using (rn) left join found using (rn)
"""

ORACLES = {"op1_url_filter": OP1, "op3_chat_format": OP3, "op7_mixing": OP7, "op10_exact_dedup": OP10, "op12_decontamination": OP12, "op13_filter_audit": OP13}

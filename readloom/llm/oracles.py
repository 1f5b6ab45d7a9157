"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

import string

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_WORD = r"'[^\x20\x09-\x0D]+'"

_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"

OP2 = rf"""
with turns as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, t, r, '\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) p(t, r)),
sized as (select *, cast(ceil(length(text) / 4) + 4 as bigint) as n from turns),
lines as (select *, cast(sum(n) over (partition by conv_id order by turn, role, text rows between unbounded preceding and current row) as bigint) as after from sized),
placed as (select *, after - n as before, (after - n) // 1024 as cell, (after - 1) // 1024 > (after - n) // 1024 as across, after = n and role = 'system' as head,
  length('### ' || replace({_ESCAPED.format('role')}, ':', '\:') || ': ' || {_ESCAPED.format('text')}) + 8 as shown from lines),
spans as (select conv_id, cell, across, min(before) as start from placed group by 1, 2, 3),
chars as (select conv_id, shown from placed union all
  select p.conv_id, shown from placed p join spans s on p.conv_id = s.conv_id and ((head and start > 0) or (not head and n <= 256 and after <= start and before + 256 >= start))),
totals as (select conv_id, cast(sum(shown) as bigint) as formatted_chars from chars group by 1)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256, any_value(formatted_chars) as formatted_chars
from turns join totals using (conv_id) group by conv_id
"""

OP3 = f"""
with rules as (select * from (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) r(rhost, rpath, rverdict)),
rest as (select row_number() over () as n, page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_LOWER}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
hits as (select n, rhost || rpath as rule, rverdict, row_number() over (partition by n order by length(rhost || rpath) desc, length(rhost) desc) as place
  from parts, rules where (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(rverdict, 'allow') as verdict from parts p left join (select * from hits where place = 1) h on p.n = h.n
"""

OP6 = f"""
with words as (select doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) as w from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from words where len(w) >= 20)),
again as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as place from windows) where place > 1),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as i from again),
kept as (select x.doc_id, string_agg(word, ' ' order by x.i) as kept, count(*) as n from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from words) x anti join gone g on x.doc_id = g.doc_id and x.i = g.i group by x.doc_id)
select w.doc_id, cast(len(w.w) as bigint) as n_words, cast(len(w.w) - coalesce(k.n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from words w left join kept k on w.doc_id = k.doc_id
"""


def _shingles(table: str, key: str) -> str:
    words = f"select {key}, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_WORD}) as w from {table}"
    return f"select distinct {key}, case when len(w) < 5 then array_to_string(w, ' ') else array_to_string(w[i : i + 4], ' ') end as s, len(w) < 5 as short from (select {key}, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from ({words}) where len(w) > 0)"


OP7 = f"""
with recursive s as ({_shingles('documents', 'doc_id')}), n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.s = b.s and a.short = b.short and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a, b from both_ways union select r.a, l.b from reach r join both_ways l on r.b = l.a),
root as (select a, min(b) as root from reach group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(root, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(root, d.doc_id)) as kept
from documents d left join n on n.doc_id = d.doc_id left join root on root.a = d.doc_id
"""

OP10 = f"""
with s as ({_shingles('documents', 'doc_id')}), t as ({_shingles('benchmark', 'item_id')}), n as (select item_id, count(*) as n_item from t group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n_item) as n_item from s join t using (s, short) join n using (item_id) group by doc_id, item_id having 100 * count(*) >= 75 * any_value(n_item)
"""

ORACLES = {"op2_chat": OP2, "op3_url_filter": OP3, "op6_substring": OP6, "op7_neardup": OP7, "op10_decontamination": OP10}

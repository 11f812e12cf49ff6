"""DuckDB SQL for the queries that SQL can express."""

_SPACE = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
with sized as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_SPACE}')) as bigint) as size, md5('mix-1:' || coalesce(cast(doc_id as varchar), '')) as key from documents),
totals as (select source, cast(sum(size) as bigint) as source_size from sized group by source),
ranked as (select *, row_number() over (order by source is null, encode(source)) as rank from totals),
weighed as (select *, case (rank - 1) % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end as weight, 3.0 * source_size as cap from ranked),
filled as (select *, cap / weight as ratio, (sum(source_size) over ()
  - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
  / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from weighed),
common as (select arg_min(level, (ratio, rank)) as level from filled where ratio >= level),
goal as (select source, source_size, cast(case when c.level is null or ratio < c.level then cap else c.level * weight end as double) as target from filled, common c),
run as (select s.*, g.source_size, g.target, coalesce(sum(size) over (partition by s.source order by key, s.doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from sized s join goal g on s.source is not distinct from g.source),
cut as (select *, cast(round(target) as bigint) as budget, case when source_size > 0 then cast(round(target) as bigint) // source_size else 0 end as epochs from run)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) as bigint) as taken from cut
"""

OP1 = r"""
with item_words as (select row_number() over () as item, * from (select distinct item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from benchmark)),
item_sh as (select distinct item, item_id, least(5, len(w)) as width, unnest(list_transform(range(1, len(w) - least(5, len(w)) + 2), lambda i: array_to_string(list_slice(w, i, i + least(5, len(w)) - 1), ' '))) as s from item_words where len(w) > 0),
sizes as (select item, item_id, width, count(*) as n_item from item_sh group by all),
widths as (select distinct width from item_sh),
doc_words as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') as w from documents),
doc_sh as (select distinct r, doc_id, width, unnest(list_transform(range(1, len(w) - width + 2), lambda i: array_to_string(list_slice(w, i, i + width - 1), ' '))) as s from doc_words, widths where len(w) >= width),
shared as (select r, doc_id, item, width, count(*) as n_common from doc_sh join item_sh using (width, s) group by all)
select distinct doc_id, item_id, cast(n_item as bigint) as n_item, cast(n_common as bigint) as n_common, round(cast(n_common as double) / n_item, 6) as containment
from shared join sizes using (item, width) where cast(n_common as double) / n_item >= 0.8 - 1e-9
"""

OP12 = rf"""
with texts as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
worded as (select *, regexp_extract_all(text, '{_SPACE}') as w, min(doc_id) over (partition by text) as first from texts),
known as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by doc_id),
failing as (select w.part, coalesce(k.good, false) as good, coalesce(k.toxic, false) as toxic,
  (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::int
  + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(w.doc_id > first, false)::int as bits from worded w left join known k on w.doc_id = k.doc_id),
combos as (select part, bits, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from failing group by all),
parts as (select distinct part from combos),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from letters a, letters b, letters c, letters d, letters e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select part, filter_order, step, 1 << (ascii(filter_order[step]) - 65) as own,
  cast(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))) as bigint) as earlier from parts, orders, (select unnest([1, 2, 3, 4, 5]) as step)),
counted as (select s.part, s.filter_order, s.step, s.own,
  cast(coalesce(sum(n) filter (bits & (own | coalesce(earlier, 0)) = 0), 0) as bigint) as kept, cast(coalesce(sum(n) filter (bits & own > 0 and bits & coalesce(earlier, 0) = 0), 0) as bigint) as removed,
  cast(coalesce(sum(n) filter (bits & own > 0 and bits & coalesce(earlier, 0) > 0), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (bits = own), 0) as bigint) as unique_fails,
  cast(coalesce(sum(good) filter (bits & own > 0 and bits & coalesce(earlier, 0) = 0), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (bits & own > 0 and bits & coalesce(earlier, 0) = 0), 0) as bigint) as toxic_lost
  from steps s join combos c on s.part = c.part group by all)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, own) as bigint) as shapley from counted
"""

OP13 = """
with turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
convs as (select conv_id, count(*) as n, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::bigint)),
  lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda t, i: xor(t >> 1, (t & 1) * 3988292384))), 4294967295) % 9 as h from turns group by conv_id),
planned as (select c.*, least(c.h, coalesce(b.n, 0)) as kept from convs c left join convs b on b.conv_id = c.base),
rebuilt as (select p.conv_id as c, t.pos as d, role, text from planned p join turns t on t.conv_id = p.base and t.pos <= p.h
  union all select p.conv_id, kept + t.pos - h, role, text from planned p join turns t on t.conv_id = p.conv_id and t.pos > p.h),
keyed as (select c, d, strlen(text) as bytes, md5(string_agg(md5(strlen(role) || ':' || role || text), '') over (partition by c order by d)) as k from rebuilt),
lengths as (select conv_id as c, coalesce(max(d), 0) as len from planned left join rebuilt on c = conv_id group by conv_id),
prefixes as (select c, 0 as d, 0 as bytes, '' as k, len from lengths union all select c, d, bytes, k, len from keyed join lengths using (c)),
parents as (select *, lag(k) over (partition by c order by d) as pk from prefixes),
nodes as (select d, k, any_value(pk) as pk, min(c) as conv_id, count(*) as n_convs, any_value(bytes) * (count(*) - 1) as saved, (max(len) = d)::int as leaf,
  coalesce(string_agg(cast(c as varchar), ',' order by c) filter (d = len), '') as ends from parents group by d, k),
children as (select d - 1 as d, pk as k, count(*) as n_children from nodes where d > 0 group by all),
below as (select p.d, p.k, sum(n.saved) as saved_tokens, sum(n.leaf) as n_leaves from nodes n join prefixes p on p.c = n.conv_id and p.d <= n.d group by all)
select n.conv_id, cast(n.d as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n_children, 0) as n_children, cast(b.n_leaves as bigint) as n_leaves, cast(b.saved_tokens as bigint) as saved_tokens, sha256(n.ends) as ends_sha256
from nodes n join below b on n.d = b.d and n.k = b.k left join children c on c.d = n.d and c.k = n.k left join nodes p on p.d = n.d - 1 and p.k = n.pk
"""

ORACLES = {"op1_decontaminate": OP1, "op5_mixing": OP5, "op12_filter_audit": OP12, "op13_prefix_trie": OP13}

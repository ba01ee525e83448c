"""SQL for the training-data queries where SQL can express them; the others are tested against brute force."""

from weirmill.llm.queries import FIELDS
from weirmill.plans.sql import URLS, category, host

_REGISTRABLE = """
h as (select distinct host from u where host is not null),
p as (select host, string_split(host, '.') as l from h),
s as (select host, l, k, array_to_string(l[len(l) - k + 1:], '.') as suffix from (select host, l, unnest(range(1, len(l) + 1)) as k from p)),
m as (select s.host, any_value(l) as l, max(case when kind = 'rule' then k when kind = 'wildcard' and len(l) > k then k + 1 end) as n,
  max(case when kind = 'exception' then k end) as e from s join psl on s.suffix = psl.suffix group by s.host),
r as (select host, case when e is not null then array_to_string(l[len(l) - e + 1:], '.')
  when n < len(l) then array_to_string(l[len(l) - n:], '.') end as registrable from m)"""

_FOUND4 = " union all ".join(f"select '{f}' as field_name, {f} as field_value, count(*) as occurrences, count(distinct record_id) as records from u where {f} is not null group by {f}" for f in FIELDS)
_MARKS = f"""with {URLS}, c as ({_FOUND4}), n as (select count(distinct record_id) as total from u)
select field_name, field_value, occurrences, records, case when records < total / 500 then 'rare' when records > total / 2 then 'common' end as mark from c, n"""

_LAST4 = " union all ".join(f"select '{f}' as field_name, {f} as field_value, count(*) as occurrences, count(*) as records from l where {f} is not null group by {f}" for f in FIELDS)
_CHANGED = f"""with {URLS}, o as (select *, row_number() over (partition by record_id order by ingested_at desc nulls last, source desc nulls last, scenario desc nulls last, tier desc nulls last, label desc nulls last, host desc nulls last) as r from u where record_id is not null),
l as (select * from o where r = 1 and host is not null), c as ({_LAST4}), n as (select count(*) as total from l)
select field_name, field_value, occurrences, records, case when records < total / 500 then 'rare' when records > total / 2 then 'common' end as mark from c, n"""

_HOSTS2 = """a as (select distinct record_id, host from u where split = 'train' and host is not null),
b as (select distinct record_id, host from u where split in ('val', 'test') and host is not null),
ha as (select distinct host from a), hb as (select distinct host from b),
ka as (select host, unnest(list_append(list_transform(range(1, length(host) + 1), lambda i: host[:i - 1] || host[i + 1:]), host)) as k from ha),
kb as (select host, unnest(list_append(list_transform(range(1, length(host) + 1), lambda i: host[:i - 1] || host[i + 1:]), host)) as k from hb),
hosts as (select distinct ka.host as x, kb.host as y from ka join kb using (k) where levenshtein(ka.host, kb.host) <= 1)"""

_LINKED = f"""with recursive u as (select doc_id, {host('domain')} as host, case when length(text) > 0 then md5(text) end as t from documents), {_REGISTRABLE},
e as (select doc_id, 'd' || registrable as e from u join r on u.host = r.host where registrable is not null union select doc_id, 't' || t from u where t is not null),
near as (select distinct a.doc_id as x, b.doc_id as y from e a join (select e, min(doc_id) as doc_id from e group by e) b using (e)),
links as (select x, y from near union select y, x from near union select doc_id, doc_id from u),
reach as (select x, y from links union select reach.x, links.y from reach join links on reach.y = links.x),
g as (select x as doc_id, min(y) as group_id from reach group by x) select doc_id, group_id, count(*) over (partition by group_id) as size from g"""

ORACLES = {
    "p1_linked": _LINKED,
    "p1_found": f"with {URLS}, {_REGISTRABLE} select registrable as entity from u join r on u.host = r.host where registrable is not null group by registrable having count(distinct split) > 1",
    "p2_found": f"""with {URLS}, {_HOSTS2}
select distinct least(a.record_id, b.record_id) as record_id_a, greatest(a.record_id, b.record_id) as record_id_b
from hosts join a on a.host = x join b on b.host = y where a.record_id <> b.record_id""",
    "p2_host_pairs": f"""with {URLS}, {_HOSTS2}
select x as host_a, y as host_b, x <> y as near, (select count(*) from a where host = x and record_id is not null) as train_records, (select count(*) from b where host = y and record_id is not null) as eval_records from hosts""",
    "p2_report": f"""with {URLS}, {_HOSTS2}, k as (select y, max(x = y) as same from hosts group by y),
r as (select record_id, split, source, coalesce(max(same), false) as same, max(y is not null) as hit from u left join k on host = y where split in ('val', 'test') and record_id is not null group by all)
select split, source, count(*) as records, count(*) filter (same) as same_records, count(*) filter (hit) as overlapping_records from r group by all""",
    "p3_found": f"""with {URLS},
units as (select distinct 'url_audit' as f, record_id as id, label || '|' || scenario as c from u union all select 'pilot_profile', row_idx, {category('lang')} from pilot_profile),
t as (select f, count(distinct id) as total from units group by f), n as (select f, c, count(distinct id) as n from units group by f, c)
select draw_from, category from sample_target join t on draw_from = t.f left join n on n.f = draw_from and n.c = category
where coalesce(n, 0) < min_rows or coalesce(n, 0) * 1000000 < share_bp * draw_pct * total""",
    "p3_report": f"""with {URLS},
units as (select distinct 'url_audit' as f, record_id as id, label || '|' || scenario as c from u where record_id is not null union all select 'pilot_profile', row_idx, {category('lang')} from pilot_profile),
one as (select f, id, min(c) as c from units group by f, id), t as (select f, count(*) as total from one group by f), n as (select f, c, count(*) as n from one group by f, c),
r as (select draw_from, category, coalesce(n, 0) as available, greatest(cast(ceil(share_bp * draw_pct * total / 1000000) as bigint), min_rows) as wanted, coalesce(n, 0) < min_rows or coalesce(n, 0) * 1000000 < share_bp * draw_pct * total as short
  from sample_target join t on draw_from = t.f left join n on n.f = draw_from and n.c = category)
select draw_from, category, available, wanted, least(available, wanted) as drawn, least(available, wanted) - wanted as residual, short from r""",
    "p4_found": f"select field_name, field_value from ({_MARKS}) where mark is not null",
    "p4_counts": _MARKS,
    "p4_changed": _CHANGED,
    "p4_terms": """with w as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}]+'), lambda x: x <> '')) as word from documents), n as (select count(distinct doc_id) as total from documents),
c as (select word, count(*) as occurrences, count(distinct doc_id) as documents from w group by word) select word, occurrences, documents, case when documents < 3 then 'rare' when documents > total / 2 then 'common' end as mark from c, n""",
    "p5_distinct_hosts": f"""with {URLS}
select concat_ws('+', case when grouping(day) = 0 then 'day' end, case when grouping(source) = 0 then 'source' end, case when grouping(scenario) = 0 then 'scenario' end) as "grouping",
  day, source, scenario, count(distinct host) as distinct_count, 0 as error_bound
from u where host is not null group by cube (day, source, scenario)""",
    "p5_common": f"with {URLS}, h as (select distinct source, host from u where source is not null and host is not null) select a.source as source_a, b.source as source_b, count(*) as common_count from h a join h b on a.host = b.host and a.source < b.source group by all",
    "p8_found": f"""with d as (select distinct doc_id, {category('source')} as s, case when text is null then 0 else len(list_filter(regexp_split_to_array(text, '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200b}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x{{2060}}\\x{{feff}}\\x{{180e}}]+'), lambda x: x <> '')) end as n from documents),
m as (select source, share_bp, max_repeat, coalesce(sum(n), 0) as own from mix_target left join d on s = source group by all), t as (select sum(own) as total from m)
select source from m, t where share_bp * total > 10000 * max_repeat * own""",
}

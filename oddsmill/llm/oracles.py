"""DuckDB SQL for those of the queries op1 to op13 that SQL can express."""

OP1 = r"""
with d as (
  select doc_id, coalesce(source, chr(1114109)) as s,
         cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
         cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 15) as bigint) as spot
  from documents),
src as (
  select s, sum(size) as source_size, cast((row_number() over (order by s) - 1) % 3 as int) as r from d group by s),
w as (select *, case r when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight, 2.0::double * source_size as cap from src),
o as (
  select *, 1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, s rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, s rows between unbounded preceding and 1 preceding), 0) as open_weight
  from w),
l as (select min_by(rest / open_weight, row(cap / weight, s)) as level from o where rest / open_weight * weight <= cap),
t as (
  select s, r, weight, cast(source_size as bigint) as source_size,
         case when level is null then cap else least(cap, weight * level) end as target
  from w left join l on true),
p as (
  select d.*, cast(coalesce(sum(size) over (partition by s order by spot, doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) as start from d),
k as (
  select doc_id, size, source_size, target, weight, r, start,
         case when size > 0 then greatest(0, least(size, cast(floor(target) as bigint) - start)) + greatest(0, least(size, cast(floor(target) as bigint) - start - source_size)) else 0 end as taken,
         start / target * weight as q
  from p join t using (s)),
m as (
  select *, case r when 0 then 1.5::double * weight when 1 then weight when 2 then 0.5::double * weight end as w0,
         case r when 0 then -1.0::double * weight when 1 then 0.0::double else 1.0::double * weight end as slope from k)
select doc_id, cast(size as bigint) as size, source_size, target, cast(taken as bigint) as taken,
       case when taken > 0 then round_even(2 * q / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * q, 0))), 6) end as first_position
from m
"""

OP8 = """
with d as (select doc_id, coalesce(text, '') as t from documents)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from d
"""

OP9 = """
with p as (select page_id, coalesce(html, '') as h from pages),
s as (select page_id, cast(octet_length(encode(h)) as bigint) as payload_bytes, sha1(h) as x, max(page_id) over (partition by h) as keep from p)
select page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         cast(((cast('0x' || substr(x, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) + 1 as int), 1)), '') as payload_digest,
       case when page_id = keep then 'response' else 'revisit' end as record_type,
       case when page_id <> keep then keep end as refers_to
from s
"""

ORACLES = {"op1_mix_sources": OP1, "op8_exact_dedup": OP8, "op9_warc": OP9}

# The rules' matches, with what lies between them; a span starts after all earlier gaps and matches.
_SPANS = """
select doc_id, {rank} as rank, '{kind}' as kind, v, m, i,
       coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as s
from (select doc_id, unnest(regexp_extract_all(t, '{p}', {group})) as v, unnest(ms) as m, unnest(range(1, len(ms) + 1)) as i, g, ms
      from (select doc_id, t, string_split_regex(t, '{p}') as g, regexp_extract_all(t, '{p}') as ms from d))
where length(v) >= {least}
"""
_P = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
)
OP6 = (
    "with d as (select doc_id, coalesce(text, '') as t from documents), f as ("
    + " union all ".join(_SPANS.replace("{rank}", str(r)).replace("{kind}", k).replace("{p}", p).replace("{group}", str(g)).replace("{least}", str(n)) for r, (k, p, g, n) in enumerate(_P))
    + """),
x as (select doc_id, rank, kind, s, kind || ':' || s || ':' || (s + length(m)) as word from f)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
       sha256(coalesce(string_agg(word, ',' order by s, rank) filter (rank < 3), '')) as base_sha256,
       coalesce(string_agg(word, ',' order by s, rank), '') as spans
from d left join x using (doc_id) group by d.doc_id
"""
)
ORACLES["op6_secret_scan"] = OP6

# Orders are counted one by one; the operator derives them from joint failures.
ORACLES["op11_filter_audit"] = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words from d),
l as (select doc_id, bool_or(coalesce(quality = 1, false)) as good, bool_or(coalesce(toxic = 1, false)) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         case when len(words) < 200 then 1 else 0 end
         + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
         + case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) then 4 else 0 end
         + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
         + case when w.doc_id > min(w.doc_id) over (partition by t) then 16 else 0 end as mask
  from w left join l using (doc_id)),
cells as (select part, mask, good, toxic, count(*) as n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as f),
orders as (
  select a.f || b.f || c.f || d.f || e.f as filter_order from x a, x b, x c, x d, x e
  where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps as (
  select filter_order, k as step, substr(filter_order, k, 1) as letter, 1 << (ascii(substr(filter_order, k, 1)) - 65) as bit,
         coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::int as before
  from orders, (select unnest(range(1, 6))::int as k)),
r as (
  select part, filter_order, step, letter,
         coalesce(sum(n) filter (mask & (before | bit) = 0), 0) as kept,
         coalesce(sum(n) filter (mask & before = 0 and mask & bit <> 0), 0) as removed,
         coalesce(sum(n) filter (mask & before <> 0 and mask & bit <> 0), 0) as redundant,
         coalesce(sum(n) filter (mask = bit), 0) as unique_fails,
         coalesce(sum(n) filter (mask & before = 0 and mask & bit <> 0 and good), 0) as good_lost,
         coalesce(sum(n) filter (mask & before = 0 and mask & bit <> 0 and toxic), 0) as toxic_lost
  from cells, steps group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley
from r
"""


def _spread_rounds(n: int) -> str:
    """The rounds of trust and distrust, one relation each."""
    one = """
m{k} as materialized (
  select kind, host, sum(part) as mass from (
    select w.kind, w.to_ as host, 0.85::double * m.mass * w.share as part from m{b} m join ways w on w.kind = m.kind and w.from_ = m.host
    union all
    select s.kind, s.host, s.seed * (0.15::double + 0.85::double * coalesce(z.loose, 0)) from seeds s
    left join (select kind, sum(mass) as loose from m{b} m where not exists (select 1 from ways w where w.kind = m.kind and w.from_ = m.host) group by kind) z on z.kind = s.kind)
  group by kind, host)"""
    return ",".join(one.format(k=k, b=k - 1) for k in range(1, n + 1))


ORACLES["op12_url_filter"] = (
    r"""
with p as (
  select *, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
f as (
  select page_id, host, path, html,
         case when (host = 'www.example.com' or host like '%.www.example.com') and starts_with(path, '/en/') then 'www.example.com/en/'
              when (host = 'example.com' or host like '%.example.com') and starts_with(path, '/en/') then 'example.com/en/'
              when (host = 'net' or host like '%.net') and starts_with(path, '/es/') then 'net/es/'
              when (host = 'net' or host like '%.net') and starts_with(path, '/fr/') then 'net/fr/'
              when (host = 'com' or host like '%.com') and starts_with(path, '/') then 'com/' end as rule from p),
r as (select *, case when rule in ('com/', 'www.example.com/en/') then 'allow' when rule is not null then 'block' end as verdict from f),
hosts as (select host, count(*) as pages, count(*) filter (verdict = 'allow') as allowed, count(*) filter (verdict = 'block') as blocked from r where host <> '' group by host),
links as (
  select source, translate(target, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as target from (
    select host as source, unnest(regexp_extract_all(coalesce(html, ''), '(?i)(?:href|src)\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1)) as target from r)),
edges as (select source, target, count(*)::double as n from links where source <> '' and source <> target group by all),
ways as materialized (
  select 'trust' as kind, source as from_, target as to_, n / sum(n) over (partition by source) as share from edges
  union all select 'distrust', target, source, n / sum(n) over (partition by target) from edges),
seeds as materialized (
  select 'trust' as kind, host, allowed / (sum(allowed) over ())::double as seed from hosts where allowed > 0
  union all select 'distrust', host, blocked / (sum(blocked) over ())::double from hosts where blocked > 0),
m0 as (select kind, host, seed as mass from seeds),"""
    + _spread_rounds(20)
    + """,
scores as (
  select h.host, coalesce(t.mass, 0) * (select sum(allowed) from hosts) / pages as trust, coalesce(x.mass, 0) * (select sum(blocked) from hosts) / pages as distrust
  from hosts h left join m20 t on t.kind = 'trust' and t.host = h.host left join m20 x on x.kind = 'distrust' and x.host = h.host)
select page_id, host, path, rule,
       coalesce(verdict, case when round_even(distrust, 9) >= 0.5 and round_even(distrust, 9) > round_even(trust, 9) then 'block' else 'allow' end) as verdict
from r left join scores using (host)
"""
)

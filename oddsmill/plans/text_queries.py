"""Matching of texts, headlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.columns import rounded as r
from ..functions.columns import table
from ..functions.scratch import cut
from ..operators import arbitrage, matching
from .registry import query

_STOP = "[" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + "]"


def _tokens(c: str) -> str:
    return f"list_filter(string_split_regex(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 and not list_contains({_STOP}, w))"


def _hits(words) -> str:
    return " + ".join(f"contains(h, '{w}')::int" for w in words)


def _any(words) -> str:
    return "(" + " or ".join(f"contains(h, '{w}')" for w in words) + ")"


_CATEGORY = "case " + " ".join(f"when {_any(ws)} then '{k}'" for k, ws in reversed(text.HEADLINE_CLASSES.items())) + " else 'OTHER' end"
_ALL = [w for ws in text.HEADLINE_CLASSES.values() for w in ws]
HEADLINES = f"""with h0 as (select doc_id, lower(text) as h from documents),
hs as (select doc_id, least(100, 25 * ({_hits(_ALL)}) + case when {_any(text.URGENT)} then 20 else 0 end) as impact, {_CATEGORY} as category,
  case when {_any(text.URGENT)} then 'HIGH' else 'LOW' end as urgency, case when {_any(text.POSITIVE)} then 'POSITIVE' when {_any(text.NEGATIVE)} then 'NEGATIVE' else 'NEUTRAL' end as sentiment from h0)
"""


def _headlines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", *[c.alias(n) for n, c in text.headline(F.col("text")).items()])


@query("normalize_text", f"select item_id, array_to_string({_tokens('text')}, ' ') as words from benchmark")
def normalize_text(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", text.normalised(F.col("text")).alias("words"))


@query("jaccard", f"""with b as (select item_id, list_distinct({_tokens('text')}) as w from benchmark)
select a.item_id as a, b.item_id as b, round_even(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 6) as similarity from b a join b on b.item_id = a.item_id + 1""")
def jaccard(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.array_distinct(text.tokens(F.col("text"))).alias("w"))
    n = b.select((F.col("item_id") - 1).alias("i"), F.col("item_id").alias("b"), F.col("w").alias("v"))
    return b.join(n, F.col("item_id") == F.col("i")).select(F.col("item_id").alias("a"), "b", r(text.jaccard(F.col("w"), F.col("v"))).alias("similarity"))


def _sides(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")


_E = [f"{c}:{k}" for c, ks in text.ENTITIES.items() for k in ks]


def _found(c: str) -> str:
    return "list_sort(list_filter([" + ", ".join(f"case when contains(lower({c}), '{e.split(':')[1]}') then '{e}' end" for e in _E) + "], lambda x: x is not null))"


def _conflict_sql(x: str, y: str) -> str:
    name = {e.split(":")[1]: e for e in _E}
    lists = lambda side: "[" + ", ".join(f"'{name[w]}'" for w in side) + "]"
    return " or ".join(f"(list_has_any({x}, {lists(p)}) and list_has_any({y}, {lists(q)})) or (list_has_any({x}, {lists(q)}) and list_has_any({y}, {lists(p)}))" for p, q in text.CONFLICTS)


# Pairs above the floor with their entities; a match is valid without conflict and, if weak, with two entities in common.
PAIRS = f"""with l as (select item_id as id, list_distinct({_tokens('text')}) as w, {_found('text')} as e from benchmark), d as (select doc_id as id, list_distinct({_tokens('text')}) as w, {_found('text')} as e from documents),
p as (select l.id as l_id, d.id as r_id, l.e as x, d.e as y, len(list_intersect(l.w, d.w)) as i, len(l.w) + len(d.w) as s from l, d where len(l.w) > 0 and len(d.w) > 0),
q as (select *, i / (s - i) as sim, len(list_intersect(x, y)) as shared from p where i / (s - i) > 0.1),
v as (select *, not ({_conflict_sql('x', 'y')}) and not (sim < 0.5 and shared < 2) as valid from q)
"""
BEST = PAIRS + ", b as (select *, row_number() over (partition by l_id order by sim desc, r_id) as rn from v where valid) select l_id, r_id, round_even(sim, 6) as similarity from b where rn = 1"
JUDGED = PAIRS + "select l_id, r_id, round_even(sim, 6) as similarity, array_to_string(x, ',') as entities, shared, valid from v"


@query("event_match", BEST)
def event_match(spark, sf):
    """The most similar document of each item among those that pass entity validation at their own similarity."""
    b, d = _sides(spark, sf)
    return matching.best_valid_matches(b, d, 0.1).select("l_id", "r_id", r(F.col("similarity")).alias("similarity"))


@query("entity_match", JUDGED)
def entity_match(spark, sf):
    """Entity validation of all candidate pairs at their own similarity."""
    b, d = _sides(spark, sf)
    e = matching.with_entities(cut(matching.similar_pairs(b, d, 0.1), "similar-pairs"), b, d)
    return e.select("l_id", "r_id", r(F.col("similarity")).alias("similarity"), F.array_join("l_entities", ",").alias("entities"), F.size(F.array_intersect("l_entities", "r_entities")).cast("long").alias("shared"), "valid")


_MATCHED = f"""with l as (select item_id as id, list_distinct({_tokens('text')}) as w, {_found('text')} as e, length(text) % 97 / 97.0 as price from benchmark),
d as (select 'b' as venue, doc_id as id, list_distinct({_tokens('text')}) as w, {_found('text')} as e, n_chars % 89 / 89.0 as price from documents
  union all select 'c', conv_id * 1000 + turn, list_distinct({_tokens('text')}), {_found('text')}, length(text) % 83 / 83.0 from conversations),
p as (select l.id as l_id, venue, d.id as r_id, d.price, l.e as x, d.e as y, len(list_intersect(l.w, d.w)) as i, len(l.w) + len(d.w) as s from l, d where len(l.w) > 0 and len(d.w) > 0),
q as (select *, i / (s - i) as sim, len(list_intersect(x, y)) as shared from p where i / (s - i) > 0.1),
v as (select * from q where not ({_conflict_sql('x', 'y')}) and not (sim < 0.5 and shared < 2)),
b as (select * from v qualify row_number() over (partition by l_id, venue order by sim desc, r_id) = 1),
m as (select l_id, max(sim) as similarity, max(r_id) filter (venue = 'b') as b_id, max(r_id) filter (venue = 'c') as c_id, max(price) filter (venue = 'b') as b_price, max(price) filter (venue = 'c') as c_price from b group by l_id),
g as (select m.*, l.price, round_even(greatest(l.price, b_price, c_price) - least(l.price, b_price, c_price), 6) as gap from m join l on l.id = l_id)
select l_id as item_id, b_id, c_id, round_even(similarity, 6) as similarity, gap, case when price = least(price, b_price, c_price) then 'a' when b_price = least(price, b_price, c_price) then 'b' else 'c' end as low_platform,
  case when price = greatest(price, b_price, c_price) then 'a' when b_price = greatest(price, b_price, c_price) then 'b' else 'c' end as high_platform
from g where gap >= 0.03 order by gap desc, item_id"""


@query("venue_assembly", _MATCHED)
def venue_assembly(spark, sf):
    """Events that several venues list: the best valid match of each item at two venues, and price gaps among all three, greatest first."""
    price = lambda c, n: (c % n / float(n)).alias("price")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text", price(F.length("text"), 97))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", price(F.col("n_chars"), 89))
    talks = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", price(F.length("text"), 83))
    found = matching.assembled(items, {"b": docs, "c": talks}, "a", 0.1)
    out = arbitrage.gaps(found, 0.03).select(F.col("id").alias("item_id"), F.try_element_at("matches", F.lit("b")).alias("b_id"), F.try_element_at("matches", F.lit("c")).alias("c_id"), r(F.col("similarity")).alias("similarity"), "gap", "low_platform", "high_platform")
    return out.orderBy(F.desc("gap"), "item_id")


# The names under which the same results were asked for when the two above ranked without validation and compared neighbours.
query("event_match_valid", BEST)(event_match)
query("entity_match_pairs", JUDGED)(entity_match)


@query("headline_score", HEADLINES + "select * from hs")
def headline_score(spark, sf):
    return _headlines(spark, sf)


@query("news_scan", HEADLINES + "select * from hs where impact > 30")
def news_scan(spark, sf):
    return _headlines(spark, sf).where("impact > 30").orderBy(F.desc("impact"), "doc_id")


_MOVES = "case category " + " ".join(f"when '{k}' then '{v}'" for k, v in text.MARKETS.items()) + " else '' end"
_ACT = """case when urgency = 'HIGH' and category = 'BITCOIN' and sentiment = 'POSITIVE' then 'watch bitcoin upside markets' when urgency = 'HIGH' and category = 'BITCOIN' and sentiment = 'NEGATIVE' then 'watch bitcoin downside markets'
when urgency = 'HIGH' and category = 'ELECTION' then 'watch election markets, sharp moves possible' when urgency = 'HIGH' and category = 'FED' then 'watch rate markets, major policy effect' when category in ('BITCOIN', 'ETHEREUM') then 'monitor crypto volatility'
when category = 'ELECTION' then 'follow political markets' when category = 'FED' then 'follow macro markets' else 'keep monitoring' end"""


@query("news_signals", HEADLINES + f"select doc_id, category, case sentiment when 'POSITIVE' then 'UP' else 'DOWN' end as direction, impact / 100 as confidence, case urgency when 'HIGH' then 'IMMEDIATE' else '24H' end as timeframe, {_MOVES} as markets, {_ACT} as action from hs where impact >= 50")
def news_signals(spark, sf):
    c = F.col
    return _headlines(spark, sf).where("impact >= 50").select("doc_id", "category", F.when(c("sentiment") == "POSITIVE", "UP").otherwise("DOWN").alias("direction"), (c("impact") / 100).alias("confidence"), F.when(c("urgency") == "HIGH", "IMMEDIATE").otherwise("24H").alias("timeframe"), text.suggested_markets(c("category")).alias("markets"), text.suggested_action(c("category"), c("sentiment"), c("urgency")).alias("action"))

"""Registration of queries with the SQL that they are held against, and SQL forms of the domain relations."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

# The domain relations in SQL, put before a query's own text when it names them.
RELATIONS = {
    "trade": "trade as (select event_id, user_id, 'w' || user_id as wallet, event_type as market, value as volume, ts, props from events)",
    "quote": "quote as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as market_id, 1 - cast(l_discount as decimal(18,6)) as yes, cast(l_tax as decimal(18,6)) as no, l_extendedprice as liquidity, l_quantity * 1000 as volume, l_shipdate as end_date from lineitem)",
    "book": """bk0 as (select l_suppkey as market, l_extendedprice / l_quantity / 2500 as price, l_quantity as size,
      row_number() over (partition by l_suppkey order by l_extendedprice / l_quantity / 2500, l_orderkey, l_linenumber, l_partkey, l_quantity) as rn,
      count(*) over (partition by l_suppkey) // 2 as half from lineitem),
    book as (select market, case when rn <= half then 'bid' else 'ask' end as side, case when rn <= half then half - rn else rn - half - 1 end as level, price, size from bk0)""",
    "top": """top0 as (select market, max(price) filter (side = 'bid' and level = 0) as best_bid, max(price) filter (side = 'ask' and level = 0) as best_ask,
      coalesce(sum(size) filter (side = 'bid' and level < 5), 0) as bid_depth, coalesce(sum(size) filter (side = 'ask' and level < 5), 0) as ask_depth,
      coalesce(sum(size * price) filter (side = 'bid' and level < 5), 0) as bid_money, coalesce(sum(size * price) filter (side = 'ask' and level < 5), 0) as ask_money from book group by market),
    top as (select *, best_ask - best_bid as spread, (best_ask + best_bid) / 2 as mid, (best_ask - best_bid) / ((best_ask + best_bid) / 2) as spread_pct, least(bid_depth, ask_depth) as min_depth, least(bid_money, ask_money) as min_money
      from top0 where best_bid is not null and best_ask is not null)""",
    "series": "series as (select user_id as market, row_number() over (partition by user_id order by ts, event_id) as seq, value / 500 as price, ts from events)",
    "holding": "holding as (select wallet, user_id, market, date_trunc('week', ts) as week, sum(volume) as value from trade group by all)",
    "conc": """conc as (select wallet, round_even(sum(value * value) / (sum(value) * sum(value)), 6) as hhi, round_even(sum(value) filter (rn <= 5) / sum(value), 6) as top5,
      round_even(sum(value) filter (rn <= 10) / sum(value), 6) as top10, count(*) as positions
      from (select *, row_number() over (partition by wallet order by value desc, market, week) as rn from holding) group by wallet)""",
    "snap": """before_ as (select wallet, market, round_even(sum(volume), 2) as size from trade where ts >= '2024-01-01' and ts < '2024-01-08' group by all),
    now_ as (select wallet, market, round_even(sum(volume), 2) as size from trade where ts >= '2024-01-08' and ts < '2024-01-15' group by all)""",
    "whale": """whale as (select t.wallet, t.user_id, round_even(sum(volume) * any_value([1, 3, 10, 25, 60, 120][t.user_id % 6 + 1]), 2) as value,
      round_even(sum(case market when 'purchase' then volume when 'error' then -volume else 0 end) * any_value([1, 3, 10, 25, 60, 120][t.user_id % 6 + 1]), 2) as pnl,
      count(*) as positions, count(*) filter (ts >= timestamp '2024-01-30') as changes,
      round_even(least(1.0, any_value(c.top5) * (1 + (t.user_id % 4) * 0.25::double)), 6) as top5,
      round_even((count(*) filter (market = 'purchase'))::double / count(*) * 3, 4) as win_rate, round_even(sum(volume), 2) as volume
      from trade t join conc c on c.wallet = t.wallet group by t.wallet, t.user_id)""",
    "report": """report as (select date_trunc('hour', ts) as scan_time, count(*) filter (market = 'purchase') as pair_count, count(*) filter (market = 'signup') as cross_count,
      count(*) filter (market = 'error') as mm_count, count(*) filter (market = 'click') as whale_count, count(*) filter (market = 'view') as news_count from trade group by 1)""",
}
NEEDS = {"top": ["book"], "holding": ["trade"], "conc": ["trade", "holding"], "snap": ["trade"], "whale": ["trade", "holding", "conc"], "report": ["trade"]}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Registers a function (spark, sf_dir) under a name; uses names the relations its SQL reads."""

    def register(function):
        QUERIES[name] = function
        if sql:
            wanted = list(dict.fromkeys(x for u in uses.split() for x in [*NEEDS.get(u, []), u]))
            head = ",\n".join(RELATIONS[x] for x in wanted)
            body = sql.strip()
            ORACLES[name] = body if not head else f"with {head}{', ' + body[5:] if body.startswith('with ') else chr(10) + body}"
        return function

    return register

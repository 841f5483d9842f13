"""Alerts, reports, logs and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import AS_OF
from ..functions.columns import epoch_us, summed
from ..operators import alerts as ops
from ..sources.market_tables import reports, trades
from .registry import query

c = F.col

def now():
    return F.lit(AS_OF).cast("timestamp")


def _alerts(spark, sf):
    return trades(spark, sf).select(c("event_id").alias("id"), "wallet", c("market").alias("type"), "ts", epoch_us(c("ts")).alias("ts_us"), (c("event_id") % 2 == 0).alias("is_read"))


def _kept_sql(keys: str, gap_s: int) -> str:
    on = " and ".join(f"n.{k} = k.{k}" for k in keys.split(", "))
    return f"""with recursive a as (select event_id as id, {keys.replace('type', 'market as type')}, epoch_us(ts) as ts_us from trade),
first_ as (select {keys}, min((ts_us, id)) as x from a group by all),
kept as (select {keys}, x from first_ union all
  select {', '.join('k.' + k for k in keys.split(', '))}, (select min((n.ts_us, n.id)) from a n where {on} and n.ts_us >= k.x[1] + {gap_s * 1_000_000}) as x from kept k where k.x is not null)
select {keys}, x[1] as ts_us, x[2] as id from kept where x is not null"""


def _fold_query(name: str, keys: list[str], gap_s: int):
    sql = _kept_sql(", ".join(keys), gap_s)
    body = "with recursive trade as (select event_id, 'w' || user_id as wallet, event_type as market, ts from events),\n" + sql[len("with recursive ") :]

    @query(name, body)
    def run(spark, sf):
        return ops.kept_with_gap(_alerts(spark, sf), keys, gap_s)


_fold_query("alert_cooldown", ["wallet"], 6 * 3600)
_fold_query("alert_suppress", ["wallet", "type"], 3600)


@query("alert_dedup", "select id, wallet, type from (select event_id as id, wallet, market as type, row_number() over (partition by wallet, market, date_trunc('minute', ts) order by ts, event_id) as rn from trade) where rn = 1", "trade")
def alert_dedup(spark, sf):
    return ops.earliest_per_minute(_alerts(spark, sf)).select("id", "wallet", "type")


@query("alert_dups", "select wallet, type, epoch_us(h) as hour, n from (select wallet, market as type, date_trunc('hour', ts) as h, count(*) as n from trade group by all) where n > 1", "trade")
def alert_dups(spark, sf):
    g = _alerts(spark, sf).groupBy("wallet", "type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("n"))
    return g.where("n > 1").select("wallet", "type", epoch_us(c("h")).alias("hour"), "n")


@query("alert_sync", "select event_id as id, wallet, market as type, cast(json_extract_string(props, '$.k') as bigint) as k from trade t where event_id % 3 = 0 and not exists (select 1 from trade x where x.event_id % 3 <> 0 and x.wallet = t.wallet and x.market = t.market and date_trunc('minute', x.ts) = date_trunc('minute', t.ts))", "trade")
def alert_sync(spark, sf):
    a = trades(spark, sf).select(c("event_id").alias("id"), "wallet", c("market").alias("type"), "ts", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return ops.not_yet_known(a.where("id % 3 = 0"), a.where("id % 3 <> 0")).select("id", "wallet", "type", "k")


@query("alert_list", "select event_id as id, wallet, market as type, event_id % 2 = 0 as is_read from trade where market = 'purchase' and event_id % 2 = 1 order by ts desc, event_id desc limit 20", "trade")
def alert_list(spark, sf, kind: str | None = "purchase", unread_only: bool = True, limit: int = 20):
    """The alert route: optional filters, newest first."""
    a = _alerts(spark, sf)
    a = a.where(c("type") == kind) if kind else a
    a = a.where(~c("is_read")) if unread_only else a
    return a.orderBy(F.desc("ts"), F.desc("id")).limit(limit).select("id", "wallet", "type", "is_read")


@query("alert_mark_read", "select event_id as id, event_id % 2 = 0 or event_id = 7 as is_read from trade", "trade")
def alert_mark_read(spark, sf):
    from ..sources.sinks import marked_read

    return marked_read(_alerts(spark, sf), 7).select("id", "is_read")


@query("idle_alert", f"""with w as (select distinct time_bucket(interval 6 hour, scan_time, timestamp '2024-01-01') as s from report),
f as (select w.s, sum(case when r.pair_count >= 5 then r.pair_count else 0 end + case when r.cross_count >= 5 then r.cross_count else 0 end) as found, count(*) as n from w join report r on r.scan_time >= w.s and r.scan_time < w.s + interval 6 hour group by 1)
select epoch_us(s) as window_start, cast(n as bigint) as reports from f where found = 0""", "report")
def idle_alert(spark, sf):
    """Six-hour windows with reports but no opportunity in them."""
    strong = lambda x: F.when(c(x) >= 5, c(x)).otherwise(0)
    w = reports(spark, sf).groupBy(F.window("scan_time", "6 hours")).agg(F.sum(strong("pair_count") + strong("cross_count")).alias("found"), F.count("*").alias("reports"))
    return w.where("found = 0").select(epoch_us(c("window.start")).alias("window_start"), "reports")


@query("report_window", f"select epoch_us(scan_time) as at, pair_count from report where scan_time > timestamp '{AS_OF}' - interval 7 day order by scan_time desc limit 50", "report")
def report_window(spark, sf):
    r = reports(spark, sf).where(c("scan_time") > now() - F.expr("INTERVAL 7 DAYS"))
    return r.orderBy(F.desc("scan_time")).limit(50).select(epoch_us(c("scan_time")).alias("at"), "pair_count")


@query("latest_report", "select epoch_us(max(scan_time)) as at, arg_max(pair_count, scan_time) as pair_count, arg_max(cross_count, scan_time) as cross_count from report", "report")
def latest_report(spark, sf):
    r = reports(spark, sf).agg(F.max("scan_time").alias("t"), F.max_by(F.struct("pair_count", "cross_count"), "scan_time").alias("r"))
    return r.select(epoch_us(c("t")).alias("at"), "r.pair_count", "r.cross_count")


@query("log_errors", """with l as (select 'log' || (event_id % 5) as file, event_id, event_type || ' value=' || cast(value as int) as line from events), e as (select *, row_number() over (partition by file order by event_id) as rn from l where regexp_matches(line, 'error|signup value=1'))
select file, count(*) as n, string_agg(line, ' | ' order by rn) filter (rn <= 5) as first_lines from e group by file""".replace("cast(value as int)", "cast(floor(value) as bigint)"))
def log_errors(spark, sf):
    """Lines with an error word, counted by file, the first five shown."""
    from pyspark.sql import Window

    from ..functions.columns import table

    e = table(spark, sf, "events")
    lines = e.select(F.concat(F.lit("log"), c("event_id") % 5).alias("file"), "event_id", F.concat("event_type", F.lit(" value="), F.floor("value").cast("string")).alias("line"))
    bad = lines.where(c("line").rlike("error|signup value=1"))
    first = bad.withColumn("rn", F.row_number().over(Window.partitionBy("file").orderBy("event_id"))).where("rn <= 5").groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "line"))), lambda x: x["line"]), " | ").alias("first_lines"))
    return bad.groupBy("file").agg(F.count("*").alias("n")).join(first, "file")


@query("health", f"""select max(ts) > timestamp '{AS_OF}' - interval 2 hour as fresh, count(*) filter (market = 'error') < count(*) / 4 as few_errors, count(distinct wallet) >= 10 as active, arg_max(market, (ts, event_id)) <> 'error' as heartbeat,
max(ts) > timestamp '{AS_OF}' - interval 2 hour and count(*) filter (market = 'error') < count(*) / 4 and count(distinct wallet) >= 10 and arg_max(market, (ts, event_id)) <> 'error' as healthy from trade""", "trade")
def health(spark, sf):
    checks = trades(spark, sf).agg((F.max("ts") > now() - F.expr("INTERVAL 2 HOURS")).alias("fresh"), (F.count_if(c("market") == "error") < F.count("*") / 4).alias("few_errors"), (F.count_distinct("wallet") >= 10).alias("active"), (F.max_by("market", F.struct("ts", "event_id")) != "error").alias("heartbeat"))
    return checks.withColumn("healthy", c("fresh") & c("few_errors") & c("active") & c("heartbeat"))


@query("watch_transition", """with s as (select wallet, user_id, week as d, sum(value) >= 1000 as eligible from holding group by all), l as (select *, coalesce(lag(eligible) over (partition by wallet order by d), false) as before_ from s),
n as (select *, sum(case when eligible and not before_ then 1 else 0 end) over (partition by wallet order by d) as starts from l),
r as (select *, row_number() over (partition by wallet, starts order by d) as k from n)
select wallet, epoch_us(d) as at, case when eligible and not before_ then 'insert' when eligible then 'update' else 'delete' end as event, case when eligible then k else 0 end as check_count from r where eligible or before_""", "holding")
def watch_transition(spark, sf):
    from ..sources.market_tables import holdings

    # a week's positions are added up in the order in which they were opened
    weeks = summed(holdings(spark, sf).withColumnRenamed("first", "opened"), ["wallet", "week"], "value", ["opened"])
    s = weeks.select("wallet", c("week").alias("at"), (c("value") >= 1000).alias("eligible"))
    return ops.watch_transitions(s).withColumn("at", epoch_us(c("at")))


_WATCHED = """with recursive trade as (select 'w' || user_id as wallet, value as volume, ts from events),
s as (select wallet, date_trunc('day', ts) as d, sum(volume) >= 150 as eligible, count(*) > 1 as changed from trade group by all),
n as (select wallet, epoch_us(d) as t, eligible, changed, row_number() over (partition by wallet order by d) as rn from s),
f as (
  select wallet, rn, t, eligible as watched, case when eligible then 'insert' end as event, case when eligible then 1 else 0 end as checks, eligible as alert, eligible as rec,
    case when eligible then t end as last_any, case when eligible then t end as last_new, case when eligible then 1 else 0 end as n_alerts from n where rn = 1
  union all
  select wallet, rn, t, eligible, event, case when not eligible then 0 when was then checks + 1 else 1 end, alert, rec, case when rec then t else last_any end, case when rec and not was then t else last_new end,
    case when not eligible then 0 when was then n_alerts + rec::int else rec::int end
  from (select *, case when not alert then false when was then true else coalesce(t - last_new >= 60 * 1000000::bigint, true) end as rec
        from (select n.wallet, n.rn, n.t, n.eligible, f.watched as was, f.checks, f.last_any, f.last_new, f.n_alerts,
                case when n.eligible and not f.watched then 'insert' when n.eligible then 'update' when f.watched then 'delete' end as event,
                n.eligible and (not f.watched or (n.changed and coalesce(n.t - f.last_any >= 4 * 86400 * 1000000::bigint, true))) as alert
              from f join n on n.wallet = f.wallet and n.rn = f.rn + 1)))
select wallet, t as at_us, event, checks::bigint as check_count, alert as should_alert, case when alert and event = 'insert' then 'new_watched' when alert then 'activity' end as type, rec as recorded, n_alerts::bigint as alert_count
from f where event is not null"""


@query("watch_alerts", _WATCHED)
def watch_alerts(spark, sf):
    """The watch list over daily snapshots with its gated alerts: four days between alerts, so that the gate is met."""
    t = trades(spark, sf).withColumn("at_us", epoch_us(F.date_trunc("day", "ts")))
    days = summed(t, ["wallet", "at_us"], "volume", ["ts", "event_id"])
    s = days.select("wallet", "at_us", (c("value") >= 150).alias("eligible"), (c("n") > 1).alias("changed"))
    return ops.watch_alerts(s, cooldown_s=4 * 86_400)


@query("sliding_volume", """select epoch_us(s) as window_start, wallet, round_even(sum(volume), 4) as volume, count(*) as trades from (select *, unnest(generate_series(date_trunc('day', ts - interval 1 day) + interval 6 hour * (floor(extract(hour from ts) / 6) + 1), date_trunc('day', ts) + interval 6 hour * floor(extract(hour from ts) / 6), interval 6 hour)) as s from trade) group by all""", "trade")
def sliding_volume(spark, sf):
    """24-hour volumes every six hours; the batch form of the stream of that name."""
    w = trades(spark, sf).groupBy(F.window("ts", "24 hours", "6 hours"), "wallet").agg(F.bround(F.sum("volume"), 4).alias("volume"), F.count("*").alias("trades"))
    return w.select(epoch_us(c("window.start")).alias("window_start"), "wallet", "volume", "trades")


# Logs are written as text first, a folder for each day, and read back in splits, as a monitor finds them.
_LOG = """with l as (select 'day=' || cast(date_trunc('day', ts) as date) as log, row_number() over (partition by date_trunc('day', ts) order by ts, event_id) as n,
  '  ' || event_id || case event_type when 'error' then ' ERROR in step ' when 'signup' then ' Scan completed ' else ' ok ' end || user_id || repeat('.', user_id % 130) || ' ' as line from events),
e as (select *, row_number() over (partition by log order by n) as k from l where contains(line, 'ERROR')),
"""


def _written_logs(spark, sf):
    from ..functions.columns import table
    from ..functions.scratch import scratch_path
    from ..sources.log_files import numbered_lines

    path = scratch_path(spark, "logs")
    kind = F.when(c("event_type") == "error", " ERROR in step ").when(c("event_type") == "signup", " Scan completed ").otherwise(" ok ")
    line = F.concat(F.lit("  "), "event_id", kind, "user_id", F.repeat(F.lit("."), (c("user_id") % 130).cast("int")), F.lit(" "))
    e = table(spark, sf, "events").select(F.to_date("ts").alias("day"), "ts", "event_id", line.alias("value"))
    e.repartition("day").sortWithinPartitions("day", "ts", "event_id").select("day", "value").write.partitionBy("day").text(path)
    lines = numbered_lines(spark, path)
    return lines.withColumn("log", F.regexp_extract("file", "(day=[^/]*)/", 1))


@query("log_health", _LOG + """b as (select log, arg_max(trim(line), n) as last_line, count(*) as lines, max(n) filter (contains(line, 'Scan completed')) as last_scan from l group by log)
select log, lines, last_line, not (contains(last_line, 'ERROR')) as heartbeat, last_scan, last_scan is not null as scanned from b""")
def log_health(spark, sf):
    """Heartbeat and last scan of each log, by the order of its lines."""
    from ..sources.log_files import heartbeats

    return heartbeats(_written_logs(spark, sf), "Scan completed", ("ERROR",), log="log")


@query("log_error_text", _LOG + r"""t as (select log, count(*) as errors, string_agg(k || '. `' || left(trim(line), 100) || '...`', chr(10) order by k) filter (k <= 5) as first_ from e group by log)
select log, errors, 'Errors in ' || log || ': ' || errors || chr(10) || first_ || case when errors > 5 then chr(10) || '... and ' || (errors - 5) || ' more' else '' end as message from t""")
def log_error_text(spark, sf):
    """The alert text of each log with errors: the first five lines, cut at 100 characters, and how many more there are."""
    from ..sources.log_files import error_messages

    return error_messages(_written_logs(spark, sf), ("ERROR",), log="log")

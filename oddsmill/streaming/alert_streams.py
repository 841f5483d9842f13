"""Structured Streaming forms: sliding volumes, stateful cooldown, duplicate suppression, idle detection, table upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import LIMITS
from ..sources.sinks import upsert_batch


def sliding_volume(trades: DataFrame, width: str = "24 hours", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Volume and trades by wallet in sliding windows; data later than the watermark is dropped."""
    return trades.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "wallet").agg(F.sum("volume").alias("volume"), F.count("*").alias("trades")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "wallet", "volume", "trades")


def idle_windows(reports: DataFrame, hours: int = LIMITS.idle_hours, slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Windows that had reports but no opportunity in them."""
    n = reports.withWatermark("scan_time", late).groupBy(F.window("scan_time", f"{hours} hours", slide)).agg(F.sum(F.col("pair_count") + F.col("cross_count")).alias("found"), F.count("*").alias("reports"))
    return n.where("found = 0").select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "reports")


def once_a_minute(alerts: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One alert per wallet, type and minute."""
    return alerts.withColumn("minute", F.date_trunc("minute", "ts")).withWatermark("minute", late).dropDuplicates(["wallet", "type", "minute"])


def cooled_down(alerts: DataFrame, keys: list[str], gap_s: int = LIMITS.cooldown_s, late: str = "10 minutes") -> DataFrame:
    """Alerts (keys..., id, ts) at least gap_s after the last kept one of their key, in event-time order.

    Rows wait in state until the watermark has passed them, so order within the allowed lateness doesn't matter; what is
    later still is dropped by the watermark. State of a key: its waiting rows and the last kept time.
    """
    names = ", ".join(f"{k} string" for k in keys)

    def fold(key, batches, state: GroupState):
        import pandas as pd

        last, waiting = state.get if state.exists else (None, [])
        waiting = [tuple(x) for x in waiting]
        for pdf in batches:
            waiting += list(zip(pdf["ts"].astype("datetime64[us]").astype("int64"), pdf["id"], strict=True))
        mark = state.getCurrentWatermarkMs() * 1000
        ready, waiting = sorted(x for x in waiting if x[0] <= mark), [x for x in waiting if x[0] > mark]
        kept = []
        for ts, i in ready:
            if last is None or ts - last >= gap_s * 1_000_000:
                kept.append((*key, int(i), int(ts)))
                last = int(ts)
        state.update((last, [(int(t), int(i)) for t, i in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(min(t for t, _ in waiting) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(kept, columns=[*keys, "id", "ts_us"])

    rows = alerts.withWatermark("ts", late)
    return rows.groupBy(*keys).applyInPandasWithState(fold, f"{names}, id long, ts_us long", "last long, waiting array<struct<ts:long,id:long>>", "append", GroupStateTimeout.EventTimeTimeout)


def cache_misses(requests: DataFrame, keys: list[str], ttl_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """Requests (keys..., id, ts) that find no result computed less than ttl_s before: the others are served from cache."""
    return cooled_down(requests, keys, ttl_s, late)


def _us(times) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


def _due(waiting: list[tuple], state: GroupState) -> tuple[list[tuple], list[tuple]]:
    """Rows (time first) that the watermark has passed, in order, and those that still wait."""
    mark = state.getCurrentWatermarkMs() * 1000
    key = lambda x: tuple((v is not None, v) for v in x)
    return sorted((x for x in waiting if x[0] <= mark), key=key), [x for x in waiting if x[0] > mark]


def _wake(state: GroupState, times: list[int]) -> None:
    """Calls the group again when the watermark reaches the earliest of some times."""
    if times:
        state.setTimeoutTimestamp(max(min(times) // 1000, state.getCurrentWatermarkMs() + 1))


def position_changes(positions: DataFrame, tolerance: float = LIMITS.size_tolerance, late: str = "10 minutes") -> DataFrame:
    """Changes of positions (wallet, market, size, ts) against what a wallet held in a market before, kept as state between runs.

    size 0 closes a position. Rows wait until the watermark has passed them and are taken in time order; what comes later than that
    is dropped by the watermark.
    """

    def fold(key, batches, state: GroupState):
        import pandas as pd

        held, waiting = state.get if state.exists else (0.0, [])
        waiting = [tuple(x) for x in waiting]
        for pdf in batches:
            waiting += list(zip(_us(pdf["ts"]), pdf["size"].tolist(), strict=True))
        due, waiting = _due(waiting, state)
        out = []
        for ts, size in due:
            change = round(size - held, 6)
            kind = "new" if held == 0 and size > 0 else "closed" if held > 0 and size == 0 else "increased" if change > tolerance else "decreased" if change < -tolerance else None
            if kind:
                out.append((*key, kind, float(held), float(size), ts))
            held = float(size)
        state.update((held, waiting))
        _wake(state, [t for t, _ in waiting])
        yield pd.DataFrame(out, columns=["wallet", "market", "type", "old_size", "new_size", "ts_us"])

    shape = "wallet string, market string, type string, old_size double, new_size double, ts_us long"
    return positions.withWatermark("ts", late).groupBy("wallet", "market").applyInPandasWithState(fold, shape, "held double, waiting array<struct<ts:long,size:double>>", "append", GroupStateTimeout.EventTimeTimeout)


def snapshot_changes(positions: DataFrame, tolerance: float = LIMITS.size_tolerance, late: str = "10 minutes") -> DataFrame:
    """Changes between a wallet's snapshots, rows (wallet, market, size, ts) of equal ts: new, increased, decreased and closed.

    A market that the next snapshot lacks is closed; a row without market stands for a snapshot without positions. The state of a wallet
    is its last settled snapshot, a map from market to size, and rows of snapshots that the watermark hasn't passed. Snapshots are
    settled whole and in time order; one as old as the last is left out. Of rows of a market in one snapshot the largest counts.
    """

    def fold(key, batches, state: GroupState):
        import pandas as pd

        settled, markets, sizes, waiting = state.get if state.exists else (-1, [], [], [])
        held, waiting = dict(zip(markets, sizes, strict=True)), [tuple(x) for x in waiting]
        for pdf in batches:
            waiting += [(t, None if pd.isna(m) else m, float(x)) for t, m, x in zip(_us(pdf["ts"]), pdf["market"], pdf["size"].fillna(0.0), strict=True)]
        due, waiting = _due(waiting, state)
        out = []
        for ts in sorted({t for t, *_ in due}):
            if ts <= settled:
                continue
            now = {m: x for t, m, x in due if t == ts and m is not None}
            for m, x in now.items():
                change = round(x - held.get(m, 0.0), 6)
                kind = "new" if m not in held else "increased" if change > tolerance else "decreased" if change < -tolerance else None
                if kind:
                    out.append((*key, m, kind, held.get(m), x, ts))
            out += [(*key, m, "closed", x, None, ts) for m, x in held.items() if m not in now]
            settled, held = ts, now
        state.update((settled, list(held), list(held.values()), waiting))
        _wake(state, [t for t, *_ in waiting])
        yield pd.DataFrame(out, columns=["wallet", "market", "type", "old_size", "new_size", "ts_us"])

    shape = "wallet string, market string, type string, old_size double, new_size double, ts_us long"
    kept = "settled long, markets array<string>, sizes array<double>, waiting array<struct<ts:long,market:string,size:double>>"
    return positions.withWatermark("ts", late).groupBy("wallet").applyInPandasWithState(fold, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)


def cached_results(requests: DataFrame, compute, ttl_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """Requests (wallet, data_hash, id, ts) answered from cache: (wallet, id, ts_us, result, hit).

    A wallet's state is (hash, result, expiry). A request with that hash before the expiry gets the kept result; any other calls
    compute(wallet, data_hash), whose text is kept for ttl_s. Requests are taken in event-time order behind the watermark; state goes once the
    watermark has passed its expiry.
    """

    def fold(key, batches, state: GroupState):
        import pandas as pd

        known, result, expiry, waiting = state.get if state.exists else (None, None, -1, [])
        waiting = [tuple(x) for x in waiting]
        for pdf in batches:
            waiting += list(zip(_us(pdf["ts"]), pdf["id"].tolist(), pdf["data_hash"].tolist(), strict=True))
        due, waiting = _due(waiting, state)
        out = []
        for ts, i, asked in due:
            hit = result is not None and asked == known and ts < expiry
            if not hit:
                known, result, expiry = asked, compute(key[0], asked), ts + ttl_s * 1_000_000
            out.append((*key, i, ts, result, hit))
        if not waiting and expiry <= state.getCurrentWatermarkMs() * 1000:
            state.remove()
        else:
            state.update((known, result, expiry, waiting))
            _wake(state, [t for t, *_ in waiting] or [expiry])
        yield pd.DataFrame(out, columns=["wallet", "id", "ts_us", "result", "hit"])

    kept = "known string, result string, expiry long, waiting array<struct<ts:long,id:long,hash:string>>"
    return requests.withWatermark("ts", late).groupBy("wallet").applyInPandasWithState(fold, "wallet string, id long, ts_us long, result string, hit boolean", kept, "append", GroupStateTimeout.EventTimeTimeout)


def watch_alerts(snapshots: DataFrame, cooldown_s: int = LIMITS.cooldown_s, duplicate_s: int = LIMITS.duplicate_s, late: str = "10 minutes") -> DataFrame:
    """The watch list with its gated alerts over snapshots (wallet, ts, eligible, changed): as operators.alerts.watch_alerts, as a stream."""

    def fold(key, batches, state: GroupState):
        import pandas as pd

        watched, checks, count, last_any, last_new, waiting = state.get if state.exists else (False, 0, 0, None, None, [])
        waiting = [tuple(x) for x in waiting]
        for pdf in batches:
            flags = [[bool(x) and not pd.isna(x) for x in pdf[c]] for c in ("eligible", "changed")]
            waiting += list(zip(_us(pdf["ts"]), *flags, strict=True))
        due, waiting = _due(waiting, state)
        out, old = [], lambda last, ts, gap: last is None or ts - last >= gap * 1_000_000
        for ts, eligible, changed in due:
            event = ("update" if watched else "insert") if eligible else "delete" if watched else None
            checks = checks + 1 if eligible else 0
            kind = "new_watched" if event == "insert" else "activity" if event == "update" and changed and old(last_any, ts, cooldown_s) else None
            recorded = kind == "activity" or kind == "new_watched" and old(last_new, ts, duplicate_s)
            count = (count if event == "update" else 0) + recorded
            last_any, last_new = ts if recorded else last_any, ts if recorded and event == "insert" else last_new
            watched = eligible
            if event:
                out.append((*key, ts, event, checks, kind is not None, kind, recorded, count))
        state.update((watched, checks, count, last_any, last_new, waiting))
        _wake(state, [t for t, *_ in waiting])
        yield pd.DataFrame(out, columns=["wallet", "at_us", "event", "check_count", "should_alert", "type", "recorded", "alert_count"])

    shape = "wallet string, at_us long, event string, check_count long, should_alert boolean, type string, recorded boolean, alert_count long"
    kept = "watched boolean, checks long, count long, last_any long, last_new long, waiting array<struct<ts:long,eligible:boolean,changed:boolean>>"
    return snapshots.withWatermark("ts", late).groupBy("wallet").applyInPandasWithState(fold, shape, kept, "append", GroupStateTimeout.EventTimeTimeout)


def price_buffers(prices: DataFrame, cap: int = 100, late: str = "10 minutes") -> DataFrame:
    """The last `cap` prices of each market (market, price, ts) after each micro-batch that brings some, oldest first."""

    def fold(key, batches, state: GroupState):
        import pandas as pd

        held = [tuple(x) for x in state.get[0]] if state.exists else []
        for pdf in batches:
            held = sorted(held + list(zip(pdf["ts"].astype("datetime64[us]").astype("int64").tolist(), pdf["price"].tolist(), strict=True)))[-cap:]
        state.update((held,))
        yield pd.DataFrame([(key[0], [p for _, p in held])], columns=["market", "prices"])

    return prices.withWatermark("ts", late).groupBy("market").applyInPandasWithState(fold, "market string, prices array<double>", "held array<struct<ts:long,price:double>>", "update", GroupStateTimeout.NoTimeout)


def idle_gaps(reports: DataFrame, hours: int = LIMITS.idle_hours, late: str = "1 hour") -> DataFrame:
    """(source, idle_since_us) of each source of reports (source, scan_time) that fell silent: no report for so many hours."""
    gap = hours * 3_600_000

    def fold(key, batches, state: GroupState):
        import pandas as pd

        out = []
        if state.hasTimedOut:
            out.append((key[0], int(state.get[0])))
            state.remove()
        else:
            last = state.get[0] if state.exists else 0
            for pdf in batches:
                last = max(last, int(pdf["scan_time"].astype("datetime64[us]").astype("int64").max()))
            state.update((last,))
            state.setTimeoutTimestamp(max(last // 1000 + gap, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source", "idle_since_us"])

    return reports.withWatermark("scan_time", late).groupBy("source").applyInPandasWithState(fold, "source string, idle_since_us long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_stream(rows: DataFrame, path: str, keys: list[str], checkpoint: str, order: list[str] | None = None, every: str | None = None):
    """Starts a query that keeps the keyed table at path up to date: with all data there is, or a micro-batch `every` so often."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return rows.writeStream.foreachBatch(upsert_batch(path, keys, order, writer=checkpoint)).option("checkpointLocation", checkpoint).trigger(**trigger).start()

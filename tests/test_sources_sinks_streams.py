"""Readers, writers and streams."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddsmill.sources import market_tables, sinks
from oddsmill.streaming import alert_streams


def test_json_reader_drops_damaged_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "liquidity": "5"}\n{broken\n{"id": "2"}\n')
    rows = market_tables.read_json(spark, str(tmp_path), market_tables.MARKET_JSON).collect()
    assert [r["id"] for r in rows] == ["1", "2"] and rows[0]["file"].endswith("a.json")


def test_log_reader(spark, tmp_path):
    (tmp_path / "x.log").write_text("ok\nERROR one\n")
    assert market_tables.read_log(spark, str(tmp_path)).where("line like 'ERROR%'").count() == 1


def test_upsert_and_children(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "wallet string, v int, note string")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "wallet string, v int")
    assert sorted(map(tuple, sinks.upserted(old, new, ["wallet"]).collect())) == [("a", 1, "x"), ("b", 3, None), ("c", 4, None)]
    kids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "wallet string, p int")
    assert sorted(map(tuple, sinks.replaced_children(kids, spark.createDataFrame([("a", 9)], "wallet string, p int"), ["wallet"]).collect())) == [("a", 9), ("b", 1)]
    w = spark.createDataFrame([("a", True), ("b", True), ("c", False)], "wallet string, is_watched boolean")
    assert {r["wallet"]: r["is_watched"] for r in sinks.unwatched(w, kids.where("wallet = 'a'")).collect()} == {"a": True, "b": False, "c": False}


def test_report_document(spark):
    rows = spark.createDataFrame([(1, "a")], "id int, name string")
    doc = json.loads(sinks.report_document({"kind": "pairs"}, rows, "items").first()["value"])
    assert doc == {"kind": "pairs", "count": 1, "items": [{"id": 1, "name": "a"}]}


def test_reports_count_and_keep_all_rows(spark, tmp_path):
    rows = spark.range(2500).repartition(7).select((2500 - F.col("id")).alias("id"), F.lit("a\nb").alias("name"), F.create_map(F.lit("k"), "id").alias("m"))
    doc = json.loads(sinks.report_document({"kind": "pairs"}, rows, "items", top=1000, order=[F.desc("id")]).first()["value"])
    assert doc["count"] == 2500 and [x["id"] for x in doc["items"]] == list(range(2500, 1500, -1))
    assert [x["id"] for x in json.loads(sinks.report_document({}, rows, "items", top=3).first()["value"])["items"]] == [1, 2, 3]
    path = str(tmp_path / "report")
    sinks.write_report({"kind": "pairs"}, rows, "items", path)
    assert json.loads(spark.read.text(f"{path}/header").first()["value"]) == {"kind": "pairs", "count": 2500}
    assert sorted(r["id"] for r in spark.read.json(f"{path}/items").collect()) == list(range(1, 2501))


def test_monitor_report(spark, tmp_path):
    rows = spark.createDataFrame([(1, True), (2, False), (3, True)], "id int, approved boolean")
    path = str(tmp_path / "report")
    one = rows.select("id")
    sinks.write_monitor_report({"at": "now"}, {"pair_cost": rows, "cross_market": rows.where("id < 3"), "whale": rows, "news": one, "market_making": rows}, path)
    head = json.loads(spark.read.text(f"{path}/header").first()["value"])
    assert head["pair_cost"] == {"count": 3, "approved_count": 2} and head["news"] == {"count": 3, "approved_count": 0} and head["at"] == "now"
    # whales and news are no opportunities, and market making isn't reviewed
    assert head["summary"] == {
        "total_opportunities": 8, "approved_opportunities": 3, "active_whales": 3, "news_signals": 3, "correlation_signals": 0, "market_making_opportunities": 3,
    }


def test_history_grows_by_watched_keys(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "wallet string, v int")
    for _ in range(2):
        sinks.append_history(rows, rows.where("wallet = 'a'"), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [("a", 1)] * 2


def test_state_keeps_the_newest_and_leaves_other_folders(spark, tmp_path):
    path, shape = str(tmp_path / "state"), "wallet string, v int, at long"
    assert sinks.read_state(spark, path, shape).count() == 0
    put = lambda rows: sinks.write_state(spark.createDataFrame(rows, shape), path, ["wallet"], ["at"])
    put([(f"w{i}", i, 10) for i in range(200)])
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "state").rglob("part-*")}
    put([("w7", 70, 5), ("w8", 80, 11), ("w8", 81, 12), ("w8", 82, None), ("x", 1, None), ("w9", 90, 10)])
    got = {r["wallet"]: r["v"] for r in sinks.read_state(spark, path, shape).collect()}
    assert got == {f"w{i}": i for i in range(200)} | {"w8": 81, "x": 1, "w9": 90}
    assert all(f.exists() and f.stat().st_mtime_ns == t for f, t in before.items())
    put([])
    assert sinks.read_state(spark, path, shape).count() == 201


def state_of(spark, path, shape="wallet string, v int"):
    rows = sinks.read_state(spark, path, shape).collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r["wallet"]: r["v"] for r in rows}


def test_the_last_write_wins(spark, tmp_path):
    path, shape = str(tmp_path / "state"), "wallet string, v int"
    put = lambda rows, **how: sinks.write_state(spark.createDataFrame(rows, shape), path, ["wallet"], **how)
    put([("a", 5), ("b", 5), (None, 1)])
    put([("a", 3), (None, None)])
    assert state_of(spark, path) == {"a": 3, "b": 5, None: None}
    assert put([("a", 1)], batch=4, writer="s") and not put([("a", 9)], batch=4, writer="s") and not put([("a", 9)], batch=3, writer="s")
    assert put([("b", 2)], batch=0, writer="t") and put([], batch=5, writer="s") and not put([("a", 8)], batch=5, writer="s")
    assert state_of(spark, path) == {"a": 1, "b": 2, None: None}


def test_a_lost_writer_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    path, shape = str(tmp_path / "state"), "wallet string, v int"
    first, second = [(f"w{i}", i) for i in range(300)], [(f"w{i}", -i) for i in range(0, 600, 2)]
    write = lambda rows: sinks.write_state(spark.createDataFrame(rows, shape), path, ["wallet"], batch=len(rows))
    write(first[:200])
    write(first)
    for step in ("_publish", "_rows"):
        with monkeypatch.context() as m:
            m.setattr(sinks.KeyedTable, step, lambda *a, **k: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                sinks.write_state(spark.createDataFrame(second, shape), path, ["wallet"], batch=1000)
        assert state_of(spark, path) == dict(first)
    for _ in range(6):
        sinks.write_state(spark.createDataFrame(second, shape), path, ["wallet"], batch=1000)
        sinks.write_state(spark.createDataFrame(second[:1], shape), path, ["wallet"])
    assert state_of(spark, path) == dict(first) | dict(second)
    # old versions are gone
    assert len(list((tmp_path / "state" / "manifests").glob("0*"))) == 3


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    from oddsmill.sources.keyed_table import LostRace

    path, shape = str(tmp_path / "state"), "wallet string, v int"
    sinks.write_state(spark.createDataFrame([("a", 1)], shape), path, ["wallet"])
    table = sinks.KeyedTable(spark, path)
    number, seen = table.latest()
    monkeypatch.setattr(sinks.KeyedTable, "latest", lambda self: (number, seen))
    sinks.write_state(spark.createDataFrame([("a", 2)], shape), path, ["wallet"])
    with pytest.raises(LostRace):
        sinks.write_state(spark.createDataFrame([("a", 3)], shape), path, ["wallet"])
    monkeypatch.undo()
    assert state_of(spark, path) == {"a": 2}


def test_a_corrupt_manifest_counts_as_not_written(spark, tmp_path):
    path, shape = tmp_path / "state", "wallet string, v int"
    put = lambda rows: sinks.write_state(spark.createDataFrame(rows, shape), str(path), ["wallet"])
    put([("a", 1)])
    put([("a", 2)])
    (path / "manifests" / ".000000000002.crc").unlink(missing_ok=True)
    (path / "manifests" / "000000000002").write_text("{half")
    assert state_of(spark, str(path)) == {"a": 1}
    put([("b", 3)])
    assert state_of(spark, str(path)) == {"a": 1, "b": 3}
    lone = tmp_path / "lone" / "manifests"
    lone.mkdir(parents=True)
    (lone / "000000000001").write_text("")
    assert state_of(spark, str(tmp_path / "lone")) == {}


def test_children_are_replaced_in_the_table(spark, tmp_path):
    path, shape = str(tmp_path / "kids"), "wallet string, market string, size int"
    put = lambda rows, **how: sinks.write_children(spark.createDataFrame(rows, shape), path, ["wallet"], **how)
    put([(f"w{i}", f"m{j}", i * j) for i in range(100) for j in range(3)])
    put([("w5", "m9", 1), ("w6", "m0", 2), ("w6", "m1", 3), ("new", "m", 4)], batch=0)
    put([("w5", "m7", 7)], batch=0)
    rows = sorted(map(tuple, sinks.read_state(spark, path, shape).collect()))
    assert rows == sorted([(f"w{i}", f"m{j}", i * j) for i in range(100) for j in range(3) if i not in (5, 6)] + [("w5", "m9", 1), ("w6", "m0", 2), ("w6", "m1", 3), ("new", "m", 4)])


def test_order_books_from_json(spark):
    raw = spark.createDataFrame([("m", '[["0.4", "10"], [0.45, 5], ["x", 1], [0.3]]', '[[0.6, 1], [0.5, 2]]'), ("n", None, "oops")], "market string, bids string, asks string")
    got = sorted(map(tuple, market_tables.parsed_books(raw).collect()))
    assert got == [("m", "ask", 0, 0.5, 2.0), ("m", "ask", 1, 0.6, 1.0), ("m", "bid", 0, 0.45, 5.0), ("m", "bid", 1, 0.4, 10.0)]


def test_order_books_as_the_source_sends_them(spark):
    bids, asks = '[{"price":"0.4","size":"10"},{"price":"0.45","size":"5.5"},{"size":"1"},{"price":null,"size":"1"}]', '[{"price":0.6,"size":1},{"size":"2","price":"0.5"}]'
    raw = spark.createDataFrame([("m", bids, asks, "t1", 17), ("n", "[]", None, "t2", 18)], "market string, bids string, asks string, token_id string, timestamp long")
    got = sorted(map(tuple, market_tables.parsed_books(raw).collect()))
    assert got == [("m", side, level, price, size, "t1", 17) for side, level, price, size in (("ask", 0, 0.5, 2.0), ("ask", 1, 0.6, 1.0), ("bid", 0, 0.45, 5.5), ("bid", 1, 0.4, 10.0))]


def stream(spark, tmp_path, rows, columns, batches=None):
    """A file stream of rows, a file per batch."""
    src = tmp_path / "in"
    src.mkdir(exist_ok=True)
    for i, part in enumerate(batches or [rows]):
        pd.DataFrame(part, columns=columns).to_parquet(src / f"{i:03}.parquet", coerce_timestamps="us")
    static = spark.read.parquet(str(src))
    return spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(str(src))


def ran(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def at(minutes):
    return pd.Timestamp("2024-01-01", tz="UTC") + pd.Timedelta(minutes=minutes)


def test_streaming_cooldown_equals_the_batch_fold(spark, tmp_path):
    # out of order within the allowed lateness; a last row moves the watermark past all others
    rows = [[("w", 0, at(0)), ("w", 2, at(16))], [("w", 1, at(10)), ("v", 3, at(12))], [("x", 9, at(600))]]
    s = stream(spark, tmp_path, None, ["wallet", "id", "ts"], rows)
    kept = ran(alert_streams.cooled_down(s, ["wallet"]), tmp_path, "cooldown")
    assert sorted((r["wallet"], r["id"]) for r in kept if r["wallet"] != "x") == [("v", 3), ("w", 0), ("w", 2)]


def test_streaming_minute_dedup(spark, tmp_path):
    rows = [("w", "t", 1, at(0)), ("w", "t", 2, at(0.5)), ("w", "t", 3, at(1)), ("w", "u", 4, at(0))]
    s = stream(spark, tmp_path, rows, ["wallet", "type", "id", "ts"])
    assert len(ran(alert_streams.once_a_minute(s), tmp_path, "minute")) == 3


def test_streaming_sliding_volume(spark, tmp_path):
    rows = [("w", 5.0, at(0)), ("w", 7.0, at(60)), ("w", 1.0, at(60 * 72))]
    s = stream(spark, tmp_path, rows, ["wallet", "volume", "ts"])
    got = {r["start"].isoformat(): r["volume"] for r in ran(alert_streams.sliding_volume(s, "24 hours", "12 hours"), tmp_path, "volume", "update")}
    assert got["2024-01-01T00:00:00"] == 12.0


def test_streaming_idle_windows(spark, tmp_path):
    rows = [(at(0), 0, 0), (at(60), 0, 0), (at(500), 1, 0), (at(5000), 1, 1)]
    s = stream(spark, tmp_path, rows, ["scan_time", "pair_count", "cross_count"])
    got = ran(alert_streams.idle_windows(s, slide="6 hours"), tmp_path, "idle", "update")
    assert [(r["start"].hour, r["reports"]) for r in got] == [(0, 2)]


@pytest.mark.parametrize("n", [1, 3])
def test_streaming_upsert(spark, tmp_path, n):
    batches = [[("a", i), (f"b{i}", i)] for i in range(n)]
    s = stream(spark, tmp_path, None, ["wallet", "v"], batches)
    path = str(tmp_path / "table")
    assert alert_streams.upsert_stream(s, path, ["wallet"], str(tmp_path / "cp")).awaitTermination(120)
    assert state_of(spark, path, "wallet string, v long") == {"a": n - 1, **{f"b{i}": i for i in range(n)}}


def test_streaming_duplicates_within_a_minute(spark, tmp_path):
    rows = [("w", "t", 0, at(0)), ("w", "t", 1, at(0.9)), ("w", "t", 2, at(1)), ("w", "u", 3, at(0.5)), ("x", "t", 9, at(600))]
    s = stream(spark, tmp_path, None, ["wallet", "type", "id", "ts"], [rows[:2], rows[2:]])
    assert sorted(r["id"] for r in ran(alert_streams.cooled_down(s, ["wallet", "type"], 60), tmp_path, "dups") if r["wallet"] != "x") == [0, 2, 3]


def test_streaming_cache_misses(spark, tmp_path):
    rows = [[("w", 0, at(0)), ("w", 1, at(60 * 23))], [("w", 2, at(60 * 24))], [("x", 9, at(60 * 99))]]
    s = stream(spark, tmp_path, None, ["wallet", "id", "ts"], rows)
    assert sorted(r["id"] for r in ran(alert_streams.cache_misses(s, ["wallet"]), tmp_path, "cache") if r["wallet"] != "x") == [0, 2]


def test_streaming_position_changes_keep_state_between_batches(spark, tmp_path):
    rows = [[("w", "m", 5.0, at(0)), ("w", "n", 1.0, at(0))], [("w", "m", 7.0, at(15)), ("w", "n", 1.005, at(15))], [("w", "m", 6.0, at(10)), ("w", "m", 0.0, at(20)), ("w", "n", 0.5, at(20))], [("x", "x", 0.0, at(900))]]
    s = stream(spark, tmp_path, None, ["wallet", "market", "size", "ts"], rows)
    got = [(r["market"], r["type"], r["old_size"], r["new_size"]) for r in ran(alert_streams.position_changes(s), tmp_path, "changes")]
    # the row of minute 10 comes after that of minute 15, but within the allowed lateness
    assert sorted(got) == [("m", "closed", 7.0, 0.0), ("m", "increased", 5.0, 6.0), ("m", "increased", 6.0, 7.0), ("m", "new", 0.0, 5.0), ("n", "decreased", 1.005, 0.5), ("n", "new", 0.0, 1.0)]


def test_streaming_snapshots_equal_the_batch(spark, tmp_path):
    from oddsmill.operators import traders

    snaps = [{("w", "a"): 5.0, ("w", "b"): 1.0, ("v", "a"): 2.0}, {("w", "a"): 5.005, ("w", "c"): 3.0, ("v", "a"): 4.0}, {("w", "c"): 1.0}, {("w", "c"): 1.0, ("w", "a"): 1.0, ("v", "b"): 9.0}]
    rows = []
    for i, snap in enumerate(snaps):
        some = [(w, m, size, at(30 * i)) for (w, m), size in snap.items()]
        rows += some + [(w, None, None, at(30 * i)) for w in {"w", "v"} - {w for w, _ in snap}]
    # snapshots come in parts and out of order; a late copy of the first is left out
    batches = [[rows[0], rows[2], rows[3]], [rows[1], rows[4], rows[6], rows[5]], rows[7:], [rows[0], ("x", "x", 1.0, at(900))], [("w", "zz", 1.0, at(1)), ("x", "x", 1.0, at(901))]]
    got = {(r["ts_us"], r["wallet"], r["market"], r["type"], r["old_size"], r["new_size"]) for r in ran(alert_streams.snapshot_changes(stream(spark, tmp_path, None, ["wallet", "market", "size", "ts"], batches)), tmp_path, "snaps") if r["wallet"] != "x"}
    shape, want = "wallet string, market string, size double", set()
    for i, snap in enumerate(snaps):
        two = [spark.createDataFrame([(*k, x) for k, x in s.items()], shape) for s in ({} if i == 0 else snaps[i - 1], snap)]
        want |= {(int(at(30 * i).value // 1000), r["wallet"], r["market"], r["type"], r["old_size"], r["new_size"]) for r in traders.position_changes(*two, ["wallet", "market"]).collect()}
    assert got == want and {t for _, _, _, t, _, _ in want} == {"new", "increased", "decreased", "closed"}


def test_streaming_cached_results_expire(spark, tmp_path):
    day = 24 * 60
    rows = [
        [("w", "h1", 0, at(0)), ("w", "h1", 1, at(day - 1)), ("v", "h9", 10, at(5))],
        [("w", "h2", 2, at(day - 0.5)), ("w", "h1", 3, at(day - 0.25)), ("w", "h1", 4, at(day + 5))],
        [("w", "h1", 5, at(3 * day)), ("x", "h", 99, at(3 * day))],
        [("x", "h", 99, at(3 * day + 20))], [("x", "h", 99, at(6 * day))], [("x", "h", 99, at(6 * day + 1))],
    ]
    s = stream(spark, tmp_path, None, ["wallet", "data_hash", "id", "ts"], rows)
    df = alert_streams.cached_results(s, lambda wallet, h: f"{wallet} by {h}")
    q = df.writeStream.format("memory").queryName("cached").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r["id"]: (r["result"], r["hit"]) for r in spark.table("cached").collect() if r["wallet"] != "x"}
    assert got == {0: ("w by h1", False), 1: ("w by h1", True), 10: ("v by h9", False), 2: ("w by h2", False), 3: ("w by h1", False), 4: ("w by h1", True), 5: ("w by h1", False)}
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) >= 2 and held[-1] == 1  # only the last wallet's is left


def test_streaming_watch_alerts_equal_the_batch(spark, tmp_path):
    import random

    from oddsmill.operators import alerts

    rng, rows = random.Random(4), []
    for w in ("a", "b", "c"):
        t = 0.0
        for _ in range(60):
            t += rng.choice([0.2, 0.2, 0.3, 5, 5, 14, 15, 16])
            rows.append((w, rng.random() < 0.6, rng.random() < 0.7, at(0) + pd.Timedelta(seconds=round(t * 60))))
    batch = spark.createDataFrame([(w, int(t.value // 1000), e, ch) for w, e, ch, t in rows], "wallet string, at_us long, eligible boolean, changed boolean")
    want = sorted(map(tuple, alerts.watch_alerts(batch).collect()))
    rows.sort(key=lambda r: r[3])
    parts = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    for p in parts:
        rng.shuffle(p)
    s = stream(spark, tmp_path, None, ["wallet", "eligible", "changed", "ts"], [*parts, [("x", False, False, at(9000))]])
    got = sorted(map(tuple, ran(alert_streams.watch_alerts(s, late="3 hours"), tmp_path, "watch")))
    assert got == want and len({r[5] for r in want}) == 3 and any(r[4] and not r[6] for r in want)
    newest = alerts.last_alerts(alerts.watch_alerts(batch), 5).collect()
    assert [r["at_us"] for r in newest] == sorted((r[1] for r in want if r[6]), reverse=True)[:5]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    from oddsmill.sources import log_files

    for name, n in (("a", 3000), ("b", 7), ("c", 0)):
        (tmp_path / f"{name}.log").write_text("".join(f"{name} line {i}\n" for i in range(1, n + 1)))
    (tmp_path / "d.log").write_text("start\nTraceback x\nfine\n" + "".join(f"  KeyError {i} {'y' * 200}\n" for i in range(6)) + "扫描完成\nlast Error\n   \n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = log_files.numbered_lines(spark, str(tmp_path)).cache()
        got = lines.where("file like '%a.log' or file like '%b.log'").collect()
        assert len(got) == 3007 and all(r["line"].endswith(f"line {r['n']}") for r in got)
        assert lines.where("file like '%a.log'").rdd.getNumPartitions() > 1
        beats = {r["file"][-5:]: (r["lines"], r["last_line"], r["heartbeat"], r["last_scan"], r["scanned"]) for r in log_files.heartbeats(lines).collect()}
        assert beats == {"a.log": (3000, "a line 3000", True, None, False), "b.log": (7, "b line 7", True, None, False), "d.log": (13, "last Error", False, 10, True)}
        (bad,) = log_files.error_messages(lines).collect()
        listed = bad["message"].split("\n")
        assert bad["errors"] == 8 and listed[1] == "1. `Traceback x...`" and listed[2] == f"2. `KeyError 0 {'y' * 89}...`" and listed[-1] == "... and 3 more" and len(listed) == 7
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_streaming_price_buffers_are_capped(spark, tmp_path):
    rows = [[("m", float(i), at(i)) for i in range(3)], [("m", 9.0, at(9)), ("m", 8.0, at(8))]]
    s = stream(spark, tmp_path, None, ["market", "price", "ts"], rows)
    assert [list(r["prices"]) for r in ran(alert_streams.price_buffers(s, cap=3), tmp_path, "buffers", "update")] == [[0.0, 1.0, 2.0], [2.0, 8.0, 9.0]]


def test_streaming_idle_gap_timer(spark, tmp_path):
    rows = [[("a", at(0)), ("b", at(0))], [("a", at(60)), ("b", at(300))], [("b", at(60 * 9))], [("b", at(60 * 9 + 1))]]
    s = stream(spark, tmp_path, None, ["source", "scan_time"], rows)
    assert [(r["source"], r["idle_since_us"]) for r in ran(alert_streams.idle_gaps(s), tmp_path, "gaps")] == [("a", int(at(60).value // 1000))]

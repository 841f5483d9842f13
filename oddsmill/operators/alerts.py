"""Alerts: folds whose every decision depends on the last alert kept, and de-duplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.scratch import cut

#: Gaps in a chunk of a timeline; rows of a segment that one task folds.
CHUNK, LONGEST = 64, 1_000_000


def _next_after(rows: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """(uid, to): of each row (keys, ts_us, uid) the first row of its key at least gap_us later; rows without one are left out.

    Rows and the times asked for are range-sorted together, so a key's timeline is spread over chunks. A time looks in its
    chunk first, then takes the first row of the next of its key's chunks that has one.
    """
    asked = rows.select(*keys, (F.col("ts_us") + gap_us).alias("t"), F.lit(0).alias("kind"), "uid", F.lit(None).cast("long").alias("row"))
    both = asked.unionByName(rows.select(*keys, F.col("ts_us").alias("t"), F.lit(1).alias("kind"), "uid", F.col("uid").alias("row")))
    both = cut(both.repartitionByRange(*keys, "t", "kind").withColumn("chunk", F.spark_partition_id()), "alert-chunks")
    within = Window.partitionBy(*keys, "chunk").orderBy(F.desc("t"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    heads = both.groupBy(*keys, "chunk").agg(F.min(F.when(F.col("kind") == 1, F.struct("t", "row")))["row"].alias("head")).withColumn("head", F.last("head", ignorenulls=True).over(later))
    heads = heads.withColumnsRenamed({k: f"{k}_" for k in [*keys, "chunk"]})
    found = both.withColumn("to", F.last("row", ignorenulls=True).over(within)).where("kind = 0")
    met = found.join(heads, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in [*keys, "chunk"]], "left")
    return met.select("uid", F.coalesce("to", "head").alias("to")).where("to is not null")


def _doubled(timed: DataFrame, keys: list[str], gap_us: int) -> DataFrame:
    """Rows (keys, ts_us, id) of timelines of any length that are kept, by pointers.

    Each alert points to the one that would be kept next after it; from a key's first alert, pointers that double in length each
    round reach all that are kept, in as many rounds as the logarithm of the longest chain. No task needs a whole key.
    """
    timed = cut(timed.groupBy(*keys, "ts_us").agg(F.min("id").alias("id")).withColumn("uid", F.monotonically_increasing_id()), "alerts")
    jump = cut(_next_after(timed, keys, gap_us), "alert-jumps")
    kept = cut(timed.groupBy(*keys).agg(F.min(F.struct("ts_us", "uid"))["uid"].alias("uid")).select("uid"), "alerts-kept")
    while not (found := cut(kept.join(jump, "uid").select(F.col("to").alias("uid")), "alerts-found")).isEmpty():
        kept = cut(kept.union(found), "alerts-kept")
        jump = cut(jump.join(jump.select(F.col("uid").alias("to"), F.col("to").alias("to_")), "to").select("uid", F.col("to_").alias("to")), "alert-jumps")
    return timed.join(kept, "uid", "left_semi").select(*keys, "ts_us", "id")


def segments(timed: DataFrame, keys: list[str], gap_us: int, forced: str | None = None) -> DataFrame:
    """(keys, ts_us, id) with segment, the time at which the row's segment begins, and starts, true for its first row.

    A segment ends where the step to the next row of its key is at least the gap, and before a row that is forced. Rows are looked at in chunks of time, so a key's
    timeline is spread over tasks; what crosses chunks is settled on a table of chunks, and only its first segment takes a
    start from before.
    """
    rows = timed.withColumn("chunk", F.floor(F.col("ts_us") / (gap_us * CHUNK)))
    w = Window.partitionBy(*keys, "chunk").orderBy("ts_us", "id")
    rows = rows.withColumn("before", F.lag("ts_us").over(w))
    must = F.col(forced) if forced else F.lit(False)
    rows = rows.withColumn("starts", F.col("before").isNull() | (F.col("ts_us") - F.col("before") >= gap_us) | must)
    rows = rows.withColumn("segment", F.last(F.when(F.col("starts"), F.col("ts_us")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    of_key = Window.partitionBy(*keys).orderBy("chunk")
    chunks = rows.groupBy(*keys, "chunk").agg(F.min("ts_us").alias("first"), F.max("ts_us").alias("last"), F.max("segment").alias("last_segment"), F.min_by(must, F.struct("ts_us", "id")).alias("cut_off"))
    goes_on = F.coalesce(F.col("first") - F.lag("last").over(of_key) < gap_us, F.lit(False)) & ~F.col("cut_off")
    known = F.when(F.col("last_segment") != F.col("first"), F.col("last_segment")).when(~F.col("goes_on"), F.col("first"))
    chunks = chunks.withColumn("goes_on", goes_on).withColumn("known", known)
    begun = F.when(F.col("goes_on"), F.last("known", ignorenulls=True).over(of_key.rowsBetween(Window.unboundedPreceding, -1)))
    crossing = chunks.withColumn("begun", begun).where("goes_on").select(*[F.col(k).alias(f"{k}_") for k in [*keys, "chunk"]], "first", "begun")
    met = rows.join(crossing, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in [*keys, "chunk"]], "left")
    inside = F.col("begun").isNotNull() & (F.col("segment") == F.col("first"))
    return met.select(*keys, "ts_us", "id", F.when(inside, F.col("begun")).otherwise(F.col("segment")).alias("segment"), (F.col("starts") & ~inside).alias("starts"))


def _folded(gap_us: int):
    """mapInArrow function: rows in order with starts and ts_us as their last columns, to those kept."""
    import pyarrow as pa

    def fold(batches):
        last = 0
        for batch in batches:
            kept = []
            for first, ts in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                keep = first or ts - last >= gap_us
                last = ts if keep else last
                kept.append(keep)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return fold


def kept_with_gap(alerts: DataFrame, keys: list[str], gap_s: int, longest: int = LONGEST, forced: str | None = None) -> DataFrame:
    """Alerts (keys, ts_us, id) at least gap_s after the last one kept of their key; of equal times the least id.

    forced names a boolean column: such rows are kept whatever came before, and the gap counts from them. They have times of their own.

    A lag can't say this, as what is kept depends on what was kept before. But a row that comes at least the gap after the row before it is
    always kept, so a key's timeline falls into segments that are folded apart, row by row in bounded memory. Segments of more than
    `longest` rows go by pointers of doubling length instead. Alerts without a time are kept.
    """
    rows = alerts.select(*keys, "ts_us", "id")
    if gap_s <= 0:
        return rows
    gap_us, by = gap_s * 1_000_000, [*keys, "segment"]
    timed = cut(segments(alerts.select(*keys, "ts_us", "id", *([forced] if forced else [])).where("ts_us is not null"), keys, gap_us, forced), "alert-segments")
    kept = []
    if timed.count() > longest:
        long_ones = cut(timed.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > longest).select(*[F.col(k).alias(f"{k}_") for k in by]), "long-segments")
        if not long_ones.isEmpty():
            same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in by]
            kept.append(_doubled(timed.join(long_ones, same, "left_semi"), by, gap_us).select(*keys, "ts_us", "id"))
            timed = timed.join(long_ones, same, "left_anti")
    shape = timed.select(*keys, "id", "starts", "ts_us")
    ordered = timed.repartition(*by).sortWithinPartitions(*by, "ts_us", F.desc("starts"), "id").select(*shape.columns)
    kept.append(ordered.mapInArrow(_folded(gap_us), shape.schema).select(*keys, "ts_us", "id"))
    kept.append(rows.where("ts_us is null"))
    return reduce(DataFrame.union, kept)


def cooled_down(alerts: DataFrame, gap_s: int = LIMITS.cooldown_s) -> DataFrame:
    return kept_with_gap(alerts, ["wallet"], gap_s)


def suppressed(alerts: DataFrame, gap_s: int = LIMITS.duplicate_s) -> DataFrame:
    return kept_with_gap(alerts, ["wallet", "type"], gap_s)


def earliest_per_minute(alerts: DataFrame) -> DataFrame:
    """Of alerts of one wallet, type and minute, the earliest."""
    w = Window.partitionBy("wallet", "type", "minute").orderBy("ts", "id")
    return alerts.withColumn("minute", F.date_trunc("minute", "ts")).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def not_yet_known(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming alerts whose (wallet, type, minute) no existing alert has."""
    key = ["wallet", "type", "minute"]
    minute = lambda d: d.withColumn("minute", F.date_trunc("minute", "ts"))
    return minute(incoming).join(minute(existing).select(key).distinct(), key, "left_anti")


def watch_alerts(snapshots: DataFrame, cooldown_s: int = LIMITS.cooldown_s, duplicate_s: int = LIMITS.duplicate_s) -> DataFrame:
    """Watch-list events with their alerts, of ordered snapshots (wallet, at_us, eligible, changed): wallet, at_us, event,
    check_count, should_alert, type, recorded, alert_count.

    A wallet that is put on the list alerts at once (`new_watched`); one that stays and has changed alerts (`activity`) if no recorded
    alert of its own is less than cooldown_s old. An alert is recorded unless one of its wallet and type was less than duplicate_s
    before; alert_count are those recorded since the wallet was put on the list. Times of a wallet are distinct; null eligible or
    changed count as false. The fold of kept_with_gap, from which the new ones' times can't be missing.
    """
    s = snapshots.select("wallet", F.col("at_us").alias("at"), F.coalesce("eligible", F.lit(False)).alias("eligible"), F.coalesce("changed", F.lit(False)).alias("changed"))
    events = cut(watch_transitions(s, ["changed"]).withColumn("id", F.monotonically_increasing_id()).withColumnRenamed("at", "ts_us"), "watch-events")
    added = events.where("event = 'insert'").select("wallet", "ts_us", "id")
    fresh = cut(kept_with_gap(added, ["wallet"], duplicate_s).withColumn("is_new", F.lit(True)), "new-watched")
    active = events.where("event = 'update' and changed").select("wallet", "ts_us", "id", F.lit(False).alias("is_new"))
    recorded = kept_with_gap(fresh.unionByName(active), ["wallet"], cooldown_s, forced="is_new").select("id", F.lit(True).alias("recorded"))
    out = events.join(cut(recorded, "watch-recorded"), "id", "left").withColumn("recorded", F.coalesce("recorded", F.lit(False)))
    kind = F.when(F.col("event") == "insert", "new_watched").when(F.col("recorded"), "activity")
    run = Window.partitionBy("wallet", "starts").orderBy("ts_us").rowsBetween(Window.unboundedPreceding, 0)
    count = F.when(F.col("event") != "delete", F.sum(F.col("recorded").cast("long")).over(run)).otherwise(0)
    return out.select("wallet", F.col("ts_us").alias("at_us"), "event", "check_count", kind.isNotNull().alias("should_alert"), kind.alias("type"), "recorded", count.alias("alert_count"))


def last_alerts(alerts: DataFrame, kept: int = LIMITS.alerts_kept) -> DataFrame:
    """The newest recorded alerts (a top-k report)."""
    return alerts.where("recorded").orderBy(F.desc("at_us"), "wallet").limit(kept)


def watch_transitions(snapshots: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Watch-list events of each wallet over ordered snapshots (wallet, at, eligible): insert, update, delete, with check counts.

    A run of eligible snapshots inserts at its first and updates at later ones; the first ineligible one deletes. The state
    at a snapshot follows from the one before, so windows suffice.
    """
    w = Window.partitionBy("wallet").orderBy("at")
    before = F.coalesce(F.lag("eligible").over(w), F.lit(False))
    s = snapshots.withColumn("before", before).withColumn("starts", F.sum((F.col("eligible") & ~F.col("before")).cast("int")).over(w))
    event = F.when(F.col("eligible") & ~F.col("before"), "insert").when(F.col("eligible"), "update").when(F.col("before"), "delete")
    run = Window.partitionBy("wallet", "starts").orderBy("at")
    s = s.withColumn("event", event).withColumn("check_count", F.when(F.col("eligible"), F.row_number().over(run)).otherwise(0).cast("long"))
    return s.where("event is not null").select("wallet", "at", "event", "check_count", *([*carry, "starts"] if carry else []))

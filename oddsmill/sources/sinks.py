"""Writers: upsert, replacement of children, history, report documents, and the body of a streaming upsert."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .keyed_table import KeyedTable


def upserted(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of new put in place of those with equal keys; columns that new lacks are null."""
    return current.join(new.select(keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def replaced_children(current: DataFrame, new: DataFrame, parent: list[str]) -> DataFrame:
    """current with all rows of the parents in new replaced by new's."""
    return current.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new)


def unwatched(whales: DataFrame, active: DataFrame, key: str = "wallet") -> DataFrame:
    """is_watched false wherever a wallet isn't active."""
    flags = active.select(key).distinct().withColumn("on_", F.lit(True))
    return whales.join(flags, key, "left").withColumn("is_watched", F.col("is_watched") & F.coalesce("on_", F.lit(False))).drop("on_")


def marked_read(alerts: DataFrame, alert_id: int) -> DataFrame:
    return alerts.withColumn("is_read", F.col("is_read") | (F.col("id") == alert_id))


def report_document(header: dict[str, str], rows: DataFrame, name: str, top: int = 1000, order: list | None = None) -> DataFrame:
    """One row, one column: the JSON text of a header, the count of all rows and the first `top` of them.

    They are the first by order, or by all columns that can be sorted. write_report writes all rows.
    """
    order = order or [f.name for f in rows.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    picked = rows.orderBy(*order).limit(top).select(F.struct("*").alias("r"))
    listed = picked.agg(F.collect_list("r").alias(name))
    return listed.crossJoin(rows.agg(F.count("*").alias("count"))).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in header.items()], "count", name)).alias("value"))


def write_report(header: dict[str, str], rows: DataFrame, name: str, path: str) -> None:
    """All rows as JSON lines in the folder path/name, written by the executors; the header with their count in path/header."""
    spark = rows.sparkSession
    rows.write.option("ignoreNullFields", "true").json(f"{path}/{name}")
    count = spark.read.text(f"{path}/{name}").count()
    spark.createDataFrame([(json.dumps(header | {"count": count}),)], "value string").coalesce(1).write.text(f"{path}/header")


# Sections of a monitor report that count as opportunities, that are reviewed, and that have totals of their own.
TOTALLED, REVIEWED = ("pair_cost", "cross_market", "market_making"), ("pair_cost", "cross_market")
OWN_TOTALS = {"whale": "active_whales", "news": "news_signals", "correlation": "correlation_signals", "market_making": "market_making_opportunities"}


def write_monitor_report(header: dict[str, str], sections: dict[str, DataFrame], path: str) -> None:
    """One report of several scans: each section's rows as JSON lines in path/section, and in path/header their counts and totals.

    A section's rows that have a column `approved` are counted by it too. The totals: opportunities are the rows of the sections in
    TOTALLED, approved ones those in REVIEWED; each other section has a total of its own.
    """
    spark = next(iter(sections.values())).sparkSession
    summary: dict = {}
    for name, rows in sections.items():
        rows.write.option("ignoreNullFields", "true").json(f"{path}/{name}")
        lines = spark.read.schema("approved boolean").json(f"{path}/{name}")
        n = lines.agg(F.count("*").alias("count"), F.count_if("approved").alias("approved")).first()
        summary[name] = {"count": n["count"], "approved_count": n["approved"]}
    count = lambda name, what="count": summary.get(name, {}).get(what, 0)
    totals = {"total_opportunities": sum(count(s) for s in TOTALLED), "approved_opportunities": sum(count(s, "approved_count") for s in REVIEWED)}
    totals |= {total: count(s) for s, total in OWN_TOTALS.items()}
    spark.createDataFrame([(json.dumps(header | summary | {"summary": totals}),)], "value string").coalesce(1).write.text(f"{path}/header")


def append_history(rows: DataFrame, watched: DataFrame, path: str, key: str = "wallet") -> None:
    """Appends the rows of watched keys to a history table; what is there is never rewritten."""
    rows.join(watched.select(key).distinct(), key, "left_semi").write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A keyed table's rows; none if it was never written or can't be read."""
    return KeyedTable(spark, path).read(schema)


def write_state(rows: DataFrame, path: str, keys: list[str], order: list[str] | None = None, batch: int | None = None, writer: str = "") -> bool:
    """Upserts rows into the keyed table at path, see KeyedTable: the last write wins, or the greatest by order."""
    return KeyedTable(rows.sparkSession, path).upsert(rows, keys, order, batch, writer)


def write_children(rows: DataFrame, path: str, parent: list[str], batch: int | None = None, writer: str = "") -> bool:
    """Replaces all child rows of the parents in rows in the keyed table at path."""
    return KeyedTable(rows.sparkSession, path).replace_children(rows, parent, batch, writer)


def upsert_batch(path: str, keys: list[str], order: list[str] | None = None, writer: str = "stream", children: bool = False):
    """A foreachBatch function that puts each micro-batch into the keyed table at path, once: by key, or as a parent's children."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if children:
            write_children(batch, path, keys, batch_id, writer)
        else:
            write_state(batch, path, keys, order, batch_id, writer)

    return write

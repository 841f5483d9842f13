"""A keyed table in versions: each write leaves what it replaces in place and switches one small file at its end.

Rows are dealt to buckets by their key. A write reads only the buckets that it touches, writes their new contents to a folder of its
own, and then publishes a manifest, which says for each bucket in which folder it lies. Manifests are numbered; one is written
under another name and renamed to its number, which fails if the number is taken, so of two writers that start from the
same version one is refused. A writer that is lost before that leaves the table as it was; running it again gives the same table.

The last write wins: rows of a write replace those of equal keys, whatever their values. With `order`, the greatest by these columns wins
instead, among old and new alike; of equals the new one. Among the rows of one write that share a key, the greatest by order
(by all columns, if there is none) counts. A write with a batch number is skipped if its writer has published that number
or a later one, so a replayed micro-batch changes nothing. A manifest that can't be parsed counts as not written; a table without any
manifest is empty.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import cut, delete, drop_cut

#: Buckets of a new table; manifests whose folders are kept for readers that have begun.
BUCKETS, KEPT = 64, 3
BUCKET = "bucket_"


class LostRace(RuntimeError):
    """Another writer published the version that this one was about to publish."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/manifests")
        if not self.fs.exists(folder):
            return []
        return sorted(int(n) for s in self.fs.listStatus(folder) if (n := s.getPath().getName()).isdigit())

    def _manifest(self, number: int) -> dict | None:
        stream = self.fs.open(self._at(f"{self.path}/manifests/{number:012d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return None

    def latest(self) -> tuple[int, dict]:
        """The number that the next manifest follows, and the newest manifest that can be read."""
        numbers = self._numbers()
        for n in reversed(numbers):
            if (m := self._manifest(n)) is not None:
                return numbers[-1], m
        return (numbers[-1] if numbers else 0), {"buckets": self.buckets, "schema": None, "folders": {}, "batches": {}}

    def _publish(self, number: int, manifest: dict) -> None:
        """The switch: from here on readers see the new version."""
        aside, to = self._at(f"{self.path}/manifests/.{uuid.uuid4().hex}"), self._at(f"{self.path}/manifests/{number:012d}")
        out = self.fs.create(aside)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri() if aside.toUri().getScheme() else self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(aside, to, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            self.fs.delete(aside, False)
            if self.fs.exists(to):
                raise LostRace(f"version {number} of {self.path} was published by another writer") from e
            raise

    def _rows(self, manifest: dict, schema: str, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in manifest["folders"].items() if buckets is None or int(b) in buckets]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def read(self, schema: str | None = None) -> DataFrame:
        """The rows of the newest version; with a schema (DDL), its columns."""
        manifest = self.latest()[1]
        if not (kept := manifest["schema"]):
            return self.spark.createDataFrame([], schema)
        return self._rows(manifest, schema or kept)

    def _put(self, rows: DataFrame, keys: list[str], fold: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None, writer: str) -> bool:
        number, manifest = self.latest()
        if batch is not None and manifest["batches"].get(writer, -1) >= batch:
            return False
        bucket = F.pmod(F.xxhash64(*keys), F.lit(manifest["buckets"])).cast("int")
        new = cut(rows.withColumn(BUCKET, bucket), "keyed-rows")
        touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # a row for each bucket
        if touched:
            old = self._rows(manifest, manifest["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), touched)
            after = fold(old, new.drop(BUCKET))
            folder = f"data/{number + 1:012d}-{uuid.uuid4().hex[:8]}"
            after.withColumn(BUCKET, bucket).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            filled = {b for b in touched if self.fs.exists(self._at(f"{self.path}/{folder}/{BUCKET}={b}"))}
            folders = {b: f for b, f in manifest["folders"].items() if int(b) not in touched} | {str(b): folder for b in filled}
            manifest = manifest | {"folders": folders, "schema": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in after.schema)}
        drop_cut(new)
        if touched or batch is not None:
            batches = manifest["batches"] | ({writer: batch} if batch is not None else {})
            self._publish(number + 1, manifest | {"batches": batches})
            self.forget(KEPT)
        return True

    def upsert(self, rows: DataFrame, keys: list[str], order: list[str] | None = None, batch: int | None = None, writer: str = "") -> bool:
        """Puts rows in place of those of equal keys; columns that they lack are null. False if the batch was there already."""

        def fold(old: DataFrame, new: DataFrame) -> DataFrame:
            names = [f.name for f in new.schema if "map<" not in f.dataType.simpleString()]
            new = newest(new, keys, order or [n for n in names if n not in keys])
            both = old.withColumn("new_", F.lit(0)).unionByName(new.withColumn("new_", F.lit(1)), allowMissingColumns=True)
            return newest(both, keys, [*(order or []), "new_"]).drop("new_")

        return self._put(rows, keys, fold, batch, writer)

    def replace_children(self, rows: DataFrame, parent: list[str], batch: int | None = None, writer: str = "") -> bool:
        """Puts rows in place of all rows of their parents; rows of other parents stay."""
        fold = lambda old, new: old.join(new.select(parent).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)
        return self._put(rows, parent, fold, batch, writer)

    def forget(self, kept: int) -> None:
        """Deletes all but the last manifests, and the folders that only those name."""
        numbers = self._numbers()
        gone, stay = numbers[:-kept], numbers[-kept:]
        named = lambda ns: {(f, b) for n in ns for b, f in ((self._manifest(n) or {}).get("folders") or {}).items()}
        for folder, b in named(gone) - named(stay):
            delete(self.spark, f"{self.path}/{folder}/{BUCKET}={b}")
        for n in gone:
            delete(self.spark, f"{self.path}/manifests/{n:012d}")


def newest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the greatest by order, nulls least."""
    by = F.struct(*[x for o in order for x in (F.col(o).isNotNull(), F.col(o))]) if order else F.lit(0)
    return rows.groupBy(*[F.col(k).alias(f"key {k}") for k in keys]).agg(F.max_by(F.struct("*"), by).alias("row")).select("row.*")

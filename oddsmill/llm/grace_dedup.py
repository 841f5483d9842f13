"""Exact de-duplication by Grace hashing.

1. Each scan task collapses its own copies in an open-addressing table, so a group of copies of any size sends
   on one record a task at most; the records (text on leaders only) go to a scratch table.
2. Leaders are dealt out by content hash. A task streams them through a table that compares complete content;
   once the table is full, contents that it lacks are split by further hash bits into spill files of the task's
   own, again and again, until a bucket fits. Spill files live in the task's temporary folder and go with the
   task; a lost task begins anew.
3. Rows join their leader's verdict. Leaders are spread evenly, so no key is hot.

Null text counts as empty. Of equal texts the row with the largest id stays (null ids are smallest; of repeated
rows with one id, one stays). An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hashed, small_batches

RECORDS = "uid long, doc_id long, leader long, sha binary, n long, top long, top_uid long, content binary"
VERDICTS = "leader long, keep_id long, keep_uid long, group_size long"
#: Bytes of distinct content in one table, and ways of one split.
TABLE_BYTES, WAYS = 48 << 20, 16


class ContentTable:
    """Open addressing with linear probing; equal means equal in every byte."""

    def __init__(self):
        self.slots, self.mask, self.hashes, self.contents, self.bytes = [-1] * 64, 63, [], [], 0

    def _probe(self, h: int, content: bytes) -> tuple[int, int]:
        """Slot and entry of this content; entry -1 if it isn't here, with the slot where it would go."""
        i = h & self.mask
        while (j := self.slots[i]) >= 0 and (self.hashes[j] != h or self.contents[j] != content):
            i = (i + 1) & self.mask
        return i, j

    def find(self, h: int, content: bytes) -> int:
        return self._probe(h, content)[1]

    def place(self, h: int, content: bytes) -> tuple[int, bool]:
        """The entry of this content, and if it is new."""
        i, j = self._probe(h, content)
        if j >= 0:
            return j, False
        self.slots[i] = j = len(self.hashes)
        self.hashes.append(h)
        self.contents.append(content)
        self.bytes += len(content) + 64
        if 2 * (j + 1) > self.mask:
            self._grow()
        return j, True

    def _grow(self) -> None:
        self.mask = 4 * (self.mask + 1) - 1
        self.slots = [-1] * (self.mask + 1)
        for j, h in enumerate(self.hashes):
            i = h & self.mask
            while self.slots[i] >= 0:
                i = (i + 1) & self.mask
            self.slots[i] = j


def _hash(sha: bytes) -> int:
    return int.from_bytes(sha[:8], "little")


def _older(a: tuple, b: tuple) -> bool:
    """If a is beyond b in (id, uid), null ids first."""
    return (a[0] is not None, a[0] or 0, a[1]) > (b[0] is not None, b[0] or 0, b[1])


def collapse(batches):
    """Rows (uid, doc_id, content) to records: members name their leader, leaders carry content and counts."""
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("leader", pa.int64()), ("sha", pa.binary()), ("n", pa.int64()), ("top", pa.int64()), ("top_uid", pa.int64()), ("content", pa.binary())])

    def leaders(table: ContentTable, heads: list):
        for at in range(0, len(heads), 256):
            some = heads[at : at + 256]
            yield pa.RecordBatch.from_pylist([dict(uid=u, doc_id=d, leader=u, sha=s, n=n, top=t[0], top_uid=t[1], content=c) for (u, d, s, n, t), c in zip(some, table.contents[at : at + 256], strict=True)], schema=schema)

    table, heads = ContentTable(), []
    for batch in batches:
        members = []
        for uid, doc_id, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sha = hashlib.sha256(content).digest()
            j, new = table.place(_hash(sha), content)
            if new:
                heads.append([uid, doc_id, sha, 1, (doc_id, uid)])
            else:
                head = heads[j]
                head[3] += 1
                if _older((doc_id, uid), head[4]):
                    head[4] = (doc_id, uid)
                members.append(dict(uid=uid, doc_id=doc_id, leader=head[0], sha=sha))
        if members:
            yield pa.RecordBatch.from_pylist(members, schema=schema)
        if table.bytes > TABLE_BYTES:
            yield from leaders(table, heads)
            table, heads = ContentTable(), []
    yield from leaders(table, heads)


class Decided:
    """An open table and the groups of its contents; leaders are kept as numbers."""

    def __init__(self):
        self.table, self.sizes, self.tops, self.leaders, self.group_of = ContentTable(), [], [], array("q"), array("q")

    def full(self, table_bytes: int) -> bool:
        return self.table.bytes >= table_bytes

    def meet(self, leader: int, sha: bytes, n: int, top, top_uid, content: bytes, open_: bool) -> bool:
        """Adds a record whose content is here, or any record if open_; False leaves it to the caller."""
        j = self.table.find(_hash(sha), content)
        if j < 0:
            if not open_:
                return False
            j = self.table.place(_hash(sha), content)[0]
            self.sizes.append(0)
            self.tops.append((top, top_uid))
        self.sizes[j] += n
        if _older((top, top_uid), self.tops[j]):
            self.tops[j] = (top, top_uid)
        self.leaders.append(leader)
        self.group_of.append(j)
        return True

    def verdicts(self):
        for at in range(0, len(self.leaders), 4096):
            groups = self.group_of[at : at + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(self.leaders[at : at + 4096], pa.int64()), pa.array([self.tops[j][0] for j in groups], pa.int64()), pa.array([self.tops[j][1] for j in groups], pa.int64()), pa.array([self.sizes[j] for j in groups], pa.int64())], names=["leader", "keep_id", "keep_uid", "group_size"])


def grace(batches, table_bytes: int = TABLE_BYTES, ways: int = WAYS, depth: int = 0):
    """Verdicts of a stream of leader records.

    Records go to an open table while it has room. When it is full, records whose content it holds still meet it there; others
    go to spill files by further hash bits, and each of these is a stream of its own. Only distinct contents are held, so copies
    of one content, however many tasks sent them, need no more memory than one; every stream settles a table's worth at least.
    """
    held, writers = Decided(), {}
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for batch in batches:
            others: dict[int, list[int]] = {}
            open_ = not held.full(table_bytes)
            for i, (leader, sha, n, top, top_uid, content) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if held.meet(leader, sha, n, top, top_uid, content, open_):
                    open_ = open_ and not held.full(table_bytes)
                else:
                    others.setdefault(_way(sha, depth, ways), []).append(i)
            for way, rows in others.items():
                if way not in writers:
                    writers[way] = pa.ipc.new_stream(f"{folder}/{way}", batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                writers[way].write_batch(batch.take(pa.array(rows)))
        for writer in writers.values():
            writer.close()
        yield from held.verdicts()
        del held
        for way in sorted(writers):
            with pa.OSFile(f"{folder}/{way}") as f, pa.ipc.open_stream(f) as reader:
                yield from grace(reader, table_bytes, ways, depth + 1)
            os.remove(f"{folder}/{way}")


def _way(sha: bytes, depth: int, ways: int) -> int:
    """The spill file of a content: each depth looks at another byte of its hash, beyond those that place it in a table."""
    return sha[8 + depth % 24] % ways


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: uid (unique), doc_id, text_sha256, keep_id, group_size, kept."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("content"))
    records = cut(rows.mapInArrow(collapse, RECORDS), "grace-records")
    leaders = records.where("n is not null").select("leader", "sha", "n", "top", "top_uid", "content")
    verdicts = leaders.repartition("sha").mapInArrow(lambda batches: grace(batches), VERDICTS)
    return records.select("uid", "doc_id", "leader", "sha").join(verdicts, "leader").select("uid", "doc_id", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size", (F.col("uid") == F.col("keep_uid")).alias("kept"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts (null counts as empty), the row with the largest id.

    Of rows that repeat id and text, one stays; null ids are smallest; an empty table stays empty; columns may have any names.
    """
    # one key that is never null: then rows are dealt once, for the join and for what drops repeated rows
    key = lambda i, sha: F.concat_ws(":", F.coalesce(F.col(i).cast("long").cast("string"), F.lit("null")), sha).alias("key")
    stay = cut(exact_dedup(docs, id_col, text_col).where("kept").select(key("doc_id", F.col("text_sha256"))), "kept")
    rows = docs.select(F.struct("*").alias("row"), key(id_col, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    return rows.join(hashed(stay, stay.count()), "key", "left_semi").dropDuplicates(["key"]).select("row.*")

"""Packing documents into fixed windows by the online sum-of-squares rule.

Each scan task tokenises its documents and packs them at once, without a shuffle. A document longer than the window
fills whole windows first; what remains goes to the fill level h that minimises the sum over levels of the squared
count of windows at that level, with counts in a level array (ties: the fullest level). When a task has more open
windows than it may hold, and at its end, the open windows are settled: the fullest take cut pieces from the emptiest
until all but one are full. The last one is cut into power-of-two windows, which need no padding.

Every id lies in exactly one piece; a window's pieces are gapless from 0. Null text counts as empty and yields the end id
alone; repeated rows are packed each; an empty table gives an empty result; other columns are ignored. Window numbers
hold the task's number in the upper bits, so a lost task that runs again gives the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, tokenizer

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, token_bytes binary"
WINDOW, END_ID, MOST_OPEN = 4096, 2, 2048


class Packer:
    """Sum-of-squares state of one task. A piece is [doc_id, start, ids as bytes, doc_tokens]."""

    def __init__(self, window: int = WINDOW, first_id: int = 0, most_open: int = MOST_OPEN):
        self.window, self.next_id, self.most_open = window, first_id, most_open
        self.counts = np.zeros(window + 1, np.int64)  # the level array
        self.open: list[list] = [[] for _ in range(window + 1)]
        self.n_open, self.done = 0, []

    def _close(self, pieces: list) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.done.append((doc_id, start, len(ids) // 4, total, self.next_id, offset, ids))
            offset += len(ids) // 4
        self.next_id += 1

    def _put(self, level: int, pieces: list) -> None:
        self.counts[level] += 1
        self.open[level].append(pieces)
        self.n_open += 1

    def _take(self, level: int) -> list:
        self.counts[level] -= 1
        self.n_open -= 1
        return self.open[level].pop()

    def level_for(self, size: int) -> int:
        """The level whose choice leaves the least sum of squared counts; 0 opens a window."""
        n, c = self.counts, self.window
        levels = np.flatnonzero(n[1 : c - size + 1]) + 1
        best, cost = 0, 2 * n[size] + 1 if size < c else 0
        if len(levels):
            change = 1 - 2 * n[levels] + np.where(levels + size < c, 2 * n[levels + size] + 1, 0)
            i = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= cost:
                best = int(levels[i])
        return best

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) - len(ids) % step
        for at in range(0, whole, step):
            self._close([[doc_id, at // 4, ids[at : at + step], total]])
        if whole == len(ids):
            return
        piece, size = [doc_id, whole // 4, ids[whole:], total], (len(ids) - whole) // 4
        level = self.level_for(size)
        pieces = self._take(level) if level else []
        pieces.append(piece)
        if level + size == self.window:
            self._close(pieces)
        else:
            self._put(level + size, pieces)
            if self.n_open > self.most_open:
                self.settle()

    def settle(self) -> None:
        """Moves and cuts pieces from the emptiest open windows into the fullest; at most one stays open."""
        todo = [[level, w] for level in range(1, self.window) for w in self.open[level]]
        self.counts[:] = 0
        self.open, self.n_open = [[] for _ in range(self.window + 1)], 0
        low, high = 0, len(todo) - 1
        while low < high:
            fill, pieces = todo[high]
            while fill < self.window and low < high:
                giver = todo[low]
                last, room = giver[1][-1], self.window - fill
                size = len(last[2]) // 4
                if size <= room:
                    pieces.append(giver[1].pop())
                else:
                    pieces.append([last[0], last[1] + size - room, last[2][-4 * room :], last[3]])
                    last[2], size = last[2][: -4 * room], room
                fill, giver[0] = fill + size, giver[0] - size
                if not giver[1]:
                    low += 1
            if fill < self.window:
                todo[high][0] = fill
                break
            self._close(pieces)
            high -= 1
        if low <= high and todo[high][1]:
            self._put(todo[high][0], todo[high][1])

    def finish(self) -> None:
        """Settles, then cuts the last window into power-of-two ones."""
        self.settle()
        for level in np.flatnonzero(self.counts[: self.window]):
            pieces, left = self._take(int(level)), int(level)
            while left:
                size = room = 1 << (left.bit_length() - 1)
                part = []
                while room:
                    first = pieces[0]
                    n = len(first[2]) // 4
                    if n <= room:
                        part.append(pieces.pop(0))
                    else:
                        part.append([first[0], first[1], first[2][: 4 * room], first[3]])
                        first[1], first[2], n = first[1] + room, first[2][4 * room :], room
                    room -= n
                self._close(part)
                left -= size


def packer(tokenizer_file: str, window: int, end_id: int):
    """mapInArrow function: (doc_id, text) to PIECES."""

    def batch_of(rows: list) -> pa.RecordBatch:
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "token_bytes"])

    def pack(batches):
        from pyspark import TaskContext

        state, encode = Packer(window, TaskContext.get().partitionId() << 32), tokenizer(tokenizer_file)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), strict=True):
                state.add(doc_id, ids + end)
                if len(state.done) >= 1024:
                    yield batch_of(state.done)
                    state.done = []
        state.finish()
        if state.done:
            yield batch_of(state.done)

    return pack


def pack_documents(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: where each starts in its document and lies in its window, with its ids.

    token_bytes holds the piece's ids as little-endian unsigned 32-bit integers.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(packer(tokenizer_file, window, end_id), PIECES)

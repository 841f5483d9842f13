"""Nearest neighbours by largest inner product, with additive quantisation.

A vector is coded as the sum of one word from each of several full-dimensional codebooks. Codebooks begin as residual
k-means on a bounded sample (SAMPLE rows with the least id hashes), then alternate beam-search encoding with joint least
squares. All vectors are encoded by beam search and kept with the length of what the code leaves over (miss). Lengths are measured
in the sample's median; vectors longer than FAR of them teach nothing, are shortened to be coded, and lie in a cell that all queries probe.

Codes are dealt to cells by their first three words, 4,096 at most whatever the table's size. A query probes cells in the
order of its inner products with these words until they hold a share of all codes, SCAN of them at least. The share is measured:
it is the least one in which NEAR of the true neighbours of PROBED rows of the sample are found. Clustered tables need few
cells; where vectors spread evenly over all directions, nearly all must be looked at, and then work grows as rows times queries.
Cells next to each other form packs of about PACK codes, a larger cell several; queries with like best cells form blocks of
about BLOCK. A block meets the packs that its queries probe, one after the other, dealt over STRIPES tasks at most; codes
are scored by look-ups of a query's inner products with the words (two words of 16 to a byte). A true product differs from a code's by
the product of the query's length and the miss at most. So the KEPT best codes of a pack are measured first, on the original vectors in
double precision, and after them every code that may still be among the best so far: of what is probed nothing is lost, however
coarse the codes are. A stripe returns a query's k + 1 best with their exact scores.

Only one row of each distinct vector, that with the least id, is coded and scored, so that copies take no places from
others; the best are expanded to the ids of their copies at the end. Ties go to the smaller id. Vectors null, zero, holding null or
non-finite components, or of another dimension than the most common one take no part. Rows that repeat an id
count once, with the least vector; a row is never its own id's candidate. Tables smaller than k give all candidates; empty ones an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, cut, spread

BOOKS, WORDS, BEAM, SAMPLE = 48, 16, 4, 8192
#: Codes of a pack that a query measures first, codes in a pack, queries in a block, tasks that a block's packs are dealt to.
KEPT, PACK, BLOCK, STRIPES = 200, 16_384, 1024, 16
#: Bytes of vectors in a pack at most; the length, in medians, of vectors that are always probed.
PACK_BYTES, FAR = 4 << 20, 4.0
#: Words that name a cell; codes that a query looks at, at least; sample rows whose neighbours must lie in what is probed, and
#: the part of them that must.
NAMED, SCAN, PROBED, NEAR = 3, 16_384, 256, 0.99
#: Parts that a group of equal vectors is dealt to before its least ids are known.
PARTS = 32


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes (n, books) of vectors: per book, the best `beam` continuations of all kept partial sums."""
    n, d = x.shape
    m, k, _ = books.shape
    out = np.empty((n, m), np.uint8)
    norms = (books**2).sum(2)
    for at in range(0, n, 512):
        part = x[at : at + 512]
        rest, codes = part[:, None, :], np.zeros((len(part), 1, 0), np.uint8)
        for b in range(m):
            dist = norms[b] - 2 * (rest.reshape(-1, d) @ books[b].T).reshape(len(part), -1, k) + (rest**2).sum(2)[:, :, None]
            flat, keep = dist.reshape(len(part), -1), min(beam if b < m - 1 else 1, dist.shape[1] * k)
            best = np.argpartition(flat, keep - 1, 1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(flat.shape[1]), (len(part), 1))
            from_, word = best // k, best % k
            rows = np.arange(len(part))[:, None]
            codes = np.concatenate([codes[rows, from_], word[:, :, None].astype(np.uint8)], 2)
            rest = rest[rows, from_] - books[b][word]
        out[at : at + 512] = codes[:, 0]
    return out


def fit_books(x: np.ndarray, n_books: int = BOOKS, n_words: int = WORDS, beam: int = BEAM, rounds: int = 2) -> np.ndarray:
    """Codebooks (n_books, n_words, d) for a sample of vectors."""
    rng, x = np.random.default_rng(7), x.astype(np.float32)
    n, d = x.shape
    books, rest = np.zeros((n_books, n_words, d), np.float32), x.copy()
    for b in range(n_books):
        words = rest[rng.choice(n, n_words, replace=n < n_words)].copy()
        for _ in range(6):
            near = ((words**2).sum(1) - 2 * rest @ words.T).argmin(1)
            counts = np.bincount(near, minlength=n_words)
            sums = np.zeros_like(words)
            np.add.at(sums, near, rest)
            words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
        books[b] = words
        rest = rest - words[((words**2).sum(1) - 2 * rest @ words.T).argmin(1)]
    size = n_books * n_words
    for _ in range(rounds):
        cols = beam_encode(x, books, beam).astype(np.int64) + np.arange(n_books) * n_words
        gram, right = np.zeros((size, size), np.float32), np.zeros((size, d), np.float32)
        for i in range(n_books):
            np.add.at(right, cols[:, i], x)
            for j in range(n_books):
                np.add.at(gram, (cols[:, i], cols[:, j]), 1)
        # a small pull towards the words as they are keeps unused ones in place
        pull = np.float32(0.1)
        gram[np.diag_indices(size)] += pull
        books = np.linalg.solve(gram, right + pull * books.reshape(size, d)).reshape(n_books, n_words, d).astype(np.float32)
    return books


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(vec_id, v) of the vectors that take part, as float or double like the input, and their dimension (0 if there's none)."""
    v, kind = F.col("v"), table.schema[vector_col].dataType.elementType.simpleString()
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>").alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.where(F.size("v") == common["d"]), common["d"]) if common else (rows, 0)


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean norms, of doubles of any size."""
    most = np.abs(x).max(1, initial=0.0)
    unit = np.where(most > 0, most, 1.0)
    return most * np.sqrt(((x / unit[:, None]) ** 2).sum(1))


def _doubles(column, rows: int, scale: float) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(rows, -1) / scale


def shortened(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Vectors for coding: none is longer than FAR, so that squares fit."""
    return (x * np.minimum(1.0, FAR / np.maximum(size, FAR))[:, None]).astype(np.float32)


def cells_of(codes: np.ndarray) -> np.ndarray:
    return codes[:, :NAMED].astype(np.int64) @ (WORDS ** np.arange(NAMED))[::-1]


def encoded(x: np.ndarray, books: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells (the last is that of far vectors), codes, misses and lengths. A miss allows for the rounding of sums of words."""
    size = lengths(x)
    codes = beam_encode(shortened(x, size), books, beam)
    words = [books[b][codes[:, b]].astype(np.float64) for b in range(len(books))]
    miss = lengths(x - sum(words)) + 6e-8 * (x.shape[1] + len(books)) * sum(lengths(w) for w in words)
    return np.where(size > FAR, WORDS**NAMED, cells_of(codes)), codes, np.nan_to_num(miss, nan=np.inf), size


def encoder(books: np.ndarray, beam: int, scale: float):
    """mapInArrow function: (vec_id, v) to (vec_id, cell, code, miss, size, v as bytes); a code has two words in a byte."""

    def encode(batches):
        for batch in batches:
            raw = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            cells, codes, miss, size = encoded(_doubles(batch.column(1), batch.num_rows, scale), books, beam)
            packed = codes[:, ::2] * np.uint8(WORDS) + codes[:, 1::2]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "cell": pa.array(cells.astype(np.int32)), "code": pa.array([c.tobytes() for c in packed], pa.binary()), "miss": pa.array(miss), "size": pa.array(size), "v": pa.array([r.tobytes() for r in raw], pa.binary())})

    return encode


def dealt(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Groups of about `most` of things in order: the first group of each, and how many it takes by itself if it is larger."""
    first, groups, at, held = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // most)), 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            at, held = at + 1, 0
        first[i], held = at, held + n
        if n > most:
            at, held = at + int(groups[i]), 0
    return first, groups


class Cells:
    """The order in which a query probes cells, and how far it goes."""

    def __init__(self, counts: np.ndarray, books: np.ndarray, metric: str):
        self.counts, self.books, self.metric, self.share, self.scan = counts, books[:NAMED], metric, 1.0, SCAN
        self.near = counts[:-1]  # all but the far vectors' cell
        self.norms = (self._sums(list(self.books)) ** 2).sum(1) if metric == "l2" else None

    @staticmethod
    def _sums(tables: list[np.ndarray]) -> np.ndarray:
        """(cells, ...) from one (words, ...) table for each naming word."""
        out = tables[0]
        for t in tables[1:]:
            out = (out[:, None] + t[None]).reshape(-1, *out.shape[1:])
        return out

    def order(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cells by liking, and the share of all codes but far vectors' in them so far."""
        s = self._sums([b @ q.T for b in self.books]).T
        if self.norms is not None:
            s = 2 * s - self.norms
        order = np.argsort(-s, axis=1, kind="stable")
        return order, np.cumsum(self.near[order], axis=1) / max(self.near.sum(), 1)

    def measure(self, x: np.ndarray, cells: np.ndarray, k: int) -> None:
        """Sets the share by which NEAR of the k true neighbours of some rows of a sample are reached; far ones always are."""
        q = x[:PROBED]
        s = q @ x.T if self.metric == "ip" else 2 * q @ x.T - (x**2).sum(1)
        s[np.arange(len(q)), np.arange(len(q))] = -np.inf
        best = cells[np.argsort(-s, axis=1)[:, : min(k, len(x) - 1)]]
        order, seen = self.order(shortened(q, lengths(q)))
        place, far = np.argsort(order, axis=1), best == len(self.near)
        depth = np.where(far, 0.0, np.take_along_axis(seen, np.take_along_axis(place, np.where(far, 0, best), 1), 1))
        self.share = float(np.quantile(depth, NEAR)) if depth.size else 1.0

    def probed(self, q: np.ndarray) -> list[np.ndarray]:
        order, seen = self.order(q)
        share = max(self.share, min(1.0, self.scan / max(self.near.sum(), 1)))
        return [o[: int(np.searchsorted(n, share - 1e-12)) + 1] for o, n in zip(order, seen, strict=True)]


def prober(cells: Cells, first: np.ndarray, groups: np.ndarray, scale: float):
    """mapInArrow function: queries (vec_id, v) to (query_id, home, v as bytes, cells as bits, packs); home is the best cell."""

    def probe(batches):
        for batch in batches:
            raw, q = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1), _doubles(batch.column(1), batch.num_rows, scale)
            out = []
            for query, x, chosen in zip(batch.column(0).to_pylist(), raw, cells.probed(shortened(q, lengths(q))), strict=True):
                bits = np.zeros(len(cells.counts), bool)
                bits[chosen] = bits[-1] = True
                held = np.append(chosen, len(cells.near))
                held = held[cells.counts[held] > 0]
                packs = sorted({int(p) for c in held for p in range(first[c], first[c] + groups[c])})
                out.append((query, int(chosen[0]), x.tobytes(), np.packbits(bits).tobytes(), packs))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "home", "v", "cells", "packs"])

    return probe


def _pack(group):
    import pandas as pd

    group = group.sort_values(["cell", "vec_id"])
    return pd.DataFrame({"pack": group["pack"].iloc[:1].to_numpy(), "ids": [group["vec_id"].to_numpy().astype("<i8").tobytes()], "in_cell": [group["cell"].to_numpy().astype("<i4").tobytes()], "codes": [b"".join(group["code"])], "bounds": [group[["miss", "size"]].to_numpy().astype("<f8").tobytes()], "vectors": [b"".join(group["v"])]})


def measures(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Scores of rows, by sums from the first component to the last, so that they don't depend on how rows were gathered."""
    inner = lambda a: np.cumsum(a, axis=1)[:, -1] + 0.0
    return inner(x * q) if metric == "ip" else 2 * inner(x * q) - inner(x * x) - inner((q * q)[None])


class Question:
    """A query of a block: its look-up table, and the best rows so far with their scores, ties to the smaller id."""

    def __init__(self, v: np.ndarray, cells: np.ndarray, books: np.ndarray, metric: str, most: int, scale: float):
        self.q, self.cells, self.metric, self.most, self.scale = v.astype(np.float64), cells, metric, most, scale
        self.size = float(lengths(self.q[None] / scale)[0])
        p = books @ (self.q / scale / self.size).astype(np.float32)
        self.table = (p[::2, :, None] + p[1::2, None, :]).reshape(len(books) // 2, -1)
        self.s, self.ids = np.zeros(0), np.zeros(0, np.int64)

    def low(self) -> float:
        """The least score that still counts."""
        return self.s[-1] if len(self.s) == self.most else -np.inf

    def reach(self, words: np.ndarray, miss: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The best that rows can score by their codes, and so much more as rounding may take, as scores."""
        s = self.table[0].take(words[0])
        for b in range(1, len(words)):
            s += self.table[b].take(words[b])
        top = (s + miss) * self.size
        if self.metric == "l2":
            top = 2 * top - size**2 - self.size**2 + 1e-9 * (size + self.size) ** 2
        return np.nan_to_num((top + 1e-9 * size * self.size) * self.scale * self.scale, nan=np.inf, posinf=np.inf, neginf=-np.inf)

    def meet(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Measures rows: by a product first, then to the last bit those that it leaves in question."""
        if len(rows) > self.most:
            s = (x @ self.q)[rows] if 2 * len(rows) > len(x) else x[rows] @ self.q
            doubt = 1e-9 * size[rows] * self.size * self.scale * self.scale
            if self.metric == "l2":
                s = 2 * s - (size[rows] * self.scale) ** 2 - (self.size * self.scale) ** 2
                doubt = 1e-9 * ((size[rows] + self.size) * self.scale) ** 2
            low = max(self.low(), np.partition(s - doubt, len(s) - self.most)[len(s) - self.most])
            rows = rows[~(s + doubt < low)]
        s, found = np.concatenate([self.s, measures(x[rows], self.q, self.metric)]), np.concatenate([self.ids, ids[rows]])
        best = np.lexsort((found, -s))[: self.most]
        self.s, self.ids = s[best], found[best]

    def ask(self, words: np.ndarray, in_cell: np.ndarray, miss: np.ndarray, size: np.ndarray, x: np.ndarray, ids: np.ndarray, first: int) -> None:
        """Meets the rows of a pack that can be among the best: the `first` most promising, then what may still be."""
        rows = np.flatnonzero(self.cells[in_cell])
        if not len(rows):
            return
        reach = self.reach(words if len(rows) == len(ids) else words[:, rows], miss[rows], size[rows])
        live = np.flatnonzero(reach >= self.low())
        if len(live) > 2 * first:
            lead = np.argpartition(miss[rows[live]] * self.size * self.scale * self.scale * (2 if self.metric == "l2" else 1) - reach[live], first)[:first]
            self.meet(rows[live[lead]], x, ids, size)
            live = np.delete(live, lead)
            live = live[reach[live] >= self.low()]
        if len(live):
            self.meet(rows[live], x, ids, size)


def scorer(books: np.ndarray, most: int, kept: int, metric: str, scale: float, kind: str):
    """mapInArrow function: rows by block and stripe, queries (kind 0: id, v, cells) before packs (kind 1), to each query's best.

    A task holds one block's queries with their best so far, and one pack.
    """
    m, n_cells = len(books) // 2, WORDS**NAMED + 1

    def closed(held: dict):
        held = {i: h for i, h in held.items() if len(h.s)}
        offsets = np.cumsum([0, *[len(h.s) for h in held.values()]]).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array(-np.concatenate([np.zeros(0), *[h.s for h in held.values()]])), pa.array(np.concatenate([np.zeros(0, np.int64), *[h.ids for h in held.values()]]))], names=["s", "id"])
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["query_id", "found"])

    def score(batches):
        at, held = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                block, stripe, is_pack, query = (batch.column(c)[row].as_py() for c in range(4))
                v, cells, ids, in_cell, codes, bounds, vectors = (batch.column(c)[row].as_buffer() for c in range(4, 11))
                if at != (block, stripe):
                    if held:
                        yield closed(held)
                    at, held = (block, stripe), {}
                if not is_pack:
                    held[query] = Question(np.frombuffer(v, kind), np.unpackbits(np.frombuffer(cells, np.uint8), count=n_cells).astype(bool), books, metric, most, scale)
                    continue
                ids, in_cell = np.frombuffer(ids, "<i8"), np.frombuffer(in_cell, "<i4")
                words = np.frombuffer(codes, np.uint8).reshape(-1, m).T.astype(np.intp)
                miss, size = np.frombuffer(bounds, "<f8").reshape(-1, 2).T
                x = np.frombuffer(vectors, kind).reshape(len(ids), -1).astype(np.float64)
                for h in held.values():
                    h.ask(words, in_cell, miss, size, x, ids, kept)
        if held:
            yield closed(held)

    return score


def copies(rows: DataFrame, kept: int) -> DataFrame:
    """ids: of each distinct vector the `kept` least ids, in order. Parts of a group are cut to as many before they meet."""
    hashed = rows.select(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "vec_id").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)))
    for keys in (["h1", "h2", "part"], ["h1", "h2"]):
        hashed = hashed.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))).where(F.col("rn") <= kept)
    return hashed.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select("ids")


def search(table: DataFrame, is_query: Column, k: int = 20, kept: int = KEPT, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "ip") -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row for which is_query (over vec_id) holds.

    metric "ip" ranks by inner product; "l2" by the squared distance's negative.
    """
    # packs are large rows; all that is in Python is run and written inside
    with batches_of(table.sparkSession, 32):
        return _search(table, is_query, k, kept, id_col, vector_col, metric)


def _search(table: DataFrame, is_query: Column, k: int, kept: int, id_col: str, vector_col: str, metric: str) -> DataFrame:
    spark = table.sparkSession
    rows, d = valid_vectors(table, id_col, vector_col)
    empty = "query_id long, rank int, vec_id long, score double"
    if not d:
        return spark.createDataFrame([], empty)
    rows = cut(rows, "vectors")
    if rows.select("vec_id").distinct().count() < rows.count():
        rows = cut(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    groups = cut(copies(rows, k + 1), "copies")
    one = cut(rows.join(groups.select(F.col("ids")[0].alias("vec_id")), "vec_id", "left_semi").select("vec_id", "v"), "distinct-vectors")
    kind = "<f4" if rows.schema["v"].dataType.elementType.simpleString() == "float" else "<f8"
    sample = one.orderBy(spread("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    x = np.stack(sample["v"]).astype(float)
    size = lengths(x)
    scale = float(np.sort(size)[(len(size) - 1) // 2])
    x, size = x / scale, size / scale
    books = fit_books(x[size <= FAR])
    codes = cut(one.select("vec_id", "v").mapInArrow(encoder(books, BEAM, scale), "vec_id long, cell int, code binary, miss double, size double, v binary"), "codes")
    counts = np.zeros(WORDS**NAMED + 1, np.int64)
    for r in codes.groupBy("cell").count().collect():  # a row for each cell
        counts[r["cell"]] = r["count"]
    cells = Cells(counts, books, metric)
    cells.measure(x, encoded(x, books, BEAM)[0], k)
    deal = lambda first, groups: spark.createDataFrame([(c, int(f), int(g)) for c, (f, g) in enumerate(zip(first, groups, strict=True))], "cell int, first int, groups int")  # noqa: E731  a row for each cell
    part = lambda first, key: (F.col("first") + F.pmod(F.xxhash64(key), "groups")).cast("int")
    first, n_packs = dealt(counts, max(1, min(PACK, PACK_BYTES // (d * np.dtype(kind).itemsize))))
    packs = codes.join(F.broadcast(deal(first, n_packs)), "cell").withColumn("pack", part("first", "vec_id")).select("pack", "cell", "vec_id", "code", "miss", "size", "v")
    packs = packs.groupBy("pack").applyInPandas(_pack, "pack int, ids binary, in_cell binary, codes binary, bounds binary, vectors binary")
    asked = cut(rows.where(is_query).select("vec_id", "v").mapInArrow(prober(cells, first, n_packs, scale), "query_id long, home int, v binary, cells binary, packs array<int>"), "probes")
    homes = np.zeros_like(counts)
    for r in asked.groupBy("home").count().collect():  # a row for each cell
        homes[r["home"]] = r["count"]
    asked = asked.join(F.broadcast(deal(*dealt(homes, BLOCK))), F.col("home") == F.col("cell")).withColumn("block", part("first", "query_id"))
    # a row for each pack that a block looks into
    needed = cut(asked.select("block", F.explode("packs").alias("pack")).distinct().withColumn("stripe", F.col("pack") % STRIPES), "needed")
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    questions = asked.join(needed.select("block", "stripe").distinct(), "block").select("block", "stripe", F.lit(0).alias("kind"), "query_id", "v", F.col("cells"), *none("binary", "ids", "in_cell", "codes", "bounds", "vectors"))
    shipped = packs.join(needed, "pack").select("block", "stripe", F.lit(1).alias("kind"), *none("long", "query_id"), *none("binary", "v", "cells"), "ids", "in_cell", "codes", "bounds", "vectors")
    met = questions.unionByName(shipped).repartition("block", "stripe").sortWithinPartitions("block", "stripe", "kind")
    found = met.mapInArrow(scorer(books, k + 1, kept, metric, scale, kind), "query_id long, found array<struct<s:double,id:long>>")
    with batches_of(spark, 8):  # a pack's vectors have up to PACK_BYTES
        found = cut(found, "found")
    # of a list from each stripe
    best = F.slice(F.sort_array(F.flatten(F.collect_list("found"))), 1, k + 1)
    pairs = found.groupBy("query_id").agg(best.alias("found")).select("query_id", F.explode("found").alias("f"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    # each distinct vector gives an id at least, and one of them may be the query's own
    first = pairs.select("query_id", F.col("f.id").alias("vec_id"), (-F.col("f.s")).alias("score"))
    more = groups.where(F.size("ids") > 1).select(F.col("ids")[0].alias("vec_id"), "ids")
    every = first.join(more, "vec_id", "left").select("query_id", "score", F.explode(F.coalesce("ids", F.array("vec_id"))).alias("vec_id")).where("query_id <> vec_id")
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

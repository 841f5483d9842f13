"""Near-duplicate groups: MinHash with banding, verification on full shingle sets, and large-star/small-star components.

1. Every document becomes its set of distinct word shingles (64-bit hashes). Documents with equal sets fall into one class
   with a number of its own; what follows works on classes, so copies cost nothing more.
2. Universal hashes h -> a * h + b give each class a signature of minima; each band of ROWS of them is a bucket key. There
   are so many bands that a pair at the threshold meets in no bucket with a probability of MISS (48 bands at .85). Buckets
   with the same members (by count, least number and an xor of member hashes) are looked at once.
3. First the pairs that a bucket of up to FEW members has, and in a larger one those of every member with two centres (the
   least number and the least hash): distinct over all bands, dealt by centre in parts, and confirmed one after the other
   on full sets, a task holding no more than the centre's. The hash is of the member alone, so that the many buckets of one group
   share a few centres and pairs grow with members, not with their places in buckets. A tight group of any size becomes one
   component at this cost.
4. Then what is left of larger buckets whose members are still in several components: members outside the bucket's most
   frequent component, in blocks of BLOCK, meet all blocks of the bucket; pairs already joined are skipped, what lies six
   standard deviations below the threshold is rejected by signature, and the rest is confirmed on full sets. This is
   quadratic only in members that resemble neither centre and share a bucket all the same.
5. Components of the links by alternating large-star and small-star until nothing changes; links are written to a scratch
   table each round. No links, labels or hashes go to the driver, only a count and a checksum.

A document with fewer words than a shingle has its whole sequence as one; null, empty or wordless texts have an empty set,
link with nothing and keep themselves. Repeated rows are copies of each other; rows that repeat an id with another text are
judged each by its own text, under that id; null ids take no part and are returned as they are, kept. Very long texts are
whole. Other columns are ignored, whatever their names. An empty table gives an empty result.
"""


from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, hashed, small_batches

#: Hashes in a band, members in a block, and the chance that a pair at the threshold meets in no band.
ROWS, BLOCK, MISS = 7, 512, 1e-8
#: Members of a bucket whose pairs are all looked at at once; pairs of a centre in one part.
FEW, PART = 8, 512
SEED = 20_011
PROFILES = "doc_id long, text_hash long, n_shingles long, digest binary, bands array<long>"


def coefficients(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 2**31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None], rng.integers(0, 2**32, k, dtype=np.uint32)[:, None]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; from a running polynomial over eight-byte blocks of each word."""
    chars = _LOWER[np.frombuffer(data, np.uint8)]
    space = _SPACE[chars]
    edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    padded = np.concatenate([chars, np.zeros(8, np.uint8)])
    size, h = ends - starts, (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    for at in range(0, int(size.max()), 8):
        some = np.flatnonzero(size > at)
        block = words[starts[some] + at].copy().view("<u8")[:, 0]
        keep = np.minimum(size[some] - at, 8).astype(np.uint64)
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * keep)
        h[some] = _mix(h[some] * np.uint64(0x2545F4914F6CDD1D) + block)
    return h


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    w = word_hashes(text.encode("utf-8", "surrogatepass")) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    n = max(len(w) - width + 1, 1)
    h = np.full(n, min(len(w), width), np.uint64)
    for i in range(min(len(w), width)):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + n])
    return np.unique(h)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash function over a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(least, (a * x[None, at : at + 512] + b).min(1), out=least)
    return least


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band, the band's number included."""
    bands = sig.reshape(-1, rows).astype(np.uint64)
    h = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, i])
    return h.view(np.int64)


def profiler(width: int, bands: int, rows: int):
    """mapInArrow function: (doc_id, text_hash, text) to PROFILES."""

    def profile(batches):
        a, b = coefficients(bands * rows)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), width)
                sizes.append(len(s))
                digests.append(digest_of(s) if len(s) else None)
                keys.append(band_keys(signature(s, a, b), rows) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *keys]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=["doc_id", "text_hash", "n_shingles", "digest", "bands"])

    return profile


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def setter(width: int):
    """mapInArrow function: (node, digest, text) to (node, hashes), the set as sorted 64-bit values, where the digest is the set's."""

    def make(batches):
        for batch in batches:
            nodes, sets = [], []
            for node, digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                s = shingle_set(text.as_py(), width)
                if digest_of(s) == digest:
                    nodes.append(node)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "hashes": pa.array(sets, pa.binary())})

    return make


def near(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """If two sorted sets reach the threshold."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    shared = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def confirmer(percent: int):
    """mapInArrow function: (centre, part, is_other, node, hashes) in this order to links (a, b) of centres and others."""

    def confirm(batches):
        at, centre = None, None
        for batch in batches:
            found = []
            for hub, part, other, node, hashes in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
                if not other:
                    at, centre = (hub, part), np.frombuffer(hashes.as_py(), np.uint64)
                elif at == (hub, part) and near(centre, np.frombuffer(hashes.as_buffer(), np.uint64), percent):
                    found.append((hub, node))
            yield pa.RecordBatch.from_pydict({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return confirm


def linker(percent: int, bands: int, rows: int):
    """applyInPandas function: two blocks of a bucket, (node, side, label, hashes), to the links that join their components."""

    def link(block):
        import pandas as pd

        block = block.sort_values(["side", "node"])
        ids, side = block["node"].to_numpy(), block["side"].to_numpy()
        sets = [np.frombuffer(h, np.uint64) for h in block["hashes"]]
        a, b = coefficients(bands * rows)
        sigs = np.stack([signature(s, a, b) for s in sets])
        k, t = bands * rows, percent / 100
        least = k * t - 6 * (k * t * (1 - t)) ** 0.5
        sizes = np.array([len(s) for s in sets])
        group, found = block["label"].to_numpy().copy(), []
        others = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            rest = others[(100 * np.minimum(sizes[i], sizes[others]) >= percent * np.maximum(sizes[i], sizes[others])) & (group[others] != group[i])]
            if len(rest):
                rest = rest[(sigs[rest] == sigs[i]).sum(1) >= least]
            for j in rest:
                if group[i] != group[j] and near(sets[i], sets[j], percent):
                    found.append((ids[i], ids[j]))
                    group[group == group[j]] = group[i]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return link


def components(links: DataFrame) -> DataFrame:
    """(node, component) of undirected links (a, b), by large-star and small-star; component is the least node reachable.

    Least neighbours come from partial aggregates and are written before they are joined: both sides of that join are then
    plain exchanges, and Spark can split the links of a node that has very many.
    """
    edges, before = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links"), None
    while True:
        # large star: strictly larger neighbours link to the least of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")), "least")
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "links")
        # small star: smaller neighbours, and the node, link to the least of them
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lesser, "u").select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        used, edges = edges, cut(small, "links")
        drop_cut(used, least, large)
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def bands_for(percent: int, rows: int = ROWS) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** rows))


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, n, node) of all buckets with two members or more; of buckets with the same members, one."""
    keys = classes.select("node", F.explode("bands").alias("key"))
    members = cut(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "bucket-members")
    buckets = members.groupBy("key").agg(F.min("n").alias("n"), F.min("node").alias("first"), F.bit_xor(F.xxhash64("node")).alias("x"))
    looked_at = cut(buckets.groupBy("n", "first", "x").agg(F.min("key").alias("key")), "buckets")
    out = cut(members.join(looked_at.select("key"), "key"), "members")
    drop_cut(members, looked_at)
    return out


def first_pairs(members: DataFrame) -> DataFrame:
    """Distinct (centre, node): all pairs of buckets up to FEW, and in larger ones every member with two centres."""
    few = members.where(F.col("n") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("all"))
    few = few.select(F.explode("all").alias("centre"), "all").select("centre", F.explode(F.filter("all", lambda x: x > F.col("centre"))).alias("node"))
    large = members.where(F.col("n") > FEW)
    centres = large.groupBy("key").agg(F.min("node").alias("c1"), F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("c2"))
    centres = cut(centres.select("key", F.explode(F.array_distinct(F.array("c1", "c2"))).alias("centre")), "centres")
    starred = large.select("key", "node").join(centres, "key").where("centre <> node").select("centre", "node")
    return few.unionByName(starred).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) among pairs (centre, node), on full sets. A centre's pairs are dealt in parts of about PART."""
    parts = cut(pairs.groupBy("centre").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "parts")
    dealt = pairs.join(parts, "centre").select("centre", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(True).alias("is_other"), "node")
    hubs = parts.select("centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("is_other"), F.col("centre").alias("node"))
    met = dealt.unionByName(hubs).join(sets, "node").select("centre", "part", "is_other", "node", "hashes")
    met = met.repartition("centre", "part").sortWithinPartitions("centre", "part", "is_other")
    return met.mapInArrow(confirmer(percent), "a long, b long")


def rest_pairs(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, lo, hi, side, node, label): blocks of members outside a large bucket's most frequent component, and of all its members."""
    large = cut(members.where(F.col("n") > FEW).join(labels, "node", "left").select("key", "n", "node", F.coalesce("component", "node").alias("label")), "labelled-members")
    by_label = large.groupBy("key", "n", "label").agg(F.count("*").alias("m"))
    open_ = cut(by_label.groupBy("key", "n").agg(F.max(F.struct("m", "label")).alias("top")).where("n > top.m").select("key", F.col("top.label").alias("top"), (F.col("n") - F.col("top.m")).alias("minor")), "open-buckets")
    rows = large.join(open_, "key")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("node"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    minor = rows.where("label <> top").select("key", own("minor").alias("lo"), every("n").alias("hi"), F.lit(0).alias("side"), "node", "label")
    return minor.unionByName(rows.select("key", every("minor").alias("lo"), own("n").alias("hi"), F.lit(1).alias("side"), "node", "label"))


def near_dup_groups(docs: DataFrame, width: int = 5, percent: int = 80, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_hash, n_shingles, component_id (least doc_id reachable), kept.

    Links are pairs with 100 * shared shingles >= percent * all shingles of the two.
    """
    small_batches(docs.sparkSession)
    bands = bands_for(percent, rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    full = cut(texts.mapInArrow(profiler(width, bands, rows), PROFILES), "profiles")
    profiles = cut(full.drop("bands"), "documents")
    in_class = full.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands"))
    classes = cut(in_class.withColumn("node", F.monotonically_increasing_id()), "classes")
    drop_cut(full)
    members = bucket_members(classes)
    wanted = members.select("node").distinct().join(classes.select("node", "digest", "rep"), "node")
    found = texts.select("doc_id", "text").join(hashed(wanted, classes.count()), F.col("doc_id") == F.col("rep")).select("node", "digest", "text")
    sets = cut(found.mapInArrow(setter(width), "node long, hashes binary"), "sets")
    pairs = cut(first_pairs(members), "pairs")
    labels = cut(components(links := cut(confirmed(pairs, sets, percent), "confirmed")), "labels")
    rest = cut(rest_pairs(members, labels), "rest")
    if not rest.isEmpty():
        more = rest.join(sets, "node").groupBy("key", "lo", "hi").applyInPandas(linker(percent, bands, rows), "a long, b long")
        labels = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    drop_cut(pairs, links)
    named = classes.select("digest", "node", "rep").join(labels, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    named = cut(named, "named")
    # a table of its own: then both sides of the last join are plain exchanges, and Spark can split a large class
    labelled = cut(named.join(cut(named.groupBy("component").agg(F.min("rep").alias("component_id")), "components"), "component").select("digest", "component_id"), "labels")
    drop_cut(classes, sets, members, rest)
    out = profiles.join(labelled, "digest", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each near-duplicate group, the least id.

    Of rows with equal id (null too) and text, one stays. Rows that repeat a kept id with another text of the same group stay.
    Null, empty and wordless texts stay; an empty table stays empty. Columns of docs may have any names.
    """
    kept = near_dup_groups(docs, id_col=id_col, text_col=text_col, **settings).where("kept")
    kept = cut(kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("i"), F.col("text_hash").alias("h")), "kept")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null")).alias("i"), F.xxhash64(F.col(text_col)).alias("h"))
    return rows.join(hashed(kept, kept.count()), ["i", "h"], "left_semi").dropDuplicates(["i", "h"]).select("row.*")

"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

A source's weight is a piecewise linear function of training progress t in [0, 1], given by knots. Its integral is
the source's overall weight; the weights share the budget, a source's target stops at `cap` times its size, and the
excess is reshared by weight (water filling, solved in closed form by sorting sources by the level that fills them).
A source's demand up to t is its target times the integral so far; its documents, in a reproducible mixed order, form
a queue that is read again from its front when it ends, and the copy whose first word stands at demand d gets the t at
which demand reaches d. Sorting by t gives the training order.

Running sums over a source go through two levels of hash buckets, so that no task holds a source, however large. Ranks and targets of sources go through windows over all of them in one task, a row of some
hundred bytes for each distinct source: meant for up to some million sources.
Sizes are words. Null or wordless texts have size 0 and are never taken; a null source is a source of its own, last in
order; repeated rows count each; null ids are spread by their text; an empty table gives an empty result. The last copy
that a target reaches is cut to the words that are left of it, so each source's words taken equal its target, rounded down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, ordered_key, spread

#: Share of all words that the mix takes, and the most a source's words may repeat.
SHARE, CAP = 1.5, 2.0
#: Weights by the rank of the source, repeating, and what multiplies them along progress (each has integral 1).
RANK_WEIGHTS = (3.0, 1.0, 2.0)
SHAPES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
#: Buckets of each of the two levels of running sums.
FAN = 128


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def rank_schedule(sources: DataFrame) -> DataFrame:
    """The production curriculum: (skey, knots) for each source by its rank in code point order, null last.

    One row per source passes the ranking window, never documents.
    """
    rank = (F.row_number().over(Window.orderBy("skey")) - 1) % len(RANK_WEIGHTS)
    options = F.array(*[F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w * m).alias("w")) for t, m in shape]) for w, shape in zip(RANK_WEIGHTS, SHAPES, strict=True)])
    return sources.select("skey", F.element_at(options, (rank + 1).cast("int")).alias("knots"))


def integrate(schedule: DataFrame) -> DataFrame:
    """(skey, knots array<struct<t, w>>) to (skey, weight, segments); a segment has its part of the integral before it."""
    a, b = F.col("s.a"), F.col("s.b")
    area = (b["t"] - a["t"]) * (a["w"] + b["w"]) / 2
    so_far = Window.partitionBy("skey").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    pairs = F.transform(F.sequence(F.lit(1), F.size("knots") - 1), lambda i: F.struct(i.alias("i"), F.element_at("knots", i).alias("a"), F.element_at("knots", i + 1).alias("b")))
    steps = schedule.select("skey", F.explode(pairs).alias("s")).select("skey", F.col("s.i").alias("i"), a["t"].alias("t"), a["w"].alias("w"), ((b["w"] - a["w"]) / (b["t"] - a["t"])).alias("slope"), area.alias("area"))
    steps = steps.withColumn("before", F.sum("area").over(so_far) - F.col("area"))
    return steps.groupBy("skey").agg(F.sum("area").alias("weight"), F.sort_array(F.collect_list(F.struct("i", "before", "t", "w", "slope"))).alias("segments"))


def share_out(sources: DataFrame, weights: DataFrame, share: float, cap: float) -> DataFrame:
    """(skey, source_size) and (skey, weight, ...) to targets; one row per source passes the windows."""
    s = sources.join(weights, "skey").withColumn("limit", cap * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "skey")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything) * F.lit(share)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("level", left / open_weight).withColumn("is_open", F.col("level") * F.col("weight") <= F.col("limit"))
    s = s.withColumn("final", F.min(F.when(F.col("is_open"), F.struct(F.col("limit") / F.col("weight"), "skey", "level"))).over(everything)["level"])
    return s.withColumn("target", F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("weight") * F.col("final"))))


def progress(demand: Column, segments: Column) -> Column:
    """The t at which a source's share of its integral reaches demand (a part of 1) times weight."""
    seg = F.element_at(F.filter(segments, lambda s: s["before"] <= demand), -1)
    q = F.greatest(demand - seg["before"], F.lit(0.0))
    root = seg["w"] + F.sqrt(F.greatest(seg["w"] * seg["w"] + 2 * seg["slope"] * q, F.lit(0.0)))
    return seg["t"] + F.when(root > 0, 2 * q / root).otherwise(0.0)


def mix(sized: DataFrame, schedule: DataFrame, share: float = SHARE, cap: float = CAP, carry: list[str] | None = None) -> DataFrame:
    """Sized documents (uid, doc_id, skey, spot, size) and knots by skey to one row per document with its copies.

    spot is a 60-bit reproducible order. Returns uid, doc_id, size, source_size, target, taken, copies (an array of
    (position, words), one for each time that the document is read) and the columns of carry.
    """
    carry = carry or []
    step1, step2 = 1 << 53, 1 << 46
    level1, level2 = F.floor(F.col("spot") / step1), F.floor(F.col("spot") / step2)
    s = sized.withColumn("b1", level1).withColumn("b2", level2)
    fine = cut(s.groupBy("skey", "b1", "b2").agg(F.sum("size").alias("part")), "mix-parts")
    coarse = fine.groupBy("skey", "b1").agg(F.sum("part").alias("part"))
    upto = lambda *by: F.sum("part").over(Window.partitionBy(*by).orderBy("b2" if "b1" in by else "b1").rowsBetween(Window.unboundedPreceding, 0)) - F.col("part")
    coarse = coarse.withColumn("start1", upto("skey")).select("skey", "b1", "start1")
    offsets = fine.withColumn("start2", upto("skey", "b1")).join(coarse, ["skey", "b1"]).select("skey", "b2", (F.col("start1") + F.col("start2")).alias("offset"))
    targets = share_out(fine.groupBy("skey").agg(F.sum("part").alias("source_size")), integrate(schedule), share, cap)
    offsets = offsets.join(targets.select("skey", "source_size", "target", "weight", "segments"), "skey")
    inside = Window.partitionBy("skey", "b2").orderBy("spot", "uid").rowsBetween(Window.unboundedPreceding, 0)
    placed = s.select("uid", "doc_id", "skey", "b2", "spot", "size", *carry).withColumn("start", F.sum("size").over(inside) - F.col("size"))
    placed = placed.join(offsets, ["skey", "b2"]).withColumn("start", F.col("start") + F.col("offset"))
    whole = F.floor("target")
    turns = F.when((F.col("size") > 0) & (F.col("start") < whole), F.ceil((whole - F.col("start")) / F.col("source_size"))).otherwise(0).cast("int")
    copy = lambda k: F.struct(progress((F.col("start") + k * F.col("source_size")) / F.col("target") * F.col("weight"), F.col("segments")).alias("position"), F.least(F.col("size"), whole - F.col("start") - k * F.col("source_size")).alias("words"))
    copies = F.when(turns > 0, F.transform(F.sequence(F.lit(0).cast("int"), turns - 1), copy)).otherwise(F.array().cast("array<struct<position:double,words:bigint>>"))
    return placed.withColumn("copies", copies).select("uid", "doc_id", "size", "source_size", "target", F.aggregate("copies", F.lit(0).cast("long"), lambda total, c: total + c["words"]).alias("taken"), "copies", *carry)


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(uid, doc_id, skey, spot, size), written once: texts are read and counted one time only."""
    return cut(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), ordered_key(source_col).alias("skey"), spread(id_col, text_col).alias("spot"), words(text_col).alias("size")), "mix-sizes")


def sources_of(sized: DataFrame) -> DataFrame:
    return sized.select("skey").distinct()


def training_order(copies: DataFrame, position: str = "position", tie: str = "doc_id") -> DataFrame:
    """Rows range-sorted by position, then tie (rows without position have only that): partition i is wholly before i + 1."""
    order = [F.col(position).asc_nulls_last(), F.col(tie)]
    return copies.repartitionByRange(*order).sortWithinPartitions(*order)


def mixed_documents(docs: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of docs as often as the mix reads them, with all their columns, in training order.

    A copy that its source's target cuts is read whole, or left out if that is nearer to the target, so every row is a whole
    document; a source whose only document is over twice its target gives none. Rows travel with their place, so ids need not
    be unique and columns may have any names. Rows without words are never read; a null source is a source; repeated rows
    count each; null ids are spread by their text; an empty table stays empty.
    """
    sized = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "source", "text").alias("uid"), F.col("doc_id"), ordered_key("source").alias("skey"), spread("doc_id", "text").alias("spot"), words().alias("size"))
    mixed = mix(sized, rank_schedule(sources_of(sized)), share, cap, carry=["row"]).where("taken > 0")
    reads = mixed.select("row", "doc_id", "size", F.explode("copies").alias("copy")).where(2 * F.col("copy.words") >= F.col("size"))
    return training_order(reads.select("row", "doc_id", F.col("copy.position").alias("position"))).select("row.*")

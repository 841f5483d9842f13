"""How filters interact, by inclusion and exclusion over their joint failures.

Each document has one flag per filter: it fails it or not. For each set of filters the flags' products are summed to the
number of documents that fail all of them (32 counts for five filters). All else follows from these counts, without
looking at a document again: the Möbius inversion over subsets gives the survivors of any set of filters, and with them
what each filter removes at any place of any order, what only it catches and what others had caught before it. The game
whose value is the number of documents that a set removes has the Harsanyi dividend (-1)^(|T|+1) * joint(T), and a
filter's Shapley value is the sum of the dividends of the sets that it is in, each shared equally.

Counts are kept by part (a column) and for each mark of the documents (all, good, toxic). Documents are first counted by
part, flags and marks, map-side, so a part or a group of copies may be of any size.

A duplicate is a text that a smaller id has anywhere in the table. Texts are compared by SHA-256: least ids by text first,
then rows meet them by (text, id), so that copies of one text spread over tasks. Null text counts as empty; a null part is
the empty string; rows of null id are no duplicates, make none and have no mark; repeated rows count each, and rows of the
same id are not smaller than each other; a mark holds if any row of an id has it; other columns are ignored, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: White space between words.
BLANKS = r"[\x20\x09-\x0D]+"


def few_words(text: Column, least: int = 200) -> Column:
    return F.size(_words(text)) < least


def repeats_itself(text: Column, percent: int = 50) -> Column:
    """Distinct words are fewer than some percent of all."""
    words = _words(text)
    return 100 * F.size(F.array_distinct(words)) < percent * F.size(words)


def shouts(text: Column, percent: int = 3) -> Column:
    """More than some percent of the code points are capitals A to Z."""
    return 100 * (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))) > percent * F.length(text)


def has_symbols(text: Column) -> Column:
    return text.rlike(r"[#$%&*|]")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANKS, -1), "")


def text_filters(text: Column) -> dict[str, Column]:
    return {"A": few_words(text), "B": repeats_itself(text), "C": shouts(text), "D": has_symbols(text)}


def judged(docs: DataFrame, marks: DataFrame, mark_names: list[str], filters=text_filters, duplicate: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: part, a boolean per filter (those of the text, then the duplicate one) and per mark.

    marks has id_col and a boolean column for each of mark_names; null is no mark.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    failed = filters(F.col("text_"))
    rows = docs.select(F.col(id_col).alias("id_"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text_"))
    rows = cut(rows.select("id_", "part", *[c.alias(name) for name, c in failed.items()], F.unhex(F.sha2("text_", 256)).alias("sha_")), "audit-flags")
    known = rows.where("id_ is not null")
    firsts = known.groupBy("sha_").agg(F.min("id_").alias("id_")).withColumn("first_", F.lit(True))
    known = known.join(firsts, ["sha_", "id_"], "left").withColumn(duplicate, F.col("first_").isNull())
    marked = marks.select(F.col(id_col).alias("id_"), *mark_names).groupBy("id_").agg(*[F.max(F.coalesce(F.col(m), F.lit(False))).alias(m) for m in mark_names])
    known = known.join(marked, "id_", "left").select("part", *failed, duplicate, *[F.coalesce(F.col(m), F.lit(False)).alias(m) for m in mark_names])
    unknown = rows.where("id_ is null").select("part", *failed, F.lit(False).alias(duplicate), *[F.lit(False).alias(m) for m in mark_names])
    return known.unionByName(unknown)


def joint_failures(rows: DataFrame, filters: str, mark_names: list[str]) -> DataFrame:
    """One row per part with an array for all documents (`joint`) and for each mark (`joint_<mark>`).

    Element s of an array is the number of documents that fail every filter of the set s, whose bits follow the order of filters.
    """
    cells = rows.groupBy("part", *filters, *mark_names).agg(F.count("*").alias("n_"))
    fails = {f: F.col(f).cast("long") for f in filters}

    def sums(weight: Column) -> Column:
        out = []
        for s in range(1 << len(filters)):
            product = weight
            for i, f in enumerate(filters):
                product = product * fails[f] if s >> i & 1 else product
            out.append(F.sum(product))
        return F.array(*out)

    return cells.groupBy("part").agg(sums(F.col("n_")).alias("joint"), *[sums(F.col("n_") * F.col(m).cast("long")).alias(f"joint_{m}") for m in mark_names])


def _sign(s: Column) -> Column:
    return 1 - 2 * (F.bit_count(s) % 2)


def _subsets(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit((1 << n) - 1))


def survivors(joint: Column, n: int) -> Column:
    """Element p: the documents that fail no filter of the set p, by Möbius inversion over its subsets."""
    inside = lambda p, s: p.bitwiseAND(s) == s
    signed = lambda s: _sign(s) * F.get(joint, s)
    total = lambda p: F.aggregate(F.filter(_subsets(n), lambda s: inside(p, s)), F.lit(0).cast("long"), lambda so_far, s: so_far + signed(s))
    return F.transform(_subsets(n), total)


def shapley(joint: Column, bit: Column, n: int) -> Column:
    """What a filter removes, summed over all n! orders: n! times its Shapley value, from the dividends of its sets."""
    mine = F.filter(_subsets(n), lambda s: s.bitwiseAND(bit) != 0)
    share = lambda s: (F.lit(math.factorial(n)) / F.bit_count(s)).cast("long")
    return F.aggregate(mine, F.lit(0).cast("long"), lambda so_far, s: so_far - _sign(s) * F.get(joint, s) * share(s))


def audit(joint: DataFrame, filters: str, mark_names: list[str]) -> DataFrame:
    """Joint failures to one row per part, order of the filters (a permutation of their letters) and step from 1.

    kept, removed, redundant, unique_fails, <mark>_lost for each mark and shapley, as the module says. Up to eight filters or so,
    as orders grow with their factorial.
    """
    n = len(filters)
    for name in ["joint", *[f"joint_{m}" for m in mark_names]]:
        joint = joint.withColumn(name.replace("joint", "left"), survivors(F.col(name), n))
    orders = joint.withColumn("filter_order", F.explode(F.lit(["".join(p) for p in permutations(filters)])))
    bit = lambda step: F.pow(F.lit(2), F.instr(F.lit(filters), F.substring("filter_order", step, F.lit(1))) - 1).cast("int")
    steps = orders.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("bit", bit(F.col("step")))
    earlier = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0), lambda so_far, k: so_far + F.when(k < F.col("step"), bit(k)).otherwise(0))
    steps = steps.withColumn("before", earlier).withColumn("after", F.col("before") + F.col("bit"))
    gone = lambda left: F.get(left, F.col("before")) - F.get(left, F.col("after"))
    everything = (1 << n) - 1
    return steps.select(
        "part", "filter_order", "step", F.get("left", F.col("after")).alias("kept"), gone(F.col("left")).alias("removed"),
        (F.get("joint", F.col("bit")) - gone(F.col("left"))).alias("redundant"),
        (F.get("left", everything - F.col("bit")) - F.get("left", F.lit(everything))).alias("unique_fails"),
        *[gone(F.col(f"left_{m}")).alias(f"{m}_lost") for m in mark_names], shapley(F.col("joint"), F.col("bit"), n).alias("shapley"),
    )

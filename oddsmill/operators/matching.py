"""Matching of texts by the words they share, and the assembly of one event over several venues."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions import text
from ..functions.scratch import cut

#: Sizes of token sets form classes, each so much larger than the one before.
CLASS = 1.5
#: Bytes for each core up to which a table is dealt out anew.
SMALL = 32 << 20
#: Similarities tried one after the other for the best match: rows with a valid match above one look no further.
STEPS = (0.5,)


def over_all_cores(df: DataFrame) -> DataFrame:
    """df, dealt out anew if fewer tasks read it than there are cores and it is small: a small table may be one row group."""
    plan, cores = df._jdf.queryExecution(), df.sparkSession.sparkContext.defaultParallelism
    few = plan.toRdd().getNumPartitions() <= cores
    return df.repartition(cores) if few and int(str(plan.optimizedPlan().stats().sizeInBytes())) <= SMALL * cores else df


def token_sets(rows: DataFrame) -> DataFrame:
    """(id, words): the distinct tokens of (id, text) rows; texts without tokens are left out. Texts are read and cut once."""
    sets = over_all_cores(rows.select("id", "text")).select("id", text.token_set(F.col("text")).alias("words"))
    return cut(sets, "token-sets").where(F.size("words") > 0)  # before the cut, the condition would cut each text once more


def _least_shared(n: Column, m: Column, floor: float) -> Column:
    """Tokens that sets of these sizes share at least if their similarity is above floor."""
    return F.ceil((n + m) * (floor / (1 + floor)) - 1e-9)


def _class(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(CLASS) + 1e-9).cast("int")


def ordered_sets(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as (id, n, words): of n tokens those that the other side has too, rarest first.

    A token weighs by the pairs that it would make alone; those of one side only weigh nothing and come before all, so they
    need not be listed. The order is the same on both sides.
    """
    exploded = lambda sets: sets.select("id", F.size("words").alias("n"), F.explode("words").alias("token"))
    counts = lambda rows, name: rows.groupBy("token").agg(F.count("*").alias(name))
    # what is written has a known size, so that it is broadcast only if it is small
    l = cut(counts(exploded(left), "l"), "left-tokens")  # noqa: E741
    shared = exploded(right).join(l.select("token"), "token", "left_semi")
    both = cut(counts(shared, "r").join(l, "token").select("token", (F.col("l") * F.col("r")).alias("weight")), "shared-tokens")
    place = lambda rows: cut(rows.join(both, "token").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("weight", "token"))).alias("w")).select("id", "n", F.col("w.token").alias("words")), "ordered-sets")
    return place(exploded(left)), place(exploded(right))


def candidates(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(l_id, r_id) of ordered sets that may be more similar than floor, by prefix, size and position.

    Sets of n and m tokens above floor share o of them, so each has one of these among its first n - o + 1 (or m - o + 1) tokens. o
    grows with the sizes; they are known by class, so each set lists the tokens of its prefix for each class that it may
    meet. A token at places i and j leaves at most the shorter rest to share beyond it.
    """

    def prefixes(sets: DataFrame, p: str, other: str) -> DataFrame:
        n = F.col("n")
        classes = F.sequence(_class(F.greatest(F.lit(1), F.floor(n * floor))), _class(F.ceil(n / floor)))
        rows = sets.select("id", "n", "words", F.explode(classes).alias(f"{other}_class"))
        smallest = F.greatest(F.ceil(F.pow(F.lit(CLASS), F.col(f"{other}_class")) - 1e-6), F.ceil(n * floor - 1e-9))
        length = n - _least_shared(n, smallest, floor) + 1  # of the prefix, with the tokens that aren't listed
        listed = F.slice("words", F.lit(1), F.greatest(F.lit(0), (length - n + F.size("words")).cast("int")))
        rows = rows.select(F.col("id").alias(f"{p}_id"), n.alias(f"{p}_n"), F.size("words").alias("k"), _class(n).alias(f"{p}_class"), f"{other}_class", F.posexplode(listed).alias("i", "token"))
        return rows.select(f"{p}_id", f"{p}_n", f"{p}_class", f"{other}_class", "token", (F.col("k") - F.col("i")).alias(f"{p}_rest"))

    met = prefixes(left, "l", "r").join(prefixes(right, "r", "l"), ["token", "l_class", "r_class"])
    possible = F.least("l_rest", "r_rest") >= _least_shared(F.col("l_n"), F.col("r_n"), floor)
    return met.where(possible & (F.least("l_n", "r_n") > floor * F.greatest("l_n", "r_n"))).select("l_id", "r_id").distinct()


def _compared(left: DataFrame, right: DataFrame, pairs: DataFrame, floor: float) -> DataFrame:
    side = lambda sets, p: sets.select(F.col("id").alias(f"{p}_id"), F.col("n").alias(f"{p}_n"), F.col("words").alias(f"{p}_words"))
    met = pairs.join(side(left, "l"), "l_id").join(side(right, "r"), "r_id").withColumn("shared", F.size(F.array_intersect("l_words", "r_words")))
    return met.select("l_id", "r_id", (F.col("shared") / (F.col("l_n") + F.col("r_n") - F.col("shared"))).alias("similarity")).where(F.col("similarity") > floor)


def similar_pairs(left: DataFrame, right: DataFrame, floor: float = LIMITS.match_floor) -> DataFrame:
    """Pairs of (id, text) rows whose token sets have a Jaccard similarity above floor; ids are unique on each side.

    Candidates by prefix filtering are compared on their sets. Exact for any floor above 0; null texts have no tokens.
    """
    l, r = ordered_sets(token_sets(left), token_sets(right))  # noqa: E741
    return _compared(l, r, candidates(l, r, floor), floor)


def with_entities(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (l_id, r_id, similarity) with both texts' entities and if the match is valid at its own similarity.

    Only texts that are in a pair are searched for entities, each once.
    """

    def found(df, p):
        asked = df.select(F.col("id").alias(f"{p}_id"), "text").join(pairs.select(f"{p}_id").distinct(), f"{p}_id", "left_semi")
        return asked.select(f"{p}_id", text.entities(F.col("text")).alias(f"{p}_entities"))

    both = pairs.join(found(left, "l"), "l_id").join(found(right, "r"), "r_id")
    return both.withColumn("valid", text.valid_match(F.col("l_entities"), F.col("r_entities"), F.col("similarity")))


def valid_pairs(left: DataFrame, right: DataFrame, floor: float = LIMITS.match_floor) -> DataFrame:
    """similar_pairs that pass entity validation."""
    pairs = cut(similar_pairs(left, right, floor), "similar-pairs")
    return with_entities(pairs, left, right).where("valid").select("l_id", "r_id", "similarity")


def best_matches(pairs: DataFrame) -> DataFrame:
    """The most similar right row of each left row; ties go to the lesser right id."""
    best = pairs.groupBy("l_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "r_id")).alias("best"))
    return best.select("l_id", F.col("best.r_id").alias("r_id"), (-F.col("best.s")).alias("similarity"))


def best_valid_matches(left: DataFrame, right: DataFrame, floor: float = LIMITS.match_floor, steps: tuple[float, ...] = STEPS) -> DataFrame:
    """The best of each left row's valid pairs above floor: (l_id, r_id, similarity).

    Similarities are tried from high to low. All pairs above a step are found in it, so a left row with a valid match there has
    its best one and doesn't look for candidates of lower steps, whose prefixes are longer.
    """
    l, r = ordered_sets(token_sets(left), token_sets(right))  # noqa: E741
    out, least = [], [s for s in steps if s > floor]
    for at in [*least, floor]:
        pairs = cut(_compared(l, r, candidates(l, r, at), at), "similar-pairs")
        found = best_matches(with_entities(pairs, left, right).where("valid"))
        if at != floor:
            found = cut(found, "matches")
            l = l.join(found.select(F.col("l_id").alias("id")), "id", "left_anti")  # noqa: E741
        out.append(found)
    return reduce(DataFrame.unionByName, out)


def assembled(left: DataFrame, venues: dict[str, DataFrame], home: str, floor: float = LIMITS.match_floor) -> DataFrame:
    """One row for each left event that any venue matches: its best valid match at each venue, or null, and all prices.

    left and each venue are (id, text, price). Returns id, similarity (the greatest of its matches), matches (a map from venue to
    the matched id) and prices (a map from venue to price; home is the left's own), venues in the order given.
    """
    matches = []
    for name, rows in venues.items():
        found = best_valid_matches(left, rows, floor)
        priced = found.join(rows.select(F.col("id").alias("r_id"), "price"), "r_id")
        matches.append(priced.select(F.col("l_id").alias("id"), F.lit(name).alias("venue"), "r_id", "similarity", "price"))
    every = reduce(DataFrame.unionByName, matches)
    # one match a venue, so a group has as many rows as there are venues at most
    by_venue = every.groupBy("id").agg(F.max("similarity").alias("similarity"), F.map_from_entries(F.collect_list(F.struct("venue", F.struct("r_id", "price")))).alias("m"))
    listed = F.filter(F.array(*[F.lit(v) for v in venues]), lambda v: F.map_contains_key("m", v))
    rows = by_venue.join(left.select("id", F.col("price").alias("own")), "id")
    prices = F.map_from_arrays(F.concat(F.array(F.lit(home)), listed), F.concat(F.array("own"), F.transform(listed, lambda v: F.element_at("m", v)["price"])))
    return rows.select("id", "similarity", F.map_from_arrays(listed, F.transform(listed, lambda v: F.element_at("m", v)["r_id"])).alias("matches"), prices.alias("prices"))

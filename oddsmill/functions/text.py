"""Text functions: normalisation, token sets, entities, headlines. Word lists are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import LIMITS

# Words that don't count in matching.
STOP_WORDS = ("the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "will", "be", "is", "are", "this", "that")
# Entities by category; found as substrings of lower-cased text.
ENTITIES = {
    "sports": ("world cup", "baseball", "basketball", "football", "soccer", "olympics", "super bowl", "nba", "fifa", "mlb", "nfl"),
    "crypto": ("bitcoin", "btc", "ethereum", "eth", "solana", "sol", "crypto", "blockchain"),
    "politics": ("trump", "biden", "election", "president", "congress", "senate", "vote"),
    "finance": ("fed", "federa reserve", "interest rate", "inflation", "recession", "stock market"),
    "tech": ("ai", "artificial intelligence", "chatgpt", "openai", "google", "apple", "tesla"),
    "time": ("2024", "2025", "2026", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
}
# Entities that exclude each other.
CONFLICTS = ((("world cup", "fifa", "soccer"), ("baseball", "mlb")), (("bitcoin", "btc"), ("ethereum", "eth")), (("trump",), ("biden",)))
# Headline keywords by class, in order; lower case, as headlines are lower-cased first.
HEADLINE_CLASSES = {
    "BITCOIN": ("btc", "crypto", "bitcoin"),
    "ETHEREUM": ("eth", "ethereum"),
    "ELECTION": ("election", "trump", "biden", "vote"),
    "FED": ("fed", "interest rate", "powell", "inflation"),
    "WAR": ("war", "ukraine", "israel", "gaza"),
    "TECH": ("apple", "google", "ai", "openai"),
}
URGENT = ("breaking", "urgent", "just", "now", "alert")
POSITIVE = ("surge", "rally", "gain", "up", "high", "bull")
NEGATIVE = ("crash", "drop", "fall", "down", "low", "bear")
# Markets that a class of news moves.
MARKETS = {
    "BITCOIN": "Bitcoin, BTC, crypto",
    "ETHEREUM": "Ethereum, ETH, crypto",
    "ELECTION": "election, trump, biden, vote",
    "FED": "Fed, interest rate, inflation",
    "WAR": "war, ukraine, israel",
    "TECH": "apple, google, ai, tech",
}


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def tokens(text: Column) -> Column:
    """Lower-cased words without punctuation, stop words and words of up to two characters, in order."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(clean, r"\s+"), lambda w: (F.length(w) > 2) & ~F.array_contains(strings(STOP_WORDS), w))


def token_set(text: Column) -> Column:
    """The distinct tokens of a text: as tokens gives them, but cut in one pass, and stop words looked up in a table."""
    words = F.array_except(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), strings(STOP_WORDS))
    return F.filter(words, lambda w: F.length(w) > 2)


def normalised(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def entities(text: Column) -> Column:
    """Sorted category:keyword of all keywords that a text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.array_compact(F.array(*[F.when(low.contains(k), F.lit(f"{c}:{k}")) for c, ks in ENTITIES.items() for k in ks])))


def _category(word: str) -> str:
    return next(c for c, ks in ENTITIES.items() if word in ks)


def conflict(a: Column, b: Column) -> Column:
    """If two entity arrays hold entities that exclude each other."""
    out = F.lit(False)
    for left, right in CONFLICTS:
        x, y = (strings(f"{_category(w)}:{w}" for w in side) for side in (left, right))
        out = out | (F.arrays_overlap(a, x) & F.arrays_overlap(b, y)) | (F.arrays_overlap(a, y) & F.arrays_overlap(b, x))
    return out


def valid_match(a: Column, b: Column, similarity: Column) -> Column:
    weak = (similarity < LIMITS.match_weak) & (F.size(F.array_intersect(a, b)) < LIMITS.shared_entities)
    return ~conflict(a, b) & ~weak


def any_of(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def headline(text: Column) -> dict[str, Column]:
    """impact, category (the last class with a hit), urgency, sentiment."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = F.lit(0)
    category = F.lit("OTHER")
    for name, words in HEADLINE_CLASSES.items():
        for w in words:
            hits = hits + low.contains(w).cast("int")
        category = F.when(any_of(low, words), F.lit(name)).otherwise(category)
    urgent = any_of(low, URGENT)
    return {
        "impact": F.least(F.lit(100), hits * 25 + F.when(urgent, 20).otherwise(0)),
        "category": category,
        "urgency": F.when(urgent, "HIGH").otherwise("LOW"),
        "sentiment": F.when(any_of(low, POSITIVE), "POSITIVE").when(any_of(low, NEGATIVE), "NEGATIVE").otherwise("NEUTRAL"),
    }


def suggested_markets(category: Column) -> Column:
    out = None
    for name, markets in MARKETS.items():
        out = F.when(category == name, markets) if out is None else out.when(category == name, markets)
    return out.otherwise("")


def suggested_action(category: Column, sentiment: Column, urgency: Column) -> Column:
    crypto = category.isin("BITCOIN", "ETHEREUM")
    high = urgency == "HIGH"
    return (
        F.when(high & (category == "BITCOIN") & (sentiment == "POSITIVE"), "watch bitcoin upside markets")
        .when(high & (category == "BITCOIN") & (sentiment == "NEGATIVE"), "watch bitcoin downside markets")
        .when(high & (category == "ELECTION"), "watch election markets, sharp moves possible")
        .when(high & (category == "FED"), "watch rate markets, major policy effect")
        .when(crypto, "monitor crypto volatility")
        .when(category == "ELECTION", "follow political markets")
        .when(category == "FED", "follow macro markets")
        .otherwise("keep monitoring")
    )

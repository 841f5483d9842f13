"""Spelling variants: words that differ by one code point, by range reporting in two dimensions.

Words are sorted forwards and, reversed, backwards. All words that begin like w up to a position are an interval of the first
order, all that end like w after it an interval of the second; a word in both differs from w at that position only, by a
replaced code point or by one that it lacks. Each word is a point (place forwards, place backwards), and a wavelet tree over the
backward places in forward order reports the points of such a rectangle in time that grows with the logarithm of the words and with what
is found. An inserted code point is the other word's deleted one, so words only look for words of their length and one less.

Words are dealt to tasks by length and half: an edit in the second half leaves the first half equal, and the other way round, so
near words meet in the task of the half that they share. Each word is in four places (its length and the next, both halves). A
half that more than CROWD words share is dealt anew for each edit position by all that the edit leaves, so that no task holds
it. Tasks return, for each of their words, the number of its near words and the best, not pairs.

Words are counted in all of every text before any is dropped. Null text has no words; a null id is the empty text before the colon;
repeated rows count each; of equal counts the word that is first in code-point order is best; words of any length are taken; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Code points of the shortest word, least count of a word, how much more often a form must occur, and one run in how many is miswritten.
SHORTEST, LEAST, TIMES, NOISE = 6, 5, 5, 199
#: Words that may share a half before it is dealt by position; places of words in a task; rectangles looked up at once.
CROWD, IN_A_TASK, AT_ONCE = 20_000, 60_000, 200_000
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all texts: runs of letters, one in NOISE of (document, run) miswritten by a missing code point."""
    # a run shorter than the shortest word gives none
    runs = F.regexp_extract_all(F.translate(text_col, CAPITALS, SMALL), F.lit(f"[a-zÀ-ÿ]{{{SHORTEST},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id_"), F.explode(runs).alias("run"))
    h = F.crc32(F.concat_ws(":", "id_", "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    miswritten = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = rows.withColumn("h", h).select(F.when(F.col("h") % NOISE == 0, miswritten).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST)


def dealt(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(longer, back, at, deal, word, n): each word for its length and the next and for both halves; at is -1, or the only edit position."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("longer")).withColumn("half", F.floor(F.col("longer") / 2).cast("int"))
    rows = rows.select("word", "n", "longer", "half", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"))
    shared = F.when(F.col("back"), F.substring("word", size - (F.col("longer") - F.col("half")) + 1, size)).otherwise(F.substring("word", F.lit(1), F.col("half")))
    rows = rows.withColumn("deal", F.xxhash64("longer", "back", shared))
    crowds = cut(rows.groupBy("deal").agg(F.count("*").alias("members")).where(F.col("members") > crowd).select("deal", F.lit(True).alias("crowded")), "crowds")
    rows = rows.join(crowds, "deal", "left")
    positions = F.when(F.col("back"), F.slice(F.sequence(F.lit(0), F.col("half")), F.lit(1), F.col("half"))).otherwise(F.sequence(F.col("half"), F.col("longer") - 1))
    rows = rows.withColumn("at", F.explode(F.when(F.col("crowded"), positions).otherwise(F.array(F.lit(-1)))))
    after = F.substring("word", F.col("at") + 1 + size - F.col("longer") + 1, size)
    deal = F.when(F.col("at") < 0, F.col("deal")).otherwise(F.xxhash64("longer", "back", "at", F.substring("word", F.lit(1), F.col("at")), after))
    return rows.select("longer", "back", "at", deal.alias("deal"), "word", "n")


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Order:
    """Words of groups in order: place of each row, rows by place, and common prefixes with the word before, -1 across groups."""

    def __init__(self, groups: np.ndarray, words: list[str]):
        of = groups.tolist()
        rows = sorted(range(len(words)), key=lambda r: (of[r], words[r]))
        self.rows = np.array(rows, np.int64)
        self.place = np.empty(len(rows), np.int64)
        self.place[self.rows] = np.arange(len(rows))
        same = np.concatenate([[False], groups[self.rows][1:] == groups[self.rows][:-1]])
        common = np.array([_common(words[a], words[b]) if s else -1 for a, b, s in zip([rows[0], *rows[:-1]], rows, same.tolist(), strict=True)], np.int64)
        # least of 2^k neighbouring common prefixes
        self.least = [common]
        while 2 ** len(self.least) <= len(rows):
            a, step = self.least[-1], 2 ** (len(self.least) - 1)
            self.least.append(np.minimum(a[:-step], a[step:]))
        self.most = np.maximum(common, np.append(common[1:], -1))[self.place]

    def interval(self, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of the words that share the first characters of a row's word, for many at once."""
        first, last = self.place[row].copy(), self.place[row].copy()
        for k in reversed(range(len(self.least))):
            step, a = 2**k, self.least[k]
            at = first - step + 1
            first -= step * ((at > 0) & (a[np.maximum(at, 0)] >= length))
            at = last + 1
            last += step * ((at < len(a)) & (a[np.minimum(at, len(a) - 1)] >= length))
        return first, last


class WaveletTree:
    """A wavelet tree, stored level by level, over a permutation of 0 to n - 1."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.zeros = []
        for b in reversed(range(self.bits)):
            one = (values >> b & 1).astype(bool)
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            values = np.concatenate([values[~one], values[one]])

    def report(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectangle, value) of all values in low to high at places from left to before right, for many rectangles."""
        which, start = np.arange(len(left)), np.zeros(len(left), np.int64)
        for b, zeros in zip(reversed(range(self.bits)), self.zeros, strict=True):
            l0, r0 = zeros[left], zeros[right]
            l1, r1 = zeros[-1] + left - l0, zeros[-1] + right - r0
            to0 = (l0 < r0) & (start + (1 << b) > low[which])
            to1 = (l1 < r1) & (start + (1 << b) <= high[which])
            to0 &= start <= high[which]
            to1 &= start + (2 << b) > low[which]
            left, right = np.concatenate([l0[to0], l1[to1]]), np.concatenate([r0[to0], r1[to1]])
            which, start = np.concatenate([which[to0], which[to1]]), np.concatenate([start[to0], start[to1] + (1 << b)])
        return which, start


def near_pairs(longer: np.ndarray, back: np.ndarray, at: np.ndarray, words: list[str]):
    """Yields arrays (row, near row) of words of the same length, half and position that differ by one code point, each pair both ways."""
    _, groups = np.unique(np.stack([longer, back, at]), axis=1, return_inverse=True)
    groups = groups.reshape(-1)
    forward, backward = Order(groups, words), Order(groups, [w[::-1] for w in words])
    tree = WaveletTree(backward.place[forward.rows])
    size, half = np.fromiter(map(len, words), np.int64, len(words)), longer // 2
    # a position is worth a look if another word shares what lies before it, and another what lies after it
    low = np.maximum(np.where(at >= 0, at, np.where(back, 0, half)), longer - 1 - backward.most)
    high = np.minimum(np.where(at >= 0, at, np.where(back, half - 1, longer - 1)), forward.most)
    count = np.where(size == longer, np.maximum(high - low + 1, 0), 0)
    ends = np.cumsum(count)
    for begin in range(0, int(ends[-1]) if len(ends) else 0, AT_ONCE):
        n = np.arange(begin, min(begin + AT_ONCE, int(ends[-1])))
        row = np.searchsorted(ends, n, side="right")
        i = low[row] + n - (ends[row] - count[row])
        left, right = forward.interval(row, i)
        bottom, top = backward.interval(row, longer[row] - 1 - i)
        some = (left < right) & (bottom < top)
        row, i = row[some], i[some]
        which, place = tree.report(left[some], right[some] + 1, bottom[some], top[some])
        one, other, i = row[which], backward.rows[place], i[which]
        replaced = (size[other] == longer[one]) & (other != one)
        yield one[replaced], other[replaced]
        # of equal neighbours the last counts as the one that is missing
        lacks = size[other] < longer[one]
        one, other, i = one[lacks], other[lacks], i[lacks].tolist()
        last = np.array([k + 1 == len(words[r]) or words[r][k] != words[r][k + 1] for r, k in zip(one.tolist(), i, strict=True)], bool)
        yield np.concatenate([one[last], other[last]]), np.concatenate([other[last], one[last]])


def _near(batches):
    """A task's words to (word, n_near, best_n, best): what is near in them."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    columns = [np.asarray(table.column(c).to_numpy(zero_copy_only=False)) for c in ("longer", "back", "at")]
    liked = np.empty(len(words), np.int64)  # place of a row's word by count, then by code points
    counts = n.tolist()
    order = np.array(sorted(range(len(words)), key=lambda r: (-counts[r], words[r])), np.int64)
    liked[order] = np.arange(len(words))
    found, best = np.zeros(len(words), np.int64), np.full(len(words), len(words), np.int64)
    for one, other in near_pairs(columns[0].astype(np.int64), columns[1].astype(bool), columns[2].astype(np.int64), words):
        np.add.at(found, one, 1)
        np.minimum.at(best, one, liked[other])
    rows = np.flatnonzero(found)
    for start in range(0, len(rows), 10_000):
        some = rows[start : start + 10_000]
        top = order[best[some]]
        yield pa.RecordBatch.from_pydict({"word": pa.array([words[r] for r in some], pa.string()), "n_near": pa.array(found[some], pa.int64()), "best_n": pa.array(n[top], pa.int64()), "best": pa.array([words[r] for r in top], pa.string())})


def near_words(words: DataFrame, crowd: int = CROWD, in_a_task: int = IN_A_TASK) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have a near one; words is (word, n), each word once."""
    rows = cut(dealt(words, crowd), "word-places")
    tasks = max(1, -(-rows.count() // in_a_task))
    found = rows.repartition(tasks, "deal").mapInArrow(_near, "word string, n_near long, best_n long, best string")
    better = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), better.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root), the last of the forms that follow: steps double, and counts grow TIMES a step, so rounds are few."""
    now = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        next_ = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = cut(now.join(next_, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        drop_cut(now)
        now = after
        if not now.where("moved").head(1):
            return now.select("word", "root")


def variants(words: DataFrame, times: int = TIMES, crowd: int = CROWD, in_a_task: int = IN_A_TASK) -> DataFrame:
    """(word, n) to word, form, root, n, n_near, form_n: a word's form is its commonest near word if that is times as common."""
    words = cut(words, "words")
    near = cut(near_words(words, crowd, in_a_task), "near-words")
    is_form: Column = F.col("best_n") >= times * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = cut(rows, "forms")
    return rows.join(roots(rows.where("form is not null").select("word", "form")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

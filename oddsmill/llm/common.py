"""What several operators of this subpackage share: scratch tables, word pattern, tokenising with a memory of pieces."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import batches_of, cut, delete, drop_cut, scratch_path, scratch_root, shuffles_freed, small_batches  # noqa: F401  the operators take them from here

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ordered_key(column: str):
    """A non-null string key for a nullable string column: sorts by code point, null last, null equal to null."""
    return F.coalesce(F.concat(F.lit("v"), F.col(column)), F.lit("z"))


def spread(column: str, instead: str | None = None):
    """A 60-bit number from the md5 of a column's text: a reproducible order that other engines can compute too.

    Nulls take the md5 of the column named by instead, if there is one.
    """
    other = F.md5(F.coalesce(F.col(instead).cast("string"), F.lit(""))) if instead else F.lit("")
    return F.conv(F.substring(F.md5(F.coalesce(F.col(column).cast("string"), other)), 1, 15), 16, 10).cast("long")


#: Rows of keys that a task may hold in a map: some hundred bytes each.
MAP_ROWS = 500_000


def hashed(keys: DataFrame, at_most: int) -> DataFrame:
    """keys (no more rows than at_most), to be held in a map by each task of a join if a task's share of them fits.

    That spares a sort of the other side's texts. Beyond the bound Spark sorts both sides, which can spill.
    """
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.hint("shuffle_hash") if at_most <= MAP_ROWS * tasks else keys


# A text is cut before white space, and between a Latin word and the punctuation after it. The tokenisers' own patterns
# never join characters across these places, so that encoding piece by piece gives the ids of the whole text.
_LATIN, _STOP = "a-zA-ZÀ-ÖØ-öø-ÿ", ".,|!%&$#*"
_CHUNK = re.compile(r"\s*\S+|\s+$")
_PIECE = re.compile(rf"\s*[{_LATIN}]+(?=[{_STOP}]|$)|(?<=[{_LATIN}])[{_STOP}]\S*|\s*\S+|\s+$")
_STOP_AFTER_WORD = f"(^|[ \n])([{_LATIN}]+)([{_STOP}])"
# White space beyond single spaces and line ends, which the plain way of cutting doesn't serve; separators that
# Python takes for white space and the tokenisers don't; and what marks cuts here.
_UNEVEN = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c", "\0")
_RARE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")
_WHOLE = ("\x1c", "\x1d", "\x1e", "\x1f")


def _kind(text: str, whole: tuple[str, ...] = _WHOLE) -> str:
    """How a text is cut: not at all, by pattern, or before each space and line end."""
    if any(x in text for x in whole):
        return "whole"
    if any(x in text for x in _UNEVEN) or text[:1].isspace() or text[-1:].isspace() or not text.isascii() and any(x in text for x in _RARE):
        return "uneven"
    return "even"


#: Pieces of each of the two generations that a worker remembers; characters looked up at once.
PIECES_KEPT, AT_ONCE = 600_000, 4 << 20


class Memory:
    """A bounded map in two generations: when the young one is full it becomes the old one; what is asked for comes back."""

    def __init__(self, kept: int):
        self.kept, self.young, self.old = kept, {}, {}

    def recall(self, keys: list) -> tuple[list, list[int]]:
        """Values of distinct keys, and the places of those that neither generation has."""
        if len(self.young) > self.kept:
            self.old, self.young = self.young, {}
        values, old, young = list(map(self.young.get, keys)), self.old, self.young
        missing = [i for i, v in enumerate(values) if v is None]
        for i in missing:
            if (v := old.get(keys[i])) is not None:
                young[keys[i]] = values[i] = v
        return values, [i for i in missing if values[i] is None]


class ChunkedTokenizer:
    """The tokenizers library with a bounded memory of pieces; ids come as little-endian 32-bit bytes.

    Each distinct piece of a batch is looked up once, and each text's ids are joined by index. Ids are the library's for the file as it is: a
    text that holds the name of one of the file's added tokens is encoded whole, so that the library finds the token; none are added.
    """

    def __init__(self, file: str, kept: int = PIECES_KEPT):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.whole = (*_WHOLE, *(t.content for t in self.tokenizer.get_added_tokens_decoder().values()))
        self.memory = Memory(kept)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lay_out(self, pieces: pa.Array, ends: np.ndarray) -> list[bytes]:
        """Ids of texts, given all their pieces and where each text's pieces end."""
        coded = pieces.dictionary_encode()
        keys, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ids, new = self.memory.recall(keys)
        for start in range(0, len(new), 20_000):
            some = new[start : start + 20_000]
            for i, x in zip(some, self._encode([keys[i] for i in some]), strict=True):
                self.memory.young[keys[i]] = ids[i] = x
        held = np.empty(len(ids), object)
        held[:] = ids
        parts, ends = held[at].tolist(), ends.tolist()
        return [b"".join(parts[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _some(self, texts: list[str]) -> list[bytes]:
        out, even, uneven, whole = [b""] * len(texts), [], [], []
        for i, t in enumerate(texts):
            kind = _kind(t, self.whole)
            (whole if kind == "whole" else uneven if kind == "uneven" else even).append(i)
        if whole:
            for i, ids in zip(whole, self._encode([texts[i] for i in whole]), strict=True):
                out[i] = ids
        if even:
            marked = pa.array([texts[i].replace("\n", "\0\n").replace(" ", "\0 ") for i in even], pa.string())
            parts = pc.split_pattern(pc.replace_substring_regex(marked, _STOP_AFTER_WORD, "\\1\\2\0\\3"), "\0")
            for i, ids in zip(even, self._lay_out(parts.flatten(), parts.offsets.to_numpy()[1:]), strict=True):
                out[i] = ids
        if uneven:
            chunks = [_CHUNK.findall(texts[i]) for i in uneven]
            cut_up = {c: _PIECE.findall(c) for c in set().union(*chunks)}
            parts = [[p for c in some for p in cut_up[c]] for some in chunks]
            for i, ids in zip(uneven, self._lay_out(pa.array([p for some in parts for p in some], pa.string()), np.cumsum([len(p) for p in parts])), strict=True):
                out[i] = ids
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        out, start, held = [], 0, 0
        for i, t in enumerate(texts):
            held += len(t)
            if held > AT_ONCE or i + 1 == len(texts):
                out += self._some(texts[start : i + 1])
                start, held = i + 1, 0
        return out


@lru_cache(maxsize=2)
def tokenizer(file: str) -> ChunkedTokenizer:
    """One tokeniser for each Python worker and file; workers are reused, so its memory stays warm."""
    return ChunkedTokenizer(file)

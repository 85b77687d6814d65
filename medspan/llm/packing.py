"""Packing token sequences: best-fit decreasing over a segment tree indexed by remaining capacity.

Documents are tokenised and closed with one end id. A document longer than a window is first cut into full windows; what is
left of it, and every shorter document, is an item. Items are placed in order of falling length, each into the open window
whose remaining capacity is smallest among those that hold it, else into a new one.

Lengths are whole numbers up to the window, so the order of equally long items does not matter to the outcome: best-fit
decreasing runs on the histogram of lengths, and moves whole ranges of windows that have the same free capacity at once. The
driver sees only that histogram (at most WINDOW counts); the plan it makes is a list of (length, first item, first window,
offset) ranges whose number depends on the window size, not on the number of documents. Items are numbered within their
length by Spark without gathering a length into one task, and find their range by binary search.

Null text counts as empty: one piece that holds the end id alone. Repeated rows are packed as often as they occur. A null
doc_id is an ordinary value. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from collections import deque
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import durable, number_within, table

WINDOW, END_ID = 4096, 2
CACHE_ENTRIES, SLICE_BYTES = 1_000_000, 1 << 21
# Kinds of characters that the tokenizer neither composes nor takes apart, in lower case either: ASCII and the letters of Latin-1. An
# apostrophe may belong to the letters after it, and special tokens begin with "<".
BLANK, SIGN, LETTER, DIGIT, OTHER = range(5)
KINDS = np.full(257, OTHER, dtype=np.uint8)
KINDS[33:127] = SIGN
KINDS[[*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]] = LETTER
KINDS[48:58], KINDS[32] = DIGIT, BLANK
KINDS[[ord("'"), ord("<")]] = OTHER
SIGNS = "".join(map(chr, np.flatnonzero(KINDS == SIGN)))
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Ids:
    """Little-endian 32-bit ids of texts. This tokenizer never joins across white space, so runs between it are cached.

    Runs that no text had before are encoded together, many in one call: the tokenizer parts a run into stretches of letters or
    of signs and single digits, and each of these ends in one id that closes it, and only there. So the ids part again by
    counts of such pieces, which KINDS tells for runs of common characters; all others go by `_learn`."""

    # Python splits at these too, the tokenizer does not
    odd = re.compile("[\x1c-\x1f]")
    # a word and signs that close it: the tokenizer parts the two, and lowers the word
    closed = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model, for what is composed, in lower case and one piece already
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of runs of letters."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words):
            return self._encode(words)
        data, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [data[x:y] for x, y in zip(at, at[1:])]

    def _parts(self, run: str) -> tuple[str, str]:
        """A run's word and the signs that close it, as the tokenizer sees it: composed, which takes some letters apart into a letter
        and a mark, and in lower case, which does so to a few more. A mark before a sign is one piece with it; such a run stays whole."""
        if run.isascii():
            found = None if run.isalpha() else self.closed.fullmatch(run)
            word, sign = found.groups() if found else (run, "")
            return word.lower(), sign
        composed = unicodedata.normalize("NFC", run)
        found = self.closed.fullmatch(composed) if self.closed.fullmatch(composed.lower()) else None
        return found.groups() if found else (run, "")

    def _learn(self, runs: list[str]) -> dict[str, bytes]:
        """Ids of runs; cached as long as there is room."""
        parts = {r: self._parts(r) for r in runs}
        new = dict.fromkeys(x for p in parts.values() for x in p if x and x not in self.cache)
        letters = lambda x: x.isalpha() if x.isascii() else unicodedata.normalize("NFC", x).lower().isalpha()
        plain, other = [x for x in new if letters(x)], [x for x in new if not letters(x)]
        made = dict(zip(plain, self._words(plain) if plain else [])) | dict(zip(other, self._encode(other)))
        get = lambda x: (made.get(x) or self.cache[x]) if x else b""
        whole = {r: get(word) + get(sign) for r, (word, sign) in parts.items()}
        if len(self.cache) < CACHE_ENTRIES:
            self.cache.update(made)
            self.cache.update(whole)
        return whole

    def _common(self, runs: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of the runs of common characters, in lower case and without the signs that close them, and of these signs, each
        encoded once; and the other runs."""
        some, rest, _ = self._told(runs)
        lower = " ".join(some).lower().split(" ") if some else []
        words = [r.rstrip(SIGNS) for r in lower]
        signs = [r[len(w) :] for r, w in zip(lower, words)]
        every = set(words).union(signs)
        every.discard("")
        made = {x: self.cache[x] for x in self.cache.keys() & every} | {"": b""}
        new, _, pieces = self._told(list(every.difference(made)))
        for tokenizer, which in ((self.bare, pieces == 1), (self.tokenizer, pieces != 1)):
            if not which.any():
                continue
            part = list(compress(new, which.tolist()))
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) != pieces[which].sum():
                return {}, runs
            data, at = ids.tobytes(), [0, *(4 * ends[np.cumsum(pieces[which]) - 1]).tolist()]
            made |= zip(part, [data[x:y] for x, y in zip(at, at[1:])])
        whole = {r: made[w] + made[s] if s else made[w] for r, w, s in zip(some, words, signs)}
        if len(self.cache) < CACHE_ENTRIES:
            self.cache |= made
            self.cache |= whole
        return whole, rest

    @staticmethod
    def _told(runs: list[str]) -> tuple[list[str], list[str], np.ndarray]:
        """The runs of common characters, the others, and into how many pieces the tokenizer parts each of the former."""
        if not runs:
            return [], [], np.zeros(0, dtype=np.int64)
        code = np.frombuffer(" ".join(runs).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = KINDS[np.minimum(code, len(KINDS) - 1)]
        first = np.concatenate([[0], np.flatnonzero(kind == BLANK) + 1])
        common = np.maximum.reduceat(kind, first) < OTHER
        fresh = (kind == DIGIT) | (kind != np.concatenate([[BLANK], kind[:-1]]))
        pieces = np.add.reduceat(fresh & (kind != BLANK), first, dtype=np.int64)[common]
        return list(compress(runs, common.tolist())), list(compress(runs, (~common).tolist())), pieces

    def of_all(self, texts: list[str]) -> list[bytes]:
        odd = [bool(self.odd.search(t)) for t in texts]
        lists = pc.utf8_split_whitespace(pa.array(["" if o else t for o, t in zip(odd, texts)], pa.large_string()))
        coded = lists.flatten().dictionary_encode()
        runs = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.cache.get, runs))
        if new := [r for r, f in zip(runs, found) if f is None]:
            made, rest = self._common([r for r in new if r])
            made = {"": b""} | made | (self._learn(rest) if rest else {})
            found = [made[r] if f is None else f for r, f in zip(runs, found)]
        # the ids of all texts, run by run
        size = np.array([len(f) // 4 for f in found], dtype=np.int64)
        index = coded.indices.to_numpy()
        count, ends = size[index], np.zeros(len(index) + 1, dtype=np.int64)
        np.cumsum(count, out=ends[1:])
        pool = np.frombuffer(b"".join(found), dtype="<u4")
        place = np.repeat((np.cumsum(size) - size)[index] - ends[:-1], count) + np.arange(ends[-1])
        data, at = pool[place].tobytes(), (4 * ends[lists.offsets.to_numpy()]).tolist()
        return [self._encode([t])[0] if o else data[x:y] for t, o, x, y in zip(texts, odd, at, at[1:])]

    def of(self, text: str) -> bytes:
        return self.of_all([text])[0]


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts of a column in order, in lists of about SLICE_BYTES; null is empty."""
    out, size = [], 0
    for i in range(len(texts)):
        out.append(texts[i].as_py() or "")
        size += len(out[-1])
        if size >= SLICE_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


_IDS: dict[str, Ids] = {}


def _pieces(path: str, window: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _IDS:
            _IDS[path] = Ids(path)
        ids = _IDS[path]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            out: list[tuple] = []
            coded = (data for some in _slices(batch.column(1)) for data in ids.of_all(some))
            for key, data in zip(keys, coded):
                data += end
                n = len(data) // 4
                out += [(key, at, min(window, n - at), zlib.crc32(data[4 * at : 4 * (at + window)]), n) for at in range(0, n, window)]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class SegmentTree:
    """Which capacities from 0 to n have an open window; `tightest(x)` is the smallest such capacity of at least x."""

    def __init__(self, n: int):
        self.size = 1 << (n + 1).bit_length()
        self.any = [False] * (2 * self.size)

    def set(self, i: int, value: bool) -> None:
        i += self.size
        self.any[i] = value
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def tightest(self, x: int) -> int | None:
        i = x + self.size
        if self.any[i]:
            return x
        while i > 1:
            if i % 2 == 0 and self.any[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.size:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(length, first item of that length, first window, offset there) ranges of best-fit decreasing, in order."""
    tree, opened, out, windows = SegmentTree(window), [deque() for _ in range(window + 1)], [], 0

    def put(capacity: int, first: int, count: int) -> None:
        if capacity:
            opened[capacity].append((first, count))
            tree.set(capacity, True)

    for length in sorted(histogram, reverse=True):
        item, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first, count = window, windows, left
            else:
                first, count = opened[capacity].popleft()
            # no open window is tighter, so one takes items for as long as they fit before the next one gets any
            each = capacity // length
            whole = min(count, left // each)
            rest = left - whole * each if whole < count else 0
            for k in range(each):
                if whole:
                    out.append((length, item, first, window - capacity + k * length))
                    item += whole
            for k in range(rest):
                out.append((length, item, first + whole, window - capacity + k * length))
                item += 1
            left -= whole * each + rest
            used = whole + bool(rest)
            if first == windows:
                windows += used
            else:
                if used < count:
                    opened[capacity].appendleft((first + used, count - used))
                if not opened[capacity]:
                    tree.set(capacity, False)
            if whole:
                put(capacity - each * length, first, whole)
            if rest:
                put(capacity - rest * length, first + whole, 1)
    return out


def _place(ranges: list[tuple[int, int, int, int]]):
    length, item, window, offset = (np.array(x, dtype=np.int64) for x in (zip(*ranges) if ranges else [()] * 4))
    order = np.lexsort((item, length))
    length, item, window, offset = length[order], item[order], window[order], offset[order]
    shift = np.int64(1) << 48
    keys = length * shift + item

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.schema.get_field_index
            size, rank = (batch.column(of(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, size * shift + rank, side="right") - 1
            sequence = window[at] + rank - item[at]
            kept = [batch.column(of(c)) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset[at])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = durable(rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), window, end_id), PIECES))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = number_within(pieces, ["length"], F.xxhash64("doc_id", "start"), [F.col("doc_id"), F.col("start"), F.col("ids_crc32")], "rank")
    return ranked.mapInArrow(_place(plan(histogram, window)), f"{PIECES}, sequence_id long, offset long")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

"""Periodic runs of words: recursive frequency splitting, then lags to the next equal gram.

Words are runs of other bytes than white space. A run is a stretch of consecutive words with smallest period q, of LEAST_WORDS
words and LEAST_TIMES * q words or more, that no neighbouring word extends. Each word of a run occurs in it LEAST_TIMES times or
more, so a word that occurs less often within its segment (at first the whole text) belongs to no run and splits the segment;
pieces under LEAST_WORDS go, and what is left is split again until nothing changes. Prose vanishes after two or three rounds.

What survives is scanned for lags at scales k = 1, 2, 4, ...: equal grams of k words are named alike (a gram of 2k words is the pair
of its halves' names), and each place gets the lag to its gram's next place. Within a run of period q, k / 2 < q <= k, that lag is q
and never less: a gram as long as the period recurs only after whole periods. Outside of it, it is another one. A stretch of places
with one lag q therefore is a run, whole and exact, and the work is n log n whatever the texts hold.

A segment is never longer than its text; a text is handled within one task, texts of any length alike. Null text has no words, no
runs, and a null collapsed text; an empty or blank one collapses to an empty text. Repeated rows, null keys and columns of any name
are kept as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from medspan.functions.search import let
from medspan.llm.common import quoted, table
from medspan.llm.hashing import SPACE, chunks

LEAST_WORDS, LEAST_TIMES = 24, 3

RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
_RUN = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])


def bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and each text's first word (one more entry). No word crosses from one text into the next."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[at] = True
    before, after = np.concatenate([[False], solid[:-1]]), np.concatenate([solid[1:], [False]])
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, the same for equal bytes and for no others."""
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~SPACE[data]])])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A dense number of each value, and how often it occurs."""
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return inverse, counts[inverse]


def _cut(pos: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Dense numbers of the stretches of neighbouring places of one segment."""
    return np.cumsum(np.concatenate([[True], (np.diff(pos) != 1) | (np.diff(seg) != 0)])) - 1 if len(pos) else seg


def split(word: np.ndarray, text: np.ndarray, least_words: int, least_times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that recursive splitting leaves, and the segment of each. text: the text of each word, ascending."""
    pos, seg = np.arange(len(word)), text
    done: list[tuple[np.ndarray, np.ndarray]] = []
    width = int(word.max()) + 1 if len(word) else 1
    while len(pos):
        seg = _cut(pos, seg)
        long = np.bincount(seg)[seg] >= least_words
        pos, seg = pos[long], seg[long]
        rare = _numbered(seg * width + word[pos])[1] < least_times
        shaken = np.bincount(seg, rare, minlength=1)[seg] > 0 if len(seg) else rare
        if not shaken.all():
            done.append((pos[~shaken], seg[~shaken]))
        on = shaken & ~rare
        pos, seg = pos[on], seg[on]
    if not done:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    # segments of different rounds may bear one number, but none of them are neighbours: a rare word lies between
    at = np.concatenate([p for p, _ in done])
    order = np.argsort(at)
    at = at[order]
    return at, _cut(at, text[at])


def scan(word: np.ndarray, seg: np.ndarray, least_words: int, least_times: int) -> np.ndarray:
    """(first, length, period) of all runs within segments that stand one after the other."""
    n = len(word)
    if not n:
        return np.zeros((0, 3), dtype=np.int64)
    size = np.bincount(seg)
    end, size = np.cumsum(size)[seg], size[seg]
    found = []
    k, active = 1, np.arange(n)
    gram = np.full(n, -1)
    name, counts = _numbered(seg * (int(word.max()) + 1) + word)
    while len(active):
        gram[active] = name
        order = np.argsort(name, kind="stable")
        place, own = active[order], name[order]
        lag = np.diff(place)
        near = (np.diff(own) == 0) & (lag > k // 2) & (lag <= k)
        first, lag = place[:-1][near], lag[near]
        order = np.argsort(first)
        first, lag = first[order], lag[order]
        if len(first):
            fresh = np.concatenate([[True], (np.diff(first) != 1) | (np.diff(lag) != 0)])
            heads = np.flatnonzero(fresh)
            q = lag[heads]
            length = np.diff(np.concatenate([heads, [len(first)]])) + k + q - 1
            keep = length >= np.maximum(least_words, least_times * q)
            found.append(np.stack([first[heads], length, q], axis=1)[keep])
        again = np.zeros(n, dtype=bool)
        again[active[counts > 1]] = True  # a gram that occurs once is in no longer one that recurs
        fits = (active + 2 * k <= end[active]) & (least_times * (k + 1) <= size[active]) & again[active]
        active = active[fits]
        active = active[again[active + k]]
        name, counts = _numbered(gram[active] * (n + 1) + gram[active + k])
        k *= 2
    return np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)


def _collapsed(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and beginnings of the texts of kept words, one blank between two."""
    solid = ~SPACE[data]
    out = np.where(solid, data, np.uint8(32))
    keep = np.zeros(len(data) + 1, dtype=bool)
    keep[:-1][solid] = np.repeat(kept, ends - starts)
    limit = at[np.searchsorted(at, starts, side="right")]
    keep[ends[kept & (ends < limit)]] = True
    total = np.concatenate([[0], np.cumsum(keep[:-1])])
    last = np.flatnonzero(keep)[total[at[1:]][total[at[1:]] > total[at[:-1]]] - 1]
    keep[last[~solid[last]]] = False
    total = np.concatenate([[0], np.cumsum(keep[:-1])])
    return out[keep[:-1]], total[at]


def _column(texts: pa.Array, least_words: int, least_times: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """n_words, runs and collapsed text of a column of texts."""
    words, sizes, runs, pieces, lengths = [], [], [], [], []
    for _, data, at in chunks(texts):
        starts, ends, first = bounds(data, at)
        text = np.repeat(np.arange(len(at) - 1), np.diff(first))
        word = names(data, starts, ends)
        place, seg = split(word, text, least_words, least_times)
        found = scan(word[place], seg, least_words, least_times)
        found[:, 0] = place[found[:, 0]]
        found = found[np.lexsort((found[:, 2], found[:, 0]))]
        gone = np.zeros(len(word) + 1, dtype=np.int64)
        np.add.at(gone, found[:, 0] + found[:, 2], 1)
        np.add.at(gone, found[:, 0] + found[:, 1], -1)
        out, begins = _collapsed(data, at, starts, ends, np.cumsum(gone)[:-1] == 0)
        owner = text[found[:, 0]] if len(found) else np.zeros(0, dtype=np.int64)
        found[:, 0] -= first[owner]
        words.append(np.diff(first))
        sizes.append(np.bincount(owner, minlength=len(at) - 1))
        runs.append(found)
        pieces.append(out)
        lengths.append(np.diff(begins))
    whole = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, dtype=kind)
    offsets = lambda x, kind: np.concatenate([[0], np.cumsum(whole(x, np.int64))]).astype(kind)
    empty = pa.array(np.asarray(texts.is_null()))
    each = pa.StructArray.from_arrays([pa.array(whole([r[:, i] for r in runs], np.int64)) for i in range(3)], names=[f.name for f in _RUN])
    lists = pa.ListArray.from_arrays(pa.array(offsets(sizes, np.int32)), each)
    plain = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(offsets(lengths, np.int64)), pa.py_buffer(whole(pieces, np.uint8))])
    return pa.array(whole(words, np.int64)), lists, pc.if_else(empty, None, plain).cast(pa.string())


def collapse(docs: DataFrame, text: str = "text", least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """docs with three more columns: n_words; runs, an array of (start, length, period) by start, then period, in words from 0; and
    collapsed, the words joined by one blank, less those that a run holds after its first period. A column of one of these names
    gives way. least_times is 3 or more."""
    if least_times < 3:
        raise ValueError("runs repeat three times or more")
    carried = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]
    own = [f"c{i}" for i in range(len(carried))]
    rows = docs.select(*[quoted(c).alias(n) for c, n in zip(carried, own)], quoted(text).alias("text"))
    more = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = _column(batch.column("text"), least_words, least_times)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], *made], names=[*own, *[f.name for f in more]])

    out = rows.mapInArrow(run, StructType([rows.schema[n] for n in own] + more))
    return out.select(*[F.col(n).alias(c) for c, n in zip(carried, own)], *[f.name for f in more])


def planted(key: Column, text: Column) -> Column:
    """text, or for a tenth of the keys its words repeating from some word on, joined by blanks."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(a.alias("a"), p.alias("p")), lambda x: F.transform(words, lambda w, i: F.when(i < x["a"], w).otherwise(F.get(words, (x["a"] + F.pmod(i - x["a"], x["p"])).cast("int")))))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.isNotNull(), F.array_join(let(words, repeated), " ")).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = collapse(docs).select("doc_id", "runs", "collapsed")
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.reduce("runs", F.lit(None).cast(RUN), lambda held, x: F.when(held.isNull() | more(x, held), x).otherwise(held))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")), F.lit("\n")))
    out = found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )
    return out.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )

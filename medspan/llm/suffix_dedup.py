"""Suffix-array dedup: remove every byte covered by a LENGTH-byte string that also starts anywhere else.

External induced sorting, with Spark's sorter (sorted runs spilled to disk and merged through a priority queue) as the external
queue, and suffix tuples that carry their bytes and common-prefix values:

1. Sampling. Of the grams of GRAM bytes inside a LENGTH-byte string the smallest by hash is its anchor. Equal strings have
   equal anchors at equal offsets, so only suffixes at anchors (about two in LENGTH - GRAM bytes) are sorted, the others
   induced. Anchors whose gram occurs once are dropped: nothing there repeats.
2. Names. All positions of a text with the same anchor form a range; ranges of a gram that cover the same bytes get one name
   and repeat as a whole. One of them stands for the rest from here on.
3. Sorting and induction. The ranges that differ somewhere from all others of their gram become suffix tuples (name, bytes
   after the anchor, bytes before it), sorted by Spark. Neighbours' common-prefix values are counted on the bytes; then the
   order and the common prefixes of the suffixes one byte further left are induced from those before, offset by offset.
   Positions with LENGTH bytes in common with a neighbour repeat.
4. Recursion. A gram with more than HELD ranges that differ never comes into one task: its positions are named anew, each by
   all bytes of its string, and counted by Spark. After that a name covers a whole string, so one round is enough. The result
   does not depend on HELD.

Only agreement over LENGTH bytes is asked for, so suffixes are sorted as far as that. Names of ranges are 64-bit hashes compared within a
64-bit gram hash; rows are told apart by 128 bits of key and text. Matches never cross documents.

Very long texts are anchored in time in proportion, and only their anchors' ranges are shuffled. Null text counts as empty. Texts shorter than LENGTH bytes keep everything. Repeated rows are documents of their own, so
their bytes repeat. A null doc_id is an ordinary value. Extra columns, whatever their names, are ignored by `spans` and kept
by `dedup`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import durable, quoted, table
from medspan.llm.hashing import PLAIN, U64, bytes_of, chunks, mix, powers, prefix

LENGTH, GRAM = 400, 128
# the shortest repeat that fifty words make, and its gram
PASSAGE, PASSAGE_GRAM = 200, 48
HELD, SHARD, MOST_BROADCAST = 32_768, 4096, 200_000
OWN, REST = "suffix dedup: row", "suffix dedup: rest"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _smallest(values: np.ndarray, window: int) -> np.ndarray:
    """The minimum of each `window` values in a row, by running minima from both ends of blocks."""
    n = len(values)
    blocks = -(-n // window)
    padded = np.full(blocks * window, np.iinfo(np.uint64).max, dtype=U64)
    padded[:n] = values
    shaped = padded.reshape(blocks, window)
    left = np.minimum.accumulate(shaped, axis=1).ravel()
    right = np.minimum.accumulate(shaped[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - window + 1
    return np.minimum(right[:m], left[window - 1 : window - 1 + m])


def _ranges(length: int, gram: int):
    """(gram, u, v, lo, hi, at, name): the positions lo..hi of a text whose strings have the same anchor, at `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
            for first, data, at in chunks(_column(batch, "text")):
                n = len(data)
                if n < length:
                    continue
                h, inverse = prefix(data, PLAIN), powers(n)[1]
                grams = mix((h[gram:] - h[:-gram]) * inverse[: n - gram + 1])
                bits = U64(n.bit_length())
                ranked = (grams >> bits << bits) | np.arange(len(grams), dtype=U64)
                anchor = (_smallest(ranked, length - gram + 1) & ((U64(1) << bits) - U64(1))).astype(np.int64)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(anchor)]
                valid = np.arange(len(anchor)) + length <= at[text + 1]
                p = np.flatnonzero(valid)
                if not len(p):
                    continue
                a, t = anchor[p], text[p]
                fresh = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])]))
                last = np.concatenate([fresh[1:], [len(p)]]) - 1
                lo, hi, a, t = p[fresh], p[last], a[fresh], t[fresh]
                end = hi + length
                name = mix((h[end] - h[lo]) * inverse[lo] + mix((end - lo).astype(U64) * U64(1 << 32) + (a - lo).astype(U64)))
                base = at[t]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[a].astype(np.int64)), pa.array(u[first + t]), pa.array(v[first + t]), *(pa.array((x - base).astype(np.int64)) for x in (lo, hi, a)), pa.array(name.astype(np.int64))],
                    names=["gram", "u", "v", "lo", "hi", "at", "name"],
                )

    return run


RANGES = "gram long, u long, v long, lo long, hi long, at long, name long"
TUPLES = "name long, u long, v long, at long, open boolean, first long, last long, left binary, right binary"


def _tuples(length: int):
    """The suffix tuple of each wanted range of a text: its gram as name, the bytes before and after its anchor that its strings
    cover, and which offsets before the anchor its positions have."""
    columns = [c.split()[0] for c in TUPLES.split(", ")]
    types = (*[pa.int64()] * 4, pa.bool_(), pa.int64(), pa.int64(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = _column(batch, "u").to_pylist(), _column(batch, "v").to_pylist()
            texts = _column(batch, "text")
            rows, size = [], 0
            for i, wanted in enumerate(_column(batch, "wanted").to_pylist()):
                data = (texts[i].as_py() or "").encode()
                for w in wanted:
                    lo, hi, at = w["lo"], w["hi"], w["at"]
                    rows.append((w["gram"], u[i], v[i], at, w["open"], at - hi, at - lo, data[lo:at], data[at : hi + length]))
                    size += hi + length - lo
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=columns)

    return run


def _common(right: list[bytes], group: np.ndarray) -> np.ndarray:
    """How many bytes each context has in common with the one before it, in bytewise order; 0 where a group begins."""
    out = np.zeros(len(right), dtype=np.int64)
    for i in range(1, len(right)):
        if group[i] == group[i - 1]:
            x, y = right[i - 1], right[i]
            n = min(len(x), len(y))
            if x[:n] == y[:n]:
                out[i] = n
            else:
                differ = np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n)
                out[i] = int(differ.argmax())
    return out


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The minimum of values[lo + 1 .. hi] for each pair lo < hi, from minima of stretches of doubling length."""
    span = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.empty(len(lo), dtype=values.dtype)
    level = values
    for k in range(int(span.max()) + 1 if len(span) else 0):
        if k:
            half = 1 << (k - 1)
            level = np.minimum(level[:-half], level[half:])
        at = np.flatnonzero(span == k)
        out[at] = np.minimum(level[lo[at] + 1], level[hi[at] - (1 << k) + 1])
    return out


def _induced(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, offset before its anchor) of every repeated position, of whole groups of suffix tuples sorted by (name, right).

    The order of the suffixes one byte further left is induced from the order before: by the new first byte, ties as they
    were. Two neighbours have one byte more in common than the least common prefix that lay between them; those with
    `length` bytes in common are repeats."""
    name = _column(batch, "name").to_numpy(zero_copy_only=False)
    right, left = _column(batch, "right").to_pylist(), _column(batch, "left").to_pylist()
    first, last = (_column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("first", "last"))
    group = np.cumsum(np.concatenate([[0], name[1:] != name[:-1]])) if len(name) else name
    reach = np.array([len(x) for x in left], dtype=np.int64)
    begin = np.cumsum(reach) - reach
    before = np.frombuffer(b"".join(left), dtype=np.uint8)
    order, common, live = np.arange(len(name)), _common(right, group), np.ones(len(name), dtype=bool)
    rows, offsets = [], []
    for offset in range(int(reach.max(initial=0)) + 1):
        if offset:
            alive = np.flatnonzero(live & (reach[order] >= offset))
            if len(alive) < 2:
                break
            byte = before[begin[order[alive]] + reach[order[alive]] - offset].astype(np.int64)
            key = group[order[alive]] * 256 + byte
            by = np.argsort(key, kind="stable")
            key, at = key[by], alive[by]
            same = np.flatnonzero(key[1:] == key[:-1]) + 1
            shared = np.zeros(len(at), dtype=np.int64)
            shared[same] = 1 + _least_between(common, at[same - 1], at[same])
            order, common = order[at], shared
        best = common.copy()
        best[:-1] = np.maximum(best[:-1], common[1:])
        # a match of `length` bytes at a later offset has all but the bytes in between here already
        live = best >= length - (last[order] - offset)
        here = order[best >= length]
        here = here[(first[here] <= offset) & (offset <= last[here])]
        rows.append(here)
        offsets.append(np.full(len(here), offset, dtype=np.int64))
    return (np.concatenate(rows), np.concatenate(offsets)) if rows else (np.zeros(0, dtype=np.int64),) * 2


def _matched(length: int):
    """(u, v, lo, hi): runs of repeated positions among suffix tuples sorted by (name, right), some whole groups at a time."""

    def shard(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, offset = _induced(batch, length)
        keep = _column(batch, "open").to_numpy(zero_copy_only=False)[row]
        row, offset = row[keep], offset[keep]
        at = _column(batch, "at").to_numpy(zero_copy_only=False)[row] - offset
        by = np.lexsort((at, row))
        row, at = row[by], at[by]
        fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]) if len(row) else np.zeros(0, dtype=bool)
        lo = np.flatnonzero(fresh)
        hi = np.concatenate([lo[1:], [len(row)]]).astype(np.int64) - 1 if len(lo) else lo
        u, v = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (u[row[lo]], v[row[lo]], at[lo], at[hi])], names=["u", "v", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, SHARD):
                part = batch.slice(at, SHARD)
                name = _column(part, "name").to_numpy(zero_copy_only=False)
                begins = np.flatnonzero(np.concatenate([[len(held) == 0 or _column(held[-1], "name")[-1].as_py() != name[0]], name[1:] != name[:-1]]))
                cut = int(begins[-1]) if len(begins) else 0
                if rows + cut >= SHARD // 2 and (cut or len(begins)):
                    yield shard(pa.Table.from_batches([*held, part.slice(0, cut)]).combine_chunks().to_batches()[0])
                    held, rows, part = [], 0, part.slice(cut)
                held.append(part)
                rows += part.num_rows
        if rows:
            yield shard(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return run


def _positions(length: int):
    """(gram, name, u, v, p, open) for every position of suffix tuples, named by all bytes of its string and its offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 512):
                part = batch.slice(begin, 512)
                left, right = _column(part, "left").to_pylist(), _column(part, "right").to_pylist()
                at = _column(part, "at").to_numpy(zero_copy_only=False)
                texts = pa.array([x + y for x, y in zip(left, right)], pa.large_binary())
                reach = np.array([len(x) for x in left], dtype=np.int64)
                for first, data, starts in chunks(texts):
                    h, inverse = prefix(data, PLAIN), powers(len(data))[1]
                    size = np.maximum(np.diff(starts) - length + 1, 0)
                    row = np.repeat(np.arange(len(size)), size)
                    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                    p = starts[row] + place
                    row += first
                    name = mix((h[p + length] - h[p]) * inverse[p] ^ mix((reach[row] - place).astype(U64)))
                    own = [_column(part, c).take(pa.array(row)) for c in ("name", "u", "v", "open")]
                    yield pa.RecordBatch.from_arrays([own[0], pa.array(name.astype(np.int64)), own[1], own[2], pa.array(at[row] - reach[row] + place), own[3]], names=["gram", "name", "u", "v", "p", "open"])

    return run


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts that ids (u, v, once each) name; ids go out as a broadcast when there are few, so that no other text moves."""
    ids = ids.select("u", "v")
    return docs.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, ["u", "v"], "left_semi")


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (one for each text) with the text."""
    return _only(docs, rows).join(rows, ["u", "v"])


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, held: int = HELD) -> DataFrame:
    """u, v, lo, hi: runs of positions (of rows u, v, text) whose `length` bytes also start anywhere else."""
    # what a group is counted by is written before it is joined: a hot key is then split by Spark's skew join
    ranges = durable(docs.mapInArrow(_ranges(length, gram), RANGES))
    twice = durable(ranges.groupBy("gram").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("gram"))
    ranges = durable(ranges.join(twice, "gram"))

    equal = durable(ranges.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("u", "v", "lo", "hi", "at")).alias("one")))
    found = ranges.join(durable(equal.filter("c > 1").select("gram", "name")), ["gram", "name"]).select("u", "v", "lo", "hi")
    mixed = durable(equal.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("c").alias("least")).filter("kinds > 1 and least = 1").select("gram", (F.col("kinds") > held).alias("large")))
    left = durable(equal.join(mixed, "gram").select("gram", "large", (F.col("c") == 1).alias("open"), "one.*"))

    def tuples(some: DataFrame) -> DataFrame:
        wanted = durable(some.groupBy("u", "v").agg(F.collect_list(F.struct("gram", "lo", "hi", "at", "open")).alias("wanted")))
        return _with_text(docs, wanted).select("u", "v", "text", "wanted").mapInArrow(_tuples(length), TUPLES)

    small = tuples(left.filter("not large")).repartition("name").sortWithinPartitions("name", "right")
    found = found.unionByName(small.mapInArrow(_matched(length), "u long, v long, lo long, hi long"))
    if mixed.filter("large").limit(1).count():
        each = durable(tuples(left.filter("large"))).mapInArrow(_positions(length), "gram long, name long, u long, v long, p long, open boolean")
        again = durable(each.groupBy("gram", "name").agg(F.count(F.lit(1)).alias("c"), F.bool_or("open").alias("any_open")).filter("c > 1 and any_open").select("gram", "name"))
        found = found.unionByName(each.filter("open").join(again, ["gram", "name"]).select("u", "v", F.col("p").alias("lo"), F.col("p").alias("hi")))
    return found


def _cut(length: int):
    """What is left of each text: its bytes, bytes removed, removed runs, and the rest with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = bytes_of(_column(batch, "text"))
            rest, sha = [], []
            for i, found in enumerate(_column(batch, "gone").to_pylist()):
                own, end, kept = data[at[i] : at[i + 1]].tobytes(), 0, []
                for span in found:
                    kept.append(own[end : span["lo"]])
                    end = span["hi"]
                rest.append(b"".join(kept) + own[end:])
                sha.append(hashlib.sha256(rest[-1]).hexdigest())
            counts = [_column(batch, c) for c in ("u", "v", "removed", "spans")]
            yield pa.RecordBatch.from_arrays([*counts, pa.array(rest, pa.binary()), pa.array(sha, pa.string())], names=["u", "v", "removed", "spans", "rest", "sha"])

    return run


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """A column of its own that names a row by key and text, by 64 bits each: equal rows are one text, which occurs as often."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(OWN, F.struct(F.xxhash64(F.lit(0), F.col(key)).alias("u"), F.xxhash64(F.col(key).isNull(), whole).alias("v")))


def covered(docs: DataFrame, length: int, gram: int, held: int = HELD) -> DataFrame:
    """u, v, gone: array of (lo, hi), the bytes covered by repeats, in order and apart; with removed and spans, their sums."""
    found = repeated(docs, length, gram, held).select("u", "v", F.struct("lo", (F.col("hi") + length).alias("hi")).alias("s"))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    wider = lambda acc, x: F.array(F.struct(last(acc)["lo"].alias("lo"), F.greatest(last(acc)["hi"], x["hi"]).alias("hi")))
    joined = lambda acc, x: F.when((F.size(acc) > 0) & (x["lo"] <= last(acc)["hi"]), F.concat(F.slice(acc, F.lit(1), F.greatest(F.lit(0), F.size(acc) - 1)), wider(acc, x))).otherwise(F.concat(acc, F.array(x)))
    merged = F.aggregate(F.array_sort(F.collect_set("s")), F.array().cast("array<struct<lo:bigint,hi:bigint>>"), joined)
    out = found.groupBy("u", "v").agg(merged.alias("gone"))
    return out.select("u", "v", "gone", F.aggregate("gone", F.lit(0).cast("long"), lambda n, x: n + x["hi"] - x["lo"]).alias("removed"), F.size("gone").cast("long").alias("spans"))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return _identified(docs, key, text).select(f"{OWN}.u", f"{OWN}.v", F.col(text).alias("text"))


def spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, held: int = HELD) -> DataFrame:
    """u, v, removed, spans, rest (bytes), sha for each text of rows (u, v, text) that loses bytes."""
    gone = durable(covered(rows, length, gram, held))
    texts = _with_text(rows.filter(F.octet_length("text") >= length), gone).select("u", "v", "text", "gone", "removed", "spans").dropDuplicates(["u", "v"])
    return texts.mapInArrow(_cut(length), "u long, v long, removed long, spans long, rest binary, sha string")


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, held: int = HELD) -> DataFrame:
    """docs with repeated bytes cut from `text`; bytes of a character cut in half are dropped with it."""
    cut = durable(spans(_rows(docs, key, text), length, gram, held).select(F.struct("u", "v").alias(OWN), F.col("rest").alias(REST)))
    out = _identified(docs, key, text).join(cut, OWN, "left")
    # make_valid puts U+FFFD where a character was cut
    clean = F.regexp_replace(F.expr(f"make_valid_utf8(cast(`{REST}` as string))"), "\ufffd", "")
    return out.withColumn(text, F.when(F.col(REST).isNull(), F.col(text)).otherwise(clean)).select(*map(quoted, docs.columns))


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """passage_bytes: bytes covered by repeats of PASSAGE bytes. LENGTH, which the contract fixes, is longer than most passages
    of fifty words, so that these show there only. A text without passages has no longer repeats either."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _rows(docs, "doc_id", "text")
    passages = durable(covered(rows, PASSAGE, PASSAGE_GRAM).select("u", "v", F.col("removed").alias("passage_bytes")))
    cut = durable(spans(durable(_only(rows, passages))).drop("rest"))
    t = F.coalesce("text", F.lit(""))
    own = _identified(docs, "doc_id", "text").select(f"{OWN}.*", "doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("own"))
    out = own.join(passages, ["u", "v"], "left").join(cut, ["u", "v"], "left")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("sha", "own").alias("kept_sha256"),
        F.coalesce("passage_bytes", F.lit(0)).cast("long").alias("passage_bytes"),
    )

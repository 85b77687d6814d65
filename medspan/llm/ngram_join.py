"""N-gram Jaccard join by T-occurrence search with the DivideSkip split of inverted lists.

A document's set is its distinct word shingles. Two documents link when intersection / union reaches the threshold; so they
share at least T = ceil(threshold * n) of the n shingles of either. Inverted lists are told apart by length: a shingle's list
is long when at least `long_list` documents hold it, else short. Shingles are ordered short lists first, long lists by length
after them. Of a document's first n - T + 1 shingles in that order any partner holds one. That is the split DivideSkip makes with
T - 1 long lists a query: the n - T + 1 short ones are merged, where one occurrence is then enough to be a candidate, so that
no counts are kept, and the T - 1 long ones are only probed, by binary search in the other document's sorted shingles, until
the overlap is known. The merge is Spark's sort of all (shingle, document) rows: spilled runs, merged through a priority queue,
for all queries at once. A pair met on a list at places i and j can share at most min(n_a - i, n_b - j) more, which must reach
the overlap that the sizes ask for: that drops most pairs of large groups before any text is read. The rest is bounded again by
counts of shingles in buckets, since sets share at most the sum of the smaller counts; only what passes is compared whole.

Equal sets are one class. Only components are asked for, so pairs that are already connected need no test: first each list's
members are tested against the list's most common member (a star, linear in the list), and then only pairs between different
components that pass the bounds are tested, all of them: no link between different texts is lost. Components come from
alternating large-star and small-star rounds. Texts, links and components stay in Spark.

What passes through the driver or is broadcast: the long lists' names and lengths, at most MOST_LONG of them, since a list is
long only from total / MOST_LONG entries up; and ids of documents to compare, when fewer than MOST_BROADCAST (else a shuffle).

Null, empty or blank text has no set and links with nothing. A document without an id has links through equal sets only.
Repeated rows are one class. A very long text is one long set: hashed by the slice, sorted within one task, and split among tasks where
lists are merged. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import durable, slices, table
from medspan.llm.hashing import U64, distinct_sets, set_key

MOST_LONG, LEAST_LONG, MOST_BROADCAST = 1 << 20, 64, 200_000
NAME_BITS, BUCKETS = 44, 256
# What a Python worker holds at once beside the batch that it is given: names to count, shingles to list, known sets, rows
MOST_NAMES, MOST_LISTED, MOST_SEEN, SOME_ROWS = 1_000_000, 200_000, 100_000, 500


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _classes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(len(x), set_key(x)) for x in distinct_sets(_column(batch, "text"), k)]
            yield pa.RecordBatch.from_arrays([_column(batch, "doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], names=["doc_id", "n", "node"])

    return run


def _names(k: int, parts: int):
    """Shingle names of a task's documents, counted, packed by part: a row for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: list[np.ndarray]) -> pa.RecordBatch:
            names, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(names, (np.arange(parts + 1, dtype=U64) << U64(NAME_BITS)) // U64(parts))
            ids, ones, many = [], [], []
            for p in range(parts):
                x, c = names[cut[p] : cut[p + 1]], counts[cut[p] : cut[p + 1]]
                base = (U64(p) << U64(NAME_BITS)) // U64(parts)
                low = (x - base).astype(np.uint64)
                ids.append(p)
                # 40-bit offsets of names met once, in five planes that compress well; (name, count) pairs of the others
                once = low[c == 1]
                ones.append(b"".join(((once >> U64(8 * b)) & U64(255)).astype(np.uint8).tobytes() for b in range(5)))
                many.append(np.stack([low[c > 1], c[c > 1].astype(U64)]).tobytes())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(ones, pa.binary()), pa.array(many, pa.binary())], names=["part", "ones", "many"])

        held, size = [], 0
        for batch in batches:
            for x in distinct_sets(_column(batch, "text"), k):
                held.append(x >> U64(64 - NAME_BITS))
                size += len(x)
                if size >= MOST_NAMES:
                    yield flush(held)
                    held, size = [], 0
        if size:
            yield flush(held)

    return run


def _long(parts: int, least: int):
    """Names counted over all tasks: those with at least `least` entries. The rows of a part come together, sorted."""

    def count(p: int, ones: list[bytes], many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        names, counts = [], []
        for o in ones:
            planes = np.frombuffer(o, dtype=np.uint8).reshape(5, -1).astype(U64)
            names.append(sum((planes[b] << U64(8 * b) for b in range(5)), np.zeros(planes.shape[1], dtype=U64)))
            counts.append(np.ones(planes.shape[1], dtype=np.int64))
        for m in many:
            two = np.frombuffer(m, dtype=U64).reshape(2, -1)
            names.append(two[0])
            counts.append(two[1].astype(np.int64))
        names, counts = np.concatenate(names), np.concatenate(counts)
        order = np.argsort(names, kind="stable")
        names, counts = names[order], counts[order]
        if not len(names):
            return names, counts
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        total = np.add.reduceat(counts, first)
        return names[first][total >= least] + ((U64(p) << U64(NAME_BITS)) // U64(parts)), total[total >= least]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ones, many = None, [], []

        def emit():
            names, counts = count(at, ones, many)
            return pa.RecordBatch.from_arrays([pa.array(names.astype(np.int64)), pa.array(counts)], names=["name", "entries"])

        for batch in batches:
            for p, o, m in zip(*(_column(batch, c).to_pylist() for c in ("part", "ones", "many"))):
                if at is not None and p != at:
                    yield emit()
                    ones, many = [], []
                at = p
                ones.append(o)
                many.append(m)
        if at is not None:
            yield emit()

    return run


def _lists(k: int, num: int, den: int, names: np.ndarray, entries: np.ndarray):
    """(token, node, meta) for each of a document's first n - T + 1 shingles; meta packs n, the place, how common the
    document's shingles are, and whether the list is long. A place past its bits is cut short, which only loosens the bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(token).astype(np.int64)), *(pa.array(np.concatenate(c)) for c in (node, meta))], names=["token", "node", "meta"])

        seen: set[int] = set()
        for batch in batches:
            token, node, meta, size = [], [], [], 0
            for x in distinct_sets(_column(batch, "text"), k):
                n = len(x)
                if not n:
                    continue
                key = set_key(x)
                if key in seen:
                    continue
                if len(seen) < MOST_SEEN:
                    seen.add(key)
                p = n - -(-num * n // den) + 1
                is_long = np.zeros(n, dtype=bool)
                if len(names):
                    short = x >> U64(64 - NAME_BITS)
                    at = np.minimum(np.searchsorted(names, short), len(names) - 1)
                    is_long = names[at] == short
                many = int(is_long.sum())
                if many:
                    inner = np.lexsort((x[is_long], entries[at[is_long]]))
                    first = np.concatenate([x[~is_long], x[is_long][inner]])[:p]
                else:
                    first = x[:p].copy()
                token.append(first)
                node.append(np.full(p, key, dtype=np.int64))
                place = np.minimum(np.arange(p, dtype=np.int64), PLACES)
                meta.append((np.int64(n) << 32) | (place << 11) | (np.int64(1000 * many // n) << 1) | (np.arange(p) >= n - many))
                size += p
                if size >= MOST_LISTED:
                    yield flush()
                    token, node, meta, size = [], [], [], 0
            if token:
                yield flush()

    return run


LIST_SCHEMA, PLACES = "token long, node long, meta long", (1 << 20) - 1


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, node): those of long lists, and of tokens that two nodes have. One row is held back."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        if n < 2:
            held = batch if n else held
            continue
        token, node = (_column(batch, c).to_numpy(zero_copy_only=False) for c in ("token", "node"))
        many = (_column(batch, "meta").to_numpy(zero_copy_only=False) & 1) == 1
        # the last two rows of a token may be needed to judge what follows: keep from the last token's first row if short
        same = token[1:] == token[:-1]
        repeat = np.concatenate([[False], same & (node[1:] == node[:-1])])
        start = int(np.searchsorted(token, token[-1]))
        cut = start if n - start < 65_536 and start > 0 else (0 if start == 0 and n < 65_536 else n - 1)
        keep = _of_two(token, many, repeat)
        keep[cut:] = False
        yield batch.filter(pa.array(keep))
        held = batch.slice(cut)
    if held is not None:
        token, node = (_column(held, c).to_numpy(zero_copy_only=False) for c in ("token", "node"))
        many = (_column(held, "meta").to_numpy(zero_copy_only=False) & 1) == 1
        repeat = np.concatenate([[False], (token[1:] == token[:-1]) & (node[1:] == node[:-1])])
        yield held.filter(pa.array(_of_two(token, many, repeat)))


def _of_two(token: np.ndarray, many: np.ndarray, repeat: np.ndarray) -> np.ndarray:
    fresh = np.flatnonzero(~repeat)
    t = token[fresh]
    same = t[1:] == t[:-1]
    two = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    keep = np.zeros(len(token), dtype=bool)
    keep[fresh] = two
    return (keep | many) & ~repeat


def _overlap(num: int, den: int):
    """Of (a, b, sa, sb): the pairs that reach the threshold, by binary search of the smaller set in the larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_column(batch, "sa"), _column(batch, "sb")):
                x, y = (np.frombuffer(s.as_buffer(), dtype=U64) for s in (x, y))
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                both = 0
                if len(small):
                    both = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum())
                keep.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component of the edges (a, b), by alternating star rounds."""
    e = durable(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda x: x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    before = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = durable(small.distinct())
        after = state(e)
        if tuple(after) == tuple(before):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = after


def _sets(k: int):
    """node, shingles, counts of each row (node, text) whose text has the set that the node names: its sorted shingles, and how many of
    them fall into each of BUCKETS buckets by hash. Rows of one id may have other texts, which are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SOME_ROWS):
                some = batch.slice(at, SOME_ROWS)
                nodes, sets, counts = [], [], []
                for node, x in zip(_column(some, "node").to_pylist(), distinct_sets(_column(some, "text"), k)):
                    if set_key(x) == node:
                        nodes.append(node)
                        sets.append(x.tobytes())
                        # planes of bytes: the upper ones are all zero, mostly, and shuffle compressed
                        counts.append(np.bincount((x & U64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary()), pa.array(counts, pa.binary())], names=["node", "shingles", "counts"])

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """node, shingles, counts for each node that a pair names."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = durable(nodes.join(classes, "node").select("node", F.col("rep").alias("doc_id")))
    if wanted.count() <= MOST_BROADCAST:
        wanted = F.broadcast(wanted)
    found = docs.join(wanted, "doc_id").select("node", "text").mapInArrow(_sets(k), "node long, shingles binary, counts binary")
    return durable(found.dropDuplicates(["node"]))


def _possible(num: int, den: int):
    """Of (a, b, ca, cb): the pairs whose overlap may reach the threshold, as it is at most the sum of the smaller counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, SOME_ROWS):
                some = batch.slice(at, SOME_ROWS)
                counts = lambda c: np.frombuffer(b"".join(_column(some, c).to_pylist()), dtype=np.uint8).reshape(-1, 4, BUCKETS)  # noqa: B023, E731
                whole = lambda c: sum(c[:, i].astype(np.int64) << (8 * i) for i in range(4))
                x, y = (whole(counts(c)) for c in ("ca", "cb"))
                most = np.minimum(x, y).sum(axis=1)
                keep.append(den * most >= num * (x.sum(axis=1) + y.sum(axis=1) - most))
            yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep or [np.zeros(0, dtype=bool)])))

    return run


def _linked(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs that link: first by bucket counts, then, of those that may, by the sets themselves."""
    sets = _sets_of(docs, classes, pairs, k)
    sided = lambda x, c, to: x.select(F.col("node").alias(to), F.col(c).alias(f"{c[0]}{to}"))
    both = pairs.join(sided(sets, "counts", "a"), "a").join(sided(sets, "counts", "b"), "b").select("a", "b", "ca", "cb")
    some = durable(both.mapInArrow(_possible(num, den), "a long, b long"))
    whole = some.join(sided(sets, "shingles", "a"), "a").join(sided(sets, "shingles", "b"), "b").select("a", "b", "sa", "sb")
    return durable(whole.mapInArrow(_overlap(num, den), "a long, b long"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """key, n_shingles, component_id for each row: the smallest key that links (num / den or more) lead to."""
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = durable(docs.mapInArrow(_classes(k), "doc_id long, n long, node long"))
    classes = durable(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("rep")))

    parts = 2 * slices(docs.sparkSession, least=24, most=2048)
    least = max(LEAST_LONG, -(-(rows.agg(F.sum("n")).first()[0] or 0) // MOST_LONG))
    packed = docs.mapInArrow(_names(k, parts), "part int, ones binary, many binary")
    found = packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_long(parts, least), "name long, entries long").toPandas()
    order = np.argsort(found["name"].to_numpy())
    names, entries = found["name"].to_numpy()[order].astype(U64), found["entries"].to_numpy()[order]

    lists = docs.mapInArrow(_lists(k, num, den, names, entries), LIST_SCHEMA)
    dealt = lists.repartition(F.when(F.col("meta").bitwiseAND(F.lit(1)) == 1, F.xxhash64("token", "node")).otherwise(F.col("token")))
    packed = durable(dealt.sortWithinPartitions("token", "node").mapInArrow(_shared, LIST_SCHEMA))
    bits = lambda shift, width: F.shiftright("meta", shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    lists = packed.select("token", "node", bits(32, 30).alias("n"), bits(11, 20).alias("place"), bits(1, 10).alias("common"))

    need = F.ceil(num * (F.col("n") + F.col("n2")) / F.lit(num + den))
    fits = (den * F.least("n", "n2") >= num * F.greatest("n", "n2")) & (F.least(F.col("n") - F.col("place"), F.col("n2") - F.col("place2")) >= need)
    other = lambda x, *cols: x.select("token", *[F.col(c).alias(f"{c}2") for c in cols])

    lead = lists.groupBy("token").agg(F.min(F.struct((-F.col("common")).alias("c"), "node", "n", "place")).alias("l")).select("token", F.col("l.node").alias("node2"), F.col("l.n").alias("n2"), F.col("l.place").alias("place2"))
    star = lists.join(lead, "token").filter((F.col("node") != F.col("node2")) & fits)
    star = durable(star.select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct())
    links = _linked(star, docs, classes, k, num, den)

    roots = components(links)
    placed = durable(lists.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")
    near = placed.join(mixed, "token")
    across = near.join(other(near, "node", "n", "place", "root"), "token").filter((F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2")) & fits)
    across = durable(across.select(F.col("node").alias("a"), F.col("node2").alias("b")).distinct().join(star, ["a", "b"], "left_anti"))
    more = _linked(across, docs, classes, k, num, den)

    roots = components(links.unionByName(more))
    grouped = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = grouped.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = durable(grouped.join(least_id, "root").select("node", "component_id"))
    out = rows.join(of_node, "node", "left")
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))

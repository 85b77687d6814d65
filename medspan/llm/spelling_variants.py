"""Spelling variants by finite-state composition: vocabulary o one edit o vocabulary, a partition of initial states at a time.

The vocabulary is an acceptor, and two words are near if the composition of the acceptor, a transducer that makes exactly one edit
(inserts, deletes or replaces one code point), and the acceptor again accepts the pair. As long as no edit is made both sides read the
same letters, so the composition's states before the edit are the acceptor's own; an edit's place is the first letter in which two
words differ, and no pair is met twice.

Words are parted by the state that they reach from the start: the state of the shortest prefix with LIMIT words or fewer below it.
Within such a partition one task builds the minimised acceptor of what follows the prefix, composes, and enumerates the accepted
pairs. States above a partition have more words than a task should hold; for these only the edit arcs are left to follow, since all
others lead into a partition. After an edit at such a state both sides read the same rest, so the pairs are found by grouping on
state and rest: a group has one word for each letter, and one without. However many words begin alike, nothing larger is gathered.

A word's form is its near word with the largest count n (ties: the smallest in code-point order), if that is twice its own or more.
Counts double along forms, so that chains are short and end; pointers are doubled until they rest.

Null texts and documents without words give no words. With a null key, words are counted but none is garbled. Repeated rows count as
often as they stand. Very long texts are cut into words by Spark; very long words take time and memory in proportion to their length.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import durable, table

LETTERS, LEAST_LETTERS, LEAST_COUNT = r"[A-Za-zÀ-ÿ]+", 5, 3
GARBLED = 97  # one in so many of a document's different words loses a letter
LIMIT = 2048  # words of a partition
STRIDE = 8  # prefixes of so many lengths are counted at once, then of twice as many
RING = 1021


def garbled(key: Column, word: Column) -> Column:
    """word, or for one in GARBLED of the crc32 of `key:word` the word without one of its letters."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), word).cast("binary"))
    i = F.pmod(h, F.length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(GARBLED)) == 0, F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, F.length(word)))).otherwise(word)


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: the garbled words of all texts, in lower case as far as A-Z go, and how often each occurs."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    lowered = runs.select("key", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", capitals, capitals.lower())).otherwise(F.col("run")).alias("word"))
    words = lowered.select(garbled(F.col("key"), F.col("word")).alias("word")).filter(F.length("word") >= least_letters)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def placed(words: DataFrame, limit: int) -> DataFrame:
    """words with depth: the length of the shortest prefix that `limit` words or fewer have; one more than its letters where there is none."""
    base, stride, done = 0, STRIDE, []
    while True:
        upto = F.least(F.lit(base + stride - 1), F.length("word"))
        prefixes = words.select("word", F.explode(F.transform(F.sequence(F.lit(base), upto), lambda d: F.substring("word", F.lit(1), d))).alias("prefix"))
        hot = durable(prefixes.groupBy("prefix").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > limit).select("prefix"))
        deep = prefixes.join(hot, "prefix", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("deep"))
        here = durable(words.join(deep, "word", "left").select("word", "n", (F.lit(base) + F.coalesce("deep", F.lit(0))).cast("int").alias("depth")))
        base, stride = base + stride, 2 * stride
        on = (F.col("depth") == base) & (F.length("word") >= base)
        done.append(here.filter(~on))
        words = here.filter(on).select("word", "n")
        if words.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class Acceptor:
    """The minimal acyclic acceptor of sorted, distinct words. State 0 is no state; arcs[q] maps letters to states."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self.size = [0]  # words below a state
        self.sums = [0]  # bit i: some word below has letters that sum to i around a ring
        self._known: dict[tuple, int] = {}
        path: list[tuple[bool, dict[str, int]]] = [(False, {})]
        last = ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._freeze(path, last, same)
            path += [(False, {}) for _ in word[same:]]
            path[-1] = (True, path[-1][1])
            last = word
        self._freeze(path, last, 0)
        self.start = self._state(*path[0])

    def _freeze(self, path: list, word: str, upto: int) -> None:
        for i in range(len(word), upto, -1):
            path[i - 1][1][word[i - 1]] = self._state(*path.pop())

    def _state(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        if (q := self._known.get(key)) is None:
            q = self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
            self.size.append(final + sum(self.size[c] for c in arcs.values()))
            sums = int(final)
            for letter, c in arcs.items():
                turn, own = ord(letter) * 2654435761 % RING, self.sums[c]
                sums |= (own << turn | own >> (RING - turn)) & ((1 << RING) - 1)
            self.sums.append(sums)
        return q

    def shared(self, p: int, q: int) -> Iterator[str]:
        """The words below both of two states: the composition after its edit."""
        arcs, final, sums = self.arcs, self.final, self.sums
        open_ = [(p, q, "")]
        while open_:
            p, q, read = open_.pop()
            if final[p] and final[q]:
                yield read
            there = arcs[q]
            for letter, c in arcs[p].items():
                if (d := there.get(letter)) is not None and sums[c] & sums[d]:
                    open_.append((c, d, read + letter))

    def edits(self, q: int) -> list[tuple[str, str]]:
        """Pairs below a state that differ in their first letters by one edit."""
        arcs, sums, out = self.arcs, self.sums, []
        items = list(arcs[q].items())
        for i, (a, c) in enumerate(items):
            for b, d in items[i + 1 :]:
                if sums[c] & sums[d]:
                    out += [(a + x, b + x) for x in self.shared(c, d)]
            if self.final[q] and self.final[c]:
                out.append((a, ""))
            below = arcs[c]
            for b, d in items:
                if b != a and (e := below.get(b)) is not None and sums[e] & sums[d]:
                    out += [(a + b + x, b + x) for x in self.shared(e, d)]
        return out

    def pairs(self) -> Iterator[tuple[str, str]]:
        """All pairs of words one edit apart, each once."""
        made: dict[int, list[tuple[str, str]]] = {}
        path: list[str] = []
        open_: list[tuple[int, int, str]] = [(self.start, 0, "")]
        while open_:
            q, depth, letter = open_.pop()
            del path[max(0, depth - 1) :]
            if depth:
                path.append(letter)
            if q not in made:
                made[q] = self.edits(q)
            if made[q]:
                head = "".join(path)
                yield from ((head + x, head + y) for x, y in made[q])
            open_ += [(c, depth + 1, letter) for letter, c in self.arcs[q].items() if self.size[c] > 1]


def near_of(words: list[str], counts: list[int]) -> Iterator[tuple[int, int, int]]:
    """(word, number of near words, the best of them) for sorted words that have any, as numbers."""
    number = {w: i for i, w in enumerate(words)}
    near, best = [0] * len(words), [-1] * len(words)
    rank = {i: r for r, i in enumerate(sorted(range(len(words)), key=lambda i: (-counts[i], words[i])))}
    for u, v in Acceptor(words).pairs():
        i, j = number[u], number[v]
        for x, y in ((i, j), (j, i)):
            near[x] += 1
            if best[x] < 0 or rank[y] < rank[best[x]]:
                best[x] = y
    return ((i, near[i], best[i]) for i in range(len(words)) if near[i])


FOUND = "word string, near long, best_n long, best string"


def composed(words: DataFrame) -> DataFrame:
    """FOUND for pairs within partitions: (part, rest, n) sorted by part and rest, one partition of states after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found(part: str, rest: list[str], n: list[int]) -> pa.RecordBatch:
            got = list(near_of(rest, n)) if len(rest) > 1 else []
            columns = [[part + rest[i] for i, _, _ in got], [k for _, k, _ in got], [n[b] for _, _, b in got], [part + rest[b] for _, _, b in got]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])

        held: str | None = None
        rests: list[str] = []
        counts: list[int] = []
        for batch in batches:
            for part, rest, n in zip(*(c.to_pylist() for c in batch.columns)):
                if part != held:
                    if held is not None:
                        yield found(held, rests, counts)
                    held, rests, counts = part, [], []
                rests.append(rest)
                counts.append(n)
        if held is not None:
            yield found(held, rests, counts)

    below = words.filter(F.col("depth") <= F.length("word"))
    rows = below.select(F.substring("word", F.lit(1), F.col("depth")).alias("part"), F.substring("word", F.col("depth") + 1, F.length("word")).alias("rest"), "n")
    return rows.repartition("part").sortWithinPartitions("part", "rest").mapInArrow(run, FOUND)


def edited_above(words: DataFrame) -> DataFrame:
    """FOUND for pairs whose edit leaves a state above the partitions: grouped by state and the rest after the edit."""
    each = words.filter("depth > 0").select("word", "n", F.explode(F.sequence(F.lit(0), F.least(F.col("depth") - 1, F.length("word")))).alias("d"))
    letter = F.substring("word", F.col("d") + 1, F.lit(1))
    head, tail = F.substring("word", F.lit(1), F.col("d")), F.substring("word", F.col("d") + 2, F.length("word"))
    me = F.struct((-F.col("n")).alias("m"), F.col("word").alias("w"), letter.alias("a"))
    cut = each.filter(letter != "").select("d", F.concat(head, tail).alias("rest"), me.alias("cut"), F.lit(None).cast(each.select(me).schema[0].dataType).alias("whole"))
    whole = each.select("d", F.col("word").alias("rest"), F.lit(None).cast(cut.schema["cut"].dataType).alias("cut"), me.alias("whole"))
    groups = cut.unionByName(whole).groupBy("d", "rest").agg(F.sort_array(F.collect_list("cut")).alias("cuts"), F.max("whole").alias("whole"))
    groups = groups.filter(F.size("cuts") + F.col("whole").isNotNull().cast("int") > 1)
    apart = lambda c: F.coalesce(c["a"] != F.col("whole")["a"], F.lit(False))  # noqa: E731  whether the whole word is near to a cut one

    def of_cut(c: Column, i: Column) -> Column:
        other = F.get("cuts", F.when(i == 0, 1).otherwise(0))
        best = F.array_min(F.array_compact(F.array(other, F.when(apart(c), F.col("whole")))))
        return F.struct(c["w"].alias("word"), (F.size("cuts") - 1 + apart(c).cast("int")).cast("long").alias("near"), (-best["m"]).alias("best_n"), best["w"].alias("best"))

    near = F.filter("cuts", apart)
    of_whole = F.struct(F.col("whole")["w"].alias("word"), F.size(near).cast("long").alias("near"), (-F.get(near, F.lit(0))["m"]).alias("best_n"), F.get(near, F.lit(0))["w"].alias("best"))
    rows = groups.select(F.explode(F.concat(F.transform("cuts", of_cut), F.array(of_whole))).alias("x")).select("x.*")
    return rows.filter("near > 0")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: where the forms of the words that have one end."""
    ends = durable(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = durable(ends.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        if step.filter("moved").isEmpty():
            return step.select("word", "root")
        ends = step.select("word", "root")


def group(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words and their counts (word, n)."""
    vocabulary = placed(durable(words.select("word", F.col("n").cast("long").alias("n"))), limit)
    found = composed(vocabulary).unionByName(edited_above(vocabulary))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    near = found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    heavy = -F.col("best.m") >= 2 * F.col("n")
    forms = durable(
        vocabulary.join(near, "word", "left").select(
            "word", F.when(heavy, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(heavy, -F.col("best.m")).alias("form_n")
        )
    )
    out = forms.join(rooted(forms), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group(counted(table(spark, sf_dir, "documents").select("doc_id", "text")))

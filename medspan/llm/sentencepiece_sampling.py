"""SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without replacement by A-star search.

A text's lattice is the chain of its words' lattices: pieces begin at a blank (written as U+2581) and never cross one. Piece
weights are a unigram model that follows the vocabulary's merge order, p proportional to 1 / (rank + 2); characters that no
piece covers fall back to byte pieces. Decoding joins the pieces again and gives the text back exactly.

Each whole segmentation carries its log probability plus Gumbel noise; the k largest are a sample without replacement. They
are found top down: the best of a set of segmentations is drawn exactly (backward sampling over the words), and the rest of
the set splits by the first word that differs, and that word's segmentations by the first piece that differs. The maximum of each part is a Gumbel variate, truncated at the parent's, so
the parts can wait in a queue under that bound until the largest is expanded. The bound left in the queue after k is the
threshold for inclusion scores: 1 - exp(-exp(log p - threshold)). All noise is hashed from (row key, word, step), so that a
row's samples do not depend on partitioning.

The lattices of all distinct words of a slice of texts are built together: pieces are found by rolling hashes of all stretches
(and compared letter by letter), and the sums over segmentations move on by one character in all words at once.

Null and empty texts have one segmentation, the empty one, as have texts whose words allow only one. A null key is hashed as
such. A text without blanks is one word, however long, and has one lattice. Repeated rows get the same samples. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medspan.llm.common import table
from medspan.llm.hashing import U64, mix, powers

SAMPLES = 2
MARK = "▁"
# what a word leaves beyond one segmentation is 1 - p where that is more than this, and summed over the others below it
SURE_LEFT = 1e-8
CHUNK_CHARS, FILTER_BITS = 600_000, 20
SCHEMA = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids_crc32 long, round_trip boolean, ids array<int>"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _expand(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The places begin[i], begin[i] + 1, ... of each stretch, one stretch after the other."""
    ends = np.cumsum(count)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


class Lattice:
    """The model's pieces as tables that find all pieces in a column of characters at once, a table for each length."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        norm = np.log(sum(1.0 / (r + 2) for r in range(n)))
        self.arcs = {self.pieces[i]: (i, -np.log(r + 2.0) - norm) for r, i in enumerate(plain)}
        self.byte_weight = -np.log(n + 2.0) - norm
        self.names = {i: p.encode() for p, (i, _) in self.arcs.items()} | {i: bytes([b]) for b, i in self.byte_ids.items()}
        spelt = [self.names.get(i, b"") for i in range(n)]
        self.name_bytes, self.name_size = np.frombuffer(b"".join(spelt), dtype=np.uint8), np.array([len(x) for x in spelt], dtype=np.int64)
        self.name_begin = np.cumsum(self.name_size) - self.name_size
        self.lengths, self.logs = np.ones(n, dtype=np.int64), np.zeros(n)
        for piece, (i, log) in self.arcs.items():
            self.lengths[i], self.logs[i] = len(piece), log
        by_length: dict[int, list[str]] = {}
        for p in self.arcs:
            by_length.setdefault(len(p), []).append(p)
        self.tables = {length: self._table(length, ps) for length, ps in sorted(by_length.items())}

    def _table(self, length: int, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """(which low bits of a hash occur, sorted hashes, characters, ids) of the pieces of a length."""
        letters = characters(pieces).reshape(-1, length)
        hashes = (mix(letters.astype(U64) + U64(1)) * powers(length)[0]).sum(axis=1, dtype=U64)
        order = np.argsort(hashes)
        seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        seen[hashes >> U64(64 - FILTER_BITS)] = True
        ids = np.array([self.arcs[p][0] for p in pieces], dtype=np.int32)
        return seen, hashes[order], letters[order], ids[order]

    def find(self, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        """All arcs in the characters of some words, `place` being each one's number in its word: (row, code), sorted by the row
        they end at, long ones first. A code is a piece's id, or from there on a letter that goes by its bytes; and, of the codes,
        (length, log probability, how many ids, first in the list of ids), and the list of ids."""
        n = len(text)
        hashes = np.zeros(n + 1, dtype=U64)
        np.cumsum(mix(text.astype(U64) + U64(1)) * powers(n)[0], out=hashes[1:])
        inverse = powers(n)[1]
        # a mark that stands in the text itself is no blank: only the first character is one
        marks = np.concatenate([[0], np.cumsum(text == ord(MARK))])
        marked = marks[-1] > (place == 0).sum()
        rows, codes = [], []
        bare = np.ones(n, dtype=bool)
        # how many characters of the word there are from each place on
        ends = np.append(np.flatnonzero(place == 0)[1:], n)
        left = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)
        begin = np.arange(n)
        for length, (seen, names, letters, piece_ids) in self.tables.items():
            if length > 1:
                begin = begin[left[begin] >= length]
            h = (hashes[begin + length] - hashes[begin]) * inverse[begin]
            some = np.flatnonzero(seen[h >> U64(64 - FILTER_BITS)])
            at, h = begin[some], h[some]
            found = np.minimum(np.searchsorted(names, h), len(names) - 1)
            same = names[found] == h
            at, found = at[same], found[same]
            good = np.ones(len(at), dtype=bool)
            for i in range(length):
                good &= letters[found, i] == text[at + i]
            if marked:
                good &= (place[at] == 0) | (marks[at + length] == marks[at])
            at, found = at[good], found[good]
            rows.append((at + length - 1).astype(np.int32))
            codes.append(piece_ids[found])
            if length == 1:
                bare[at] = False
        loose = np.flatnonzero(bare)
        kinds, which = np.unique(text[loose], return_inverse=True)
        raw = [[self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
        sizes = np.array([len(r) for r in raw], dtype=np.int64)
        size = np.concatenate([np.ones(len(self.pieces), dtype=np.int64), sizes])
        row = np.concatenate([*rows[::-1], loose.astype(np.int32)])
        code = np.concatenate([*codes[::-1], (len(self.pieces) + which).astype(np.int32)])
        order = np.argsort(row, kind="stable")
        pool = np.concatenate([np.arange(len(self.pieces)), *map(np.array, raw)]).astype(np.int64)
        lengths = np.concatenate([self.lengths, np.ones(len(raw), dtype=np.int64)])
        logs = np.concatenate([self.logs, self.byte_weight * sizes])
        return row[order], code[order], lengths, logs, size, np.cumsum(size) - size, pool


def characters(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def words_of(text: str) -> list[str]:
    """The text's words, each with the blank before it; the first one's is added."""
    return (MARK + text.replace(" ", f" {MARK}")).split(" ") if text else []


class Chunk:
    """The words of some texts, with all their arcs in one table."""

    def __init__(self, lattice: Lattice, texts: list[str], keys: list[int]):
        self.words = [words_of(t) for t in texts]
        every = np.empty(sum(map(len, self.words)), dtype=object)
        every[:] = [w for ws in self.words for w in ws]
        kind, kinds = pd.factorize(every)
        self.kind = kind.astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.size = np.array([len(w) for w in kinds], dtype=np.int64)
        self.row = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        place = np.arange(self.row[-1]) - np.repeat(self.row[:-1], self.size)
        self.arc_row, self.code, self.lengths, self.logs, self.id_count, self.id_begin, self.pool = lattice.find(characters(list(kinds)), place)
        self.cum, self.sums = self._forward(place)
        self.total = self.sums[self.row[1:] + np.arange(len(kinds))]
        self.last = np.zeros(self.row[-1], dtype=bool)
        self.last[self.row[1:] - 1] = True
        self.arc_begin = np.concatenate([[0], np.cumsum(np.bincount(self.arc_row, minlength=self.row[-1]))]).astype(np.int64)
        self.known: dict[tuple[int, ...], float] = {}
        doc = np.repeat(np.arange(len(texts)), np.diff(self.begin))
        place = np.arange(len(self.kind)) - self.begin[doc]
        seeds = mix(np.array(keys, dtype=np.int64).astype(U64) + U64(0x9E3779B97F4A7C15))
        self.seed = mix(seeds[doc] + place.astype(U64) * U64(0xD1342543DE82EF95)) if len(doc) else np.zeros(0, dtype=U64)
        self.doc_seed = seeds

    def _forward(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward probabilities of the arcs, cumulated in each row and with the row's number added; and the log sums up to
        each place of each word, from its beginning (0) on. All words move on by one character at a time."""
        word = np.repeat(np.arange(len(self.size)), self.size)
        small = place.astype(np.uint16) if len(place) and self.size.max() < 1 << 16 else place
        at = small[self.arc_row]
        order = np.argsort(at, kind="stable")
        most = int(self.size.max()) if len(self.size) else 0
        cuts = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=most))]).tolist()
        sums, cum = np.zeros(self.row[-1] + len(self.size)), np.empty(len(self.code))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            some = order[lo:hi]
            row, code = self.arc_row[some], self.code[some]
            to = row + word[row] + 1  # a word has one more place than characters
            begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            counts = np.diff(begins, append=len(row))
            value = sums[to - self.lengths[code]] + self.logs[code]
            top = np.maximum.reduceat(value, begins)
            weight = np.exp(value - np.repeat(top, counts))
            whole = np.add.reduceat(weight, begins)
            sums[to[begins]] = top + np.log(whole)
            share = weight / np.repeat(whole, counts)
            run = np.cumsum(share)
            run += row - np.repeat((run - share)[begins], counts)
            ends = begins + counts - 1
            run[ends] = row[ends] + 1.0
            cum[some] = run
        return cum, sums

    def uniform(self, seed: np.ndarray, salt: int) -> np.ndarray:
        return ((mix(seed ^ mix(np.array([salt + 1], dtype=U64))) >> U64(11)).astype(np.float64) + 0.5) / 2**53

    def others(self, kind: int, barred: list[tuple[int, ...]]) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """The segmentations of a word that are not barred, split by the first arc (from the end) that no barred one shares:
        the arcs up to it, and the log probability of each part. Sums of positive terms only, so small parts are exact too."""
        size, row = int(self.size[kind]), int(self.row[kind])
        sums = self.sums[row + kind : row + kind + size + 1]
        taken: dict[tuple[int, ...], set[int]] = {}
        for path in barred:
            for i, arc in enumerate(path):
                taken.setdefault(path[:i], set()).add(arc)
        heads, logs = [], []
        for head, gone in taken.items():
            at = size - sum(int(self.lengths[self.code[a]]) for a in head)
            spent = sum(float(self.logs[self.code[a]]) for a in head)
            for arc in range(self.arc_begin[row + at - 1], self.arc_begin[row + at]):
                if arc not in gone:
                    heads.append((*head, arc))
                    code = self.code[arc]
                    logs.append(spent + self.logs[code] + sums[at - self.lengths[code]] - sums[size])
        return heads, np.array(logs)

    def left(self, kind: int, barred: list[tuple[int, ...]]) -> float:
        """Probability of all segmentations of a word but the barred ones; 0 if there are none."""
        key = barred[0] if len(barred) == 1 else None
        if key is None or key not in self.known:
            got = float(np.exp(self.others(kind, barred)[1]).sum())
            if key is None:
                return got
            self.known[key] = got
        return self.known[key]

    def another(self, token: int, barred: list[tuple[int, ...]], salt: int) -> tuple[float, np.ndarray]:
        """A segmentation of the word at `token` drawn from those that are not barred: log probability, arcs in order of text."""
        kind = int(self.kind[token])
        heads, logs = self.others(kind, barred)
        draw = lambda step: float(self.uniform(self.seed[token : token + 1], salt * 4096 + step)[0])
        run = np.cumsum(np.exp(logs - logs.max()))
        path = list(heads[min(int(np.searchsorted(run, draw(0) * run[-1])), len(heads) - 1)])
        at = int(self.size[kind]) - sum(int(self.lengths[self.code[a]]) for a in path)
        while at > 0:
            arc = int(np.searchsorted(self.cum, self.row[kind] + at - 1 + draw(len(path)), side="left"))
            path.append(arc)
            at -= int(self.lengths[self.code[arc]])
        return min(0.0, float(self.logs[self.code[path]].sum() - self.total[kind])), np.array(path[::-1], dtype=np.int64)

    def sample(self, tokens: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the words at `tokens`: log probability each, and (token, arc) of all pieces in order of text."""
        kind = self.kind[tokens]
        at = self.size[kind].copy()
        log = -self.total[kind]
        live, steps, step = np.arange(len(tokens)), [], 0
        while len(live):
            row = self.row[kind[live]] + at[live] - 1
            u = self.uniform(self.seed[tokens[live]], salt * 4096 + step)
            arc, u = self.arc_begin[row], row + u
            todo = np.flatnonzero(self.cum[arc] < u)
            while len(todo):
                arc[todo] += 1
                todo = todo[self.cum[arc[todo]] < u[todo]]
            code = self.code[arc]
            log[live] += self.logs[code]
            steps.append((live, arc))
            at[live] -= self.lengths[code]
            live = live[at[live] > 0]
            step += 1
        if not steps:
            return log, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        who, arcs = np.concatenate([s[0] for s in steps[::-1]]), np.concatenate([s[1] for s in steps[::-1]])
        order = np.argsort(who, kind="stable")
        return np.minimum(log, 0.0), tokens[who[order]], arcs[order]


def _truncated(log_mass: np.ndarray, top: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel variates with these locations, truncated at top."""
    return -np.logaddexp(-top, np.log(-np.log(u)) - log_mass)


def _search(chunk: Chunk, lattice: Lattice, k: int, data: list[str]) -> list[list[tuple]]:
    """For each text its k (or all) segmentations: (pieces, log probability, perturbed, inclusion, crc, round trip, ids)."""
    docs = range(len(chunk.words))
    everything = np.arange(len(chunk.kind))
    first = chunk.sample(everything, 0)
    # a leaf is (log of each word, arcs of the text, perturbed value); a queue entry (bound, leaf, word)
    leaves: list[list[tuple]] = []
    bounds: list[list[np.ndarray]] = [[] for _ in docs]
    barred: list[dict] = [{} for _ in docs]

    def grow(picked: list[tuple[int, int, int]], salt: int) -> None:
        """Split what leaves (text, leaf, first word) leave of their sets, each from its first word on."""
        logs, paths = [leaves[d][i][0] for d, i, _ in picked], [leaves[d][i][1] for d, i, _ in picked]
        size = np.array([len(x) for x in logs], dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(size)])
        log, arcs = np.concatenate(logs), np.concatenate(paths)
        of = np.array([d for d, _, _ in picked], dtype=np.int64)
        tokens = _expand(chunk.begin[of], size)
        ends = np.concatenate([[0], _ends(chunk, arcs)])
        path = lambda w: tuple(arcs[ends[w] : ends[w + 1]][::-1].tolist())
        left = -np.expm1(log)
        for w in np.flatnonzero(left < SURE_LEFT).tolist():
            left[w] = chunk.left(int(chunk.kind[tokens[w]]), [path(w)])
        for (d, leaf, start), a in zip(picked, at.tolist()):
            if leaf and start < len(leaves[d][leaf][0]):
                left[a + start] = chunk.left(int(chunk.kind[tokens[a + start]]), [*barred[d][leaf, start], path(a + start)])
        # log probability of the words before each one of its text
        mass = np.zeros(len(log))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b > a:
                np.cumsum(log[a : b - 1], out=mass[a + 1 : b])
        with np.errstate(divide="ignore"):
            mass += np.log(left)
        top = np.repeat([leaves[d][i][2] for d, i, _ in picked], size)
        bound = _truncated(mass, top, chunk.uniform(chunk.seed[tokens], 1_000_003 + salt))
        bound[left <= 0] = -np.inf
        for (d, _, start), a, b in zip(picked, at[:-1].tolist(), at[1:].tolist()):
            bound[a : a + start] = -np.inf
            bounds[d].append(bound[a:b])

    if not len(docs):
        return []
    cut = np.searchsorted(first[1], chunk.begin)
    tops = -np.log(-np.log(chunk.uniform(chunk.doc_seed, 7)))
    for d in docs:
        b, e = chunk.begin[d], chunk.begin[d + 1]
        leaves.append([(first[0][b:e], first[2][cut[d] : cut[d + 1]], float(tops[d]))])
    grow([(d, 0, 0) for d in docs], 0)
    for r in range(1, k):
        picked = {}
        for d in docs:
            best = max(((float(b.max()), i) for i, b in enumerate(bounds[d]) if len(b)), default=(-np.inf, 0))
            if best[0] > -np.inf:
                picked[d] = (best[1], int(bounds[d][best[1]].argmax()), best[0])
        if not picked:
            break
        # words after the branching one are free; the branching one is drawn from what is left of it
        wanted = np.concatenate([np.arange(chunk.begin[d] + w + 1, chunk.begin[d + 1]) for d, (_, w, _) in picked.items()])
        log, who, arcs = chunk.sample(wanted, r)
        at = 0
        for d, (leaf, w, top) in picked.items():
            parent, token = leaves[d][leaf], int(chunk.begin[d] + w)
            ends = _ends(chunk, parent[1])
            begin = int(ends[w - 1]) if w else 0
            ban = [*barred[d].get((leaf, w), []), tuple(parent[1][begin : ends[w]][::-1].tolist())]
            own, head = chunk.another(token, ban, 10_000 + r)
            n = int(chunk.begin[d + 1]) - token - 1
            lo, hi = np.searchsorted(who, [token + 1, chunk.begin[d + 1]])
            bounds[d][leaf][w] = -np.inf
            leaves[d].append((np.concatenate([parent[0][:w], [own], log[at : at + n]]), np.concatenate([parent[1][:begin], head, arcs[lo:hi]]), top))
            at += n
            barred[d][len(leaves[d]) - 1, w] = ban
        grow([(d, len(leaves[d]) - 1, w) for d, (_, w, _) in picked.items()], r)
    # the ids of all segmentations in one list
    arcs = np.concatenate([leaf[1] for d in docs for leaf in leaves[d]])
    codes = chunk.code[arcs]
    count = chunk.id_count[codes]
    every = chunk.pool[_expand(chunk.id_begin[codes], count)]
    ends = np.concatenate([[0], np.cumsum(count)])[np.cumsum([0] + [len(leaf[1]) for d in docs for leaf in leaves[d]])]
    # and their bytes
    spelt = lattice.name_bytes[_expand(lattice.name_begin[every], lattice.name_size[every])]
    stops = np.concatenate([[0], np.cumsum(lattice.name_size[every])])[ends]
    out, at = [], 0
    for d in docs:
        threshold = max((float(b.max()) for b in bounds[d] if len(b)), default=-np.inf)
        rows = []
        for log, _, top in leaves[d]:
            ids = every[ends[at] : ends[at + 1]]
            same = text_of(spelt[stops[at] : stops[at + 1]].tobytes()) == data[d]
            at += 1
            p = float(log.sum())
            included = 1.0 if threshold == -np.inf else float(-np.expm1(-np.exp(min(700.0, p - threshold))))
            rows.append((len(ids), p, top, included, zlib.crc32(ids.astype("<u4").tobytes()), same, ids))
        out.append(rows)
    return out


def _ends(chunk: Chunk, arcs: np.ndarray) -> np.ndarray:
    """How many of a text's arcs there are up to the end of each word: its last arc stands in its last row."""
    return np.flatnonzero(chunk.last[chunk.arc_row[arcs]]) + 1


def decode(lattice: Lattice, ids: list[int]) -> str:
    """The text of a list of ids: the exact inverse of any segmentation."""
    names = lattice.names
    return text_of(b"".join([names[i] for i in ids]))


def text_of(spelt: bytes) -> str:
    """The text of the bytes that a list of ids spells: a blank for each mark, less the first."""
    return spelt.decode("utf-8", "surrogatepass").replace(MARK, " ")[1:]


_LATTICES: dict[str, Lattice] = {}


def _samples(path: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _LATTICES:
            _LATTICES[path] = Lattice(path)
        lattice = _LATTICES[path]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(keys):
                end, chars = at, 0
                while end < len(keys) and (chars < CHUNK_CHARS or end == at):
                    chars += len(texts[end])
                    end += 1
                some = texts[at:end]
                chunk = Chunk(lattice, some, [(-1 if x is None else x) for x in keys[at:end]])
                rows = [(keys[at + d], s, *row) for d, found in enumerate(_search(chunk, lattice, k, some)) for s, row in enumerate(found)]
                *plain, ids = zip(*rows)
                begins = np.cumsum([0] + [len(x) for x in ids])
                lists = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(plain, types)), lists], names=names)
                at = end

    return run


def sample(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SAMPLES, model: str | None = None) -> DataFrame:
    """A row for each of a text's k distinct segmentations (fewer where it has fewer)."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_samples(model or default_model(), k), SCHEMA).withColumnRenamed("doc_id", key)


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents"))

"""Each operator against a brute-force version of it, over odd rows; and over an empty table."""

import collections
import hashlib
import itertools
import math
import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from medspan.llm import chat_format, fingerprint, line_dedup, media, ngram_join, packing, periodic_runs, sentencepiece_sampling, sharding, spelling_variants, suffix_dedup, toxicity, url_filter


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


# --- sharding


def test_sharding_moves_rows_only_into_the_new_shard(spark, odd_docs, no_docs):
    got = sharding.shard(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert all(r["grown_shard"] in (r["shard"], 40) for r in got)
    for s, rs in itertools.groupby(sorted(got, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        assert [r["slot"] for r in rs] == list(range(len([r for r in got if r["shard"] == s])))
    text = dict(rows_of(odd_docs))
    for r in got:
        data = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 16, zlib.crc32(data))
    assert sharding.shard(no_docs).count() == 0


def test_sharding_follows_weights_and_confines_movement(spark):
    ids = spark.range(20000).withColumnRenamed("id", "doc_id").withColumn("text", F.lit(""))
    place = lambda w: {r["doc_id"]: r["shard"] for r in ids.select("doc_id", sharding.place(F.col("doc_id"), sharding.tree(40, w)).alias("shard")).collect()}
    even, heavy = place(None), place({7: 3.0})
    share = collections.Counter(heavy.values())
    assert 2.5 < share[7] / np.mean([share[s] for s in range(40) if s != 7]) < 3.5
    assert all(heavy[i] == 7 for i in even if even[i] != heavy[i])


# --- line dedup


def brute_lines(docs, long):
    seen, out = {}, {}
    for key, text in sorted({(d, t) for d, t in docs if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = text.split("\n")
        solid = [(i, x.strip(" ")) for i, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for n in range(1, line_dedup.MIN_LINES + 1):
            for i in range(len(solid) - n + 1):
                run = tuple(x for _, x in solid[i : i + n])
                if n < line_dedup.MIN_LINES and (long is None or sum(len(x.encode()) for x in run) < long):
                    continue
                if seen.setdefault(run, (key, i)) != (key, i):
                    gone |= {solid[j][0] for j in range(i, i + n)}
        out[key, text] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


@pytest.mark.parametrize("long", [None, 1, 20, line_dedup.LONG_RUN])
def test_line_dedup_equals_brute_force(spark, odd_docs, no_docs, long):
    docs = odd_docs.withColumn("was", F.col("text"))
    got = line_dedup.dedup(docs, long=long).collect()
    want = brute_lines(rows_of(odd_docs), long)
    assert len(got) == odd_docs.count()
    assert all(r["text"] == (None if r["was"] is None else want[r["doc_id"], r["was"]]) for r in got)
    assert any(r["lines_removed"] for r in got)
    assert line_dedup.dedup(no_docs, long=long).count() == 0


def test_line_dedup_finds_long_passages_on_one_and_two_lines(spark):
    passage = " ".join(f"word{i}" for i in range(51))
    halves = passage[: len(passage) // 2], passage[len(passage) // 2 :]
    texts = [f"a\n{passage}\nb", f"c\n  {passage}", f"d\n{halves[0]}\n{halves[1]}\ne", f"{halves[0]}\n\n{halves[1]}\nf", f"g\n{halves[0]}", "a\nb"]
    assert len(halves[0]) < line_dedup.LONG_RUN < len(passage)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    assert got == {0: texts[0], 1: "c", 2: texts[2], 3: "\nf", 4: texts[4], 5: "a\nb"}


def test_names_of_columns_do_not_clash(spark, odd_docs, tmp_path):
    """Every operator over a table whose other columns are named like the operators' own."""
    names = ("u", "v", "rest", "lo", "at", "gram", "folded", "weight", "words", "__k", "__y", "__key", "__hash", "__at", "__slice", "__n", "node", "token", "rank", "label", "host", "rule", "doc id.x", "a`b", "text.y")
    docs = odd_docs.select("doc_id", "text").filter("doc_id <> 60 or doc_id is null").withColumns({n: F.lit(1) for n in names})
    docs = docs.withColumns({"html": F.col("text"), "url": F.concat(F.lit("http://a.com/"), "doc_id")})
    marks = spark.createDataFrame([(i, i % 2, "x") for i in range(1, 12)], "doc_id long, toxic int, folded string")
    n = docs.count()
    cut = line_dedup.dedup(docs)
    assert cut.count() == n and cut.columns[: len(docs.columns)] == docs.columns
    assert toxicity.keep(docs, toxicity.learn(docs, marks)).columns == docs.columns
    assert sharding.shard(docs).count() == ngram_join.join(docs).count() == fingerprint.edited_pairs(docs).count() == n
    assert packing.pack(docs).count() >= n and sentencepiece_sampling.sample(docs, k=1).count() == n
    assert suffix_dedup.dedup(docs, length=60, gram=20).columns == docs.columns
    assert url_filter.judge(docs.withColumnRenamed("doc_id", "page_id")).count() == n
    assert periodic_runs.collapse(docs).columns == [*docs.columns, "n_words", "runs", "collapsed"]
    assert spelling_variants.group(spelling_variants.counted(docs, least_letters=1, least_count=1)).count() > 0
    talk = docs.select("*", F.col("doc_id").alias("conv_id"), F.col("doc_id").alias("turn"), F.col("text").alias("role"))
    assert chat_format.read_back(chat_format.render(chat_format.fold(chat_format.replayed(talk)))).count() == talk.select("conv_id").distinct().count()


# --- n-gram join


def brute_components(docs, k, num, den):
    sets = {}
    for key, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        sets[key] = frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()
    root = {key: key for key in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations([x for x in sets if x is not None], 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {key: (len(s), find(key)) for key, s in sets.items()}


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100), (1, 1, 2)])
def test_ngram_join_equals_brute_force(spark, odd_docs, no_docs, k, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "LEAST_LONG", 3)
    got = ngram_join.join(odd_docs, k=k, num=num, den=den).collect()
    want = brute_components(rows_of(odd_docs), k, num, den)
    assert len(got) == odd_docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    if k == 4:
        assert ngram_join.join(no_docs).count() == 0


# --- suffix dedup


def brute_cut(docs, length):
    starts = collections.Counter()
    for _, text in docs:
        data = (text or "").encode()
        starts.update(data[p : p + length] for p in range(len(data) - length + 1))
    out = {}
    for key, text in docs:
        data = (text or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for p in range(len(data) - length + 1):
            if starts[data[p : p + length]] > 1:
                gone[p : p + length] = True
        out[key, text] = bytes(np.frombuffer(data, dtype=np.uint8)[~gone]) if len(data) else b""
    return out


@pytest.mark.parametrize("held", [0, 1, 4096])
def test_suffix_dedup_equals_brute_force(spark, odd_docs, no_docs, held):
    """held: groups above it are named anew, position by position."""
    length = 60
    uid = {(r["doc_id"], r["text"]): (r[0]["u"], r[0]["v"]) for r in suffix_dedup._identified(odd_docs, "doc_id", "text").select(F.col(f"`{suffix_dedup.OWN}`"), "doc_id", "text").collect()}
    got = {(r["u"], r["v"]): (bytes(r["rest"]), r["sha"], r["removed"]) for r in suffix_dedup.spans(suffix_dedup._rows(odd_docs, "doc_id", "text"), length=length, gram=20, held=held).collect()}
    want = brute_cut(rows_of(odd_docs), length)
    for (key, text), rest in want.items():
        data = (text or "").encode()
        found = got.get(uid[key, text], (data, hashlib.sha256(data).hexdigest(), 0))
        assert found == (rest, hashlib.sha256(rest).hexdigest(), len(data) - len(rest))
    if held:
        clash = odd_docs.withColumns({"was": F.col("text"), "rest": F.lit(1), "u": F.lit(2), "lo": F.lit(3)})
        cut = suffix_dedup.dedup(clash, length=length, gram=20, held=held)
        assert cut.columns == clash.columns
        assert all(r["text"] == (None if r["was"] is None else want[r["doc_id"], r["was"]].decode(errors="ignore")) for r in cut.collect())
        assert suffix_dedup.dedup(no_docs).count() == 0


@pytest.mark.parametrize("held", [8, 4096])
def test_suffix_dedup_of_alike_texts(spark, held):
    """Many texts that share a passage, whole or in part, at different distances: many tuples of one gram."""
    import random

    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("ab") for _ in range(n))
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    rows = [(i, letters(rng.randint(0, 40)) + passage[rng.randint(0, 30) : 90 - rng.randint(0, 30)] + letters(rng.randint(0, 40))) for i in range(120)]
    rows += [(500 + i, passage[:50] + letters(3) + passage[50:]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_cut(rows, 60)
    got = suffix_dedup.dedup(docs.withColumn("was", F.col("text")), length=60, gram=20, held=held).collect()
    assert {(r["doc_id"], r["was"]): r["text"] for r in got} == {k: v.decode() for k, v in want.items()}


# --- packing


def test_packing_round_trips_and_fills_windows(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    ids = {(d, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4") for d, t in rows_of(odd_docs)}
    by_key = {d: x for (d, _), x in ids.items()}
    got = packing.pack(odd_docs, window=512).collect()
    for r in got:
        piece = by_key[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (len(piece), zlib.crc32(piece.tobytes()), len(by_key[r["doc_id"]])) == (r["length"], r["ids_crc32"], r["doc_tokens"])
    assert sum(r["length"] for r in got) == sum(len(by_key[d]) for d, _ in rows_of(odd_docs))
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 512 and sorted(ends) == list(range(len(ends)))
    assert packing.pack(no_docs).count() == 0


def test_plan_is_best_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = sorted(map(int, rng.integers(1, 65, 200)), reverse=True)
        free = []
        for x in lengths:
            fits = [i for i, f in enumerate(free) if f >= x]
            if fits:
                i = min(fits, key=lambda i: free[i])
                free[i] -= x
            else:
                free.append(64 - x)
        counts = collections.Counter(lengths)
        ranges = packing.plan(dict(counts), 64)
        used = collections.Counter()
        for n, (length, item, first, offset) in enumerate(ranges):
            stop = min([r[1] for r in ranges if r[0] == length and r[1] > item], default=counts[length])
            for i in range(item, stop):
                used[first + i - item] += length
        assert sorted(used.values()) == sorted(64 - f for f in free)


def test_cached_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(packing.default_tokenizer()), packing.Ids(packing.default_tokenizer())
    for text in ("Hello, World. It's  fine;\tÉcole Straße naïve ﬁ １２ ΣΑΣ. x", "a\x1cb c\x85d", "<|endoftext|> a<|startoftext|>b", "", " ", "e\u0301 İstanbul."):
        for _ in range(2):
            assert np.frombuffer(ids.of(text), dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_ids_of_letters_that_change_before_signs_equal_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(packing.default_tokenizer()), packing.Ids(packing.default_tokenizer())
    every = [chr(i) for i in range(128, 0x110000) if not 0xD800 <= i < 0xE000]
    changed = [c for c in every if unicodedata.normalize("NFC", c) != c or len(c.lower()) > 1 or unicodedata.combining(c)]
    assert {"\u09dc", "\ufb46", "\ufb2e", "\u0130"} <= set(changed)
    texts = [t for c in [*changed, *every[:12000:7]] for t in (f"{c}.", f"a{c}'", f"{c}b.", f"!{c}", f"{c}", f"{c}.{c}?")]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # learned, then cached
        assert [t for t, x, y in zip(texts, ids.of_all(texts), want) if x != y] == []
    assert ids.of(" ".join(texts)) == np.array(tokenizer.encode(" ".join(texts), add_special_tokens=False).ids, dtype="<u4").tobytes()


# --- fingerprints


def test_fingerprints(spark, odd_docs, no_docs):
    got = fingerprint.edited_pairs(odd_docs).collect()
    order = sorted(rows_of(odd_docs), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    after = collections.defaultdict(set)
    for (key, text), (_, nxt) in zip(order, order[1:] + order[:1]):
        text, nxt = text or "", nxt or ""
        half = len(text) // 2
        after[key].add(hashlib.sha256((text[: len(text) - half] + nxt[:half]).encode()).hexdigest())
    assert len(got) == len(order)
    text = dict(order)
    for r in got:
        assert r["edited_sha256"] in after[r["doc_id"]]
        assert r["n_chars"] == len(text[r["doc_id"]] or "")
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    names = {r["doc_id"]: r["fingerprint"] for r in got}
    assert names[20] == names[21] and names[30] == names[32] and names[35] == names[36]
    assert len({names[i] for i in (1, 2, 3, 20, 22, 23, 24, 33, 34, 60)}) == 10
    assert fingerprint.edited_pairs(no_docs).count() == 0


def test_fingerprints_are_sums_of_paragraphs(spark):
    texts = spark.createDataFrame([(1, "a b c\nd e"), (2, "d e\na b c"), (3, "a b c"), (4, "d e"), (5, "a b c\nd e\nd e")], "id long, t string")
    got = {r["id"]: r for r in fingerprint.fingerprints(texts, ["id"], "t").collect()}
    assert got[1]["equal"] == got[2]["equal"] and got[1]["like"] == got[2]["like"] and got[5]["equal"] != got[1]["equal"]
    assert [(a + b) % 2**32 for a, b in zip(got[3]["equal"], got[4]["equal"])] == got[1]["equal"]
    assert [(5_000_000_000 + a - b) % 2**32 for a, b in zip(got[5]["equal"], got[4]["equal"])] == [(5_000_000_000 + x) % 2**32 for x in got[1]["equal"]]


# --- toxicity


def test_toxicity_learns_and_folds(spark, odd_docs, no_docs):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("bcdfghjklmnpqrst") + rng.choice("aeiouy") for _ in range(4))
    rows, labels = [], []
    for i in range(600):
        words, bad = [word() for _ in range(30)], i % 4 == 0
        if bad:
            words[rng.randrange(30)] = rng.choice(["zorkel", "Z0RKEL", "zоrkelman", "z o r", "zorkel!"]) if i % 8 else "zorkel"
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad and words.count("z o r") == 0)))
    rows.append((1000, "a zorkel fish and more words"))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(docs, marks)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, y in labels)
    model.exceptions.append(" zorkel fish ")
    assert toxicity.score(docs, model).filter("doc_id = 1000 and score < 0.5").count() == 1
    odd = toxicity.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    kept = toxicity.keep(odd_docs, model)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert toxicity.score(no_docs, toxicity.learn(no_docs, marks.limit(0))).count() == 0


# --- url filter


def test_urls_follow_the_longest_rule(spark):
    urls = [
        ("http://a.com/x", "a.com", "/x", "com/"), ("http://A.COM", "a.com", "", None), ("http://b.example.com/en/1?q#f", "b.example.com", "/en/1", "example.com/en/"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"), ("x://z.net/es/a", "z.net", "/es/a", "net/es/"), ("http://planet/es/", "planet", "/es/", None),
        ("http://net/fr/", "net", "/fr/", "net/fr/"), ("no scheme", "", "", None), (None, "", "", None), ("a://b://c.com/", "b:", "//c.com/", None), ("http://q.org?x=http://a.com/", "q.org", "", None),
    ]
    pages = spark.createDataFrame([(i, u, "<p>some words here</p>", "x") for i, (u, *_) in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    for i, (_, host, path, rule) in enumerate(urls):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] in ("allow", "block")
        if rule:
            assert got[i]["verdict"] == {h + p: v for v, h, p in url_filter.RULES}[rule]
    assert url_filter.judge(pages.limit(0)).count() == 0


def test_names_split_into_the_likeliest_words():
    split = url_filter.Splitter({"cheap": 50, "pills": 40, "news": 30, "che": 1, "a": 3}).split
    assert split("cheappillsnews") == ("cheap", "pills", "news")
    assert "".join(split("xqcheapz")) == "xqcheapz" and "cheap" in split("xqcheapz")
    assert split("") == ()


def test_verdicts_equal_plain_naive_bayes(spark):
    """Splits, token counts and odds recomputed without Spark; repeated rows, nulls and a label that is too long among them."""
    import math

    hosts = ["goodnews.com", "cheappills.net", "news.example.com", "cheapnews.org", "goodpills.org", "www.example.com", f"{'x' * 70}.org"]
    paths = ["/es/buy/1", "/fr/read", "/en/buy", "/good/2", "", "/en/"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + ["http://cheappills.net/es/buy/1"] * 3 + [None, "none"]
    html = "<p>good news good cheap pills</p> <b>buy</b> news"
    pages = spark.createDataFrame([(i, u, html if i % 2 else None, i) for i, u in enumerate(urls)], "page_id long, url string, html string, token int")
    got = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert len(got) == len(urls)

    words = collections.Counter(w for i in range(len(urls)) if i % 2 for w in ["good", "news", "good", "cheap", "pills", "buy", "news"])
    splitter = url_filter.Splitter(dict(words))
    said = {"p:en", "p:es", "p:fr", "h:com", "h:example", "h:www", "h:net"}

    def tokens(r):
        labels = [x for x in re.split("[^a-z]+", r["host"]) if x]
        parts = [f"h:{w}" for x in labels for w in ([x] if len(x) > 63 else splitter.split(x))]
        return [t for t in parts + [f"p:{'#' if t.isdigit() else t}" for t in re.split("[^0-9a-z]+", r["path"].lower()) if t] if t not in said]

    yes, no = collections.Counter(), collections.Counter()
    sides = collections.Counter(r["verdict"] for r in got.values() if r["rule"])
    for r in got.values():
        if r["rule"]:
            (yes if r["verdict"] == "block" else no).update(tokens(r))
    kinds = len(yes | no)
    for r in got.values():
        odds = math.log((sides["block"] + 1) / (sides["allow"] + 1))
        odds += sum(math.log((yes[t] + 1) / (yes.total() + kinds)) - math.log((no[t] + 1) / (no.total() + kinds)) for t in tokens(r) if t in yes or t in no)
        assert abs(r["odds"] - odds) < 1e-9
        if not r["rule"]:
            assert r["verdict"] == ("block" if odds > 0 else "allow")


# --- sampled segmentations


def test_samples_are_distinct_exact_and_decode(spark, odd_docs, no_docs):
    got = sentencepiece_sampling.sample(odd_docs, k=3).collect()
    lattice, texts = sentencepiece_sampling.Lattice(sentencepiece_sampling.default_model()), dict(rows_of(odd_docs))
    assert all(r["round_trip"] and sentencepiece_sampling.decode(lattice, r["ids"]) == (texts[r["doc_id"]] or "") for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    for key, rs in by.items():
        rs = {r["sample"]: r for r in rs}
        assert sorted(rs) == list(range(len(rs)))
        assert len({(r["ids_crc32"], r["n_pieces"]) for r in rs.values()}) == len(rs)
        assert all(rs[i]["perturbed"] > rs[i + 1]["perturbed"] for i in range(len(rs) - 1))
    assert sentencepiece_sampling.sample(no_docs).count() == 0


def test_lattices_hold_all_pieces_and_their_sums():
    """Arcs and sums of each word against plain loops: marks within a text, letters without a piece, one very long word."""
    g = sentencepiece_sampling
    lattice = g.Lattice(g.default_model())
    texts = ["the cat", f"a{g.MARK}b {g.MARK}{g.MARK} the{g.MARK}cat", "日本語 😀x é\x00", "", " ", "internationalisation" * 100]
    chunk = g.Chunk(lattice, texts, list(range(len(texts))))
    longest = max(map(len, lattice.arcs))
    for kind, word in enumerate(dict.fromkeys(w for t in texts for w in g.words_of(t))):
        sums = [0.0]
        for end in range(1, len(word) + 1):
            want = []
            for start in range(max(0, end - longest), end):
                if (arc := lattice.arcs.get(word[start:end])) and (start == 0 or g.MARK not in word[start:end]):
                    want.append((end - start, (arc[0],), arc[1]))
            if not want or want[-1][0] != 1:
                raw = word[end - 1].encode()
                want.append((1, tuple(lattice.byte_ids[b] for b in raw), lattice.byte_weight * len(raw)))
            row = chunk.row[kind] + end - 1
            arcs = range(chunk.arc_begin[row], chunk.arc_begin[row + 1])
            assert [(chunk.lengths[c], tuple(chunk.pool[chunk.id_begin[c] :][: chunk.id_count[c]]), chunk.logs[c]) for c in chunk.code[list(arcs)]] == want
            parts = np.array([sums[end - n] + w for n, _, w in want])
            sums.append(float(np.logaddexp.reduce(parts)))
            assert np.allclose(chunk.cum[list(arcs)] - row, np.cumsum(np.exp(parts - sums[-1])), atol=1e-9)
        assert np.allclose(chunk.sums[chunk.row[kind] + kind :][: len(word) + 1], sums)


def test_samples_follow_the_model():
    g = sentencepiece_sampling
    lattice, text = g.Lattice(g.default_model()), "the cat"

    def all_of(word):
        return [((), 0.0)] if not word else [((a[0], *s), a[1] + w) for n in range(1, len(word) + 1) if (a := lattice.arcs.get(word[:n])) for s, w in all_of(word[n:])]

    p = collections.Counter()
    for parts in itertools.product(*map(all_of, g.words_of(text))):
        ids = tuple(i for x in parts for i in x[0])
        p[zlib.crc32(np.array(ids, dtype="<u4").tobytes())] += np.exp(sum(x[1] for x in parts))
    total = sum(p.values())
    found = g._search(g.Chunk(lattice, [text] * 3000, list(range(3000))), lattice, 3, [text] * 3000)
    firsts = collections.Counter(x[0][4] for x in found)
    assert all(abs(firsts[c] / 3000 - v / total) < 0.03 for c, v in p.items())
    # without replacement: weighting by inclusion estimates the total probability, 1
    assert abs(np.mean([sum(np.exp(y[1]) / y[3] for y in x) for x in found]) - 1) < 0.02


def test_sampling_returns_all_segmentations_of_short_texts():
    g = sentencepiece_sampling
    lattice = g.Lattice(g.default_model())

    def all_of(word):
        return [()] if not word else [(a[0], *s) for n in range(1, len(word) + 1) if (a := lattice.arcs.get(word[:n])) for s in all_of(word[n:])]

    for text in ("a", "I", "b", "x", "of", "a I", "of a"):
        want = {zlib.crc32(np.array(sum(p, ()), dtype="<u4").tobytes()) for p in itertools.product(*map(all_of, g.words_of(text)))}
        for k in (2, len(want), len(want) + 3):
            for rows in g._search(g.Chunk(lattice, [text] * 20, list(range(20))), lattice, k, [text] * 20):
                found = {r[4] for r in rows}
                assert len(rows) == len(found) == min(k, len(want)) and found <= want
                assert all(r[5] for r in rows) and (k < len(want) or all(r[3] == 1 for r in rows))


# --- media


def test_media_finds_edited_copies(spark):
    rng = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in rng.normal(size=(150, 64))]
    vectors[100] = vectors[3]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(500, None), (550, [1.0]), (None, vectors[5]), (50, vectors[50])]
    got = media.copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    hit = collections.defaultdict(set)
    for r in got:
        hit[r["query_id"]].add(r["match_id"])
    assert set(hit) == {0, 50, 100, 500, 550}
    assert hit[0] == {0} and hit[50] == {50} and hit[100] == {3} and hit[500] == {None}
    assert media.copies(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_media_recall_against_brute_force(spark):
    """Every pair of query and image compared whole: the tables find nine tenths at least of what agreement there is."""
    rng = np.random.default_rng(9)
    vectors = rng.normal(size=(40, 64)).astype(np.float32)
    images = media.render(vectors)
    whole = media.describe(images)
    asked = media.describe(np.stack([media.edit(x, i) for i, x in enumerate(images)]))
    agreed = 0
    for i, (_, q) in enumerate(asked):
        bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1)
        d = (bits(q)[:, None, :] != bits(whole[i][1])[None]).sum(axis=2) if len(q) and len(whole[i][1]) else np.full((1, 1), 256)
        agreed += (d.min(axis=1) <= media.MOST_BITS).sum() >= media.LEAST_INLIERS
    rows = spark.createDataFrame([(50 * i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = media.copies(rows).filter("query_id = match_id").count()
    assert found >= 0.9 * agreed and agreed >= 30


def test_media_meets_every_pair(spark):
    """Matches and copies are those of comparing all descriptors and asking the consensus about every two images."""
    vectors = np.random.default_rng(9).normal(size=(12, 64)).astype(np.float32)
    images = media.render(vectors)
    whole, asked = media.describe(images), media.describe(np.stack([media.edit(x, 2 * i) for i, x in enumerate(images)]))
    bits = lambda x: np.unpackbits(x.view(np.uint8), axis=1)
    want = {}
    for (a, (p, q)), (b, (r, d)) in itertools.product(enumerate(asked), enumerate(whole)):
        i, j = np.nonzero((bits(q)[:, None, :] != bits(d)[None]).sum(axis=2) <= media.MOST_BITS)
        if len(i):
            names = ("x", "y", "scale", "angle")
            pairs = pd.DataFrame({"query_id": 2 * a, "image": 2 * b, "qcorner": i, "corner": j} | {f"q{n}": p[i, k] for k, n in enumerate(names)} | {n: r[j, k] for k, n in enumerate(names)})
            found = media._consensus(pairs).iloc[0]
            if found["n_inliers"] >= media.LEAST_INLIERS:
                want[2 * a, 2 * b] = (found["n_matches"], found["n_inliers"])
    rows = spark.createDataFrame([(2 * i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["match_id"]): (r["n_matches"], r["n_inliers"]) for r in media.copies(rows, every=2).filter("match_id is not null").collect()}
    assert got == want and len(want) >= 12


def test_media_finds_turned_and_halved_copies(spark):
    vectors = np.random.default_rng(9).normal(size=(30, 64)).astype(np.float32)
    rows = spark.createDataFrame([(2 * i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    for change in (lambda x, i: media.edit(media.turned(x, 0.4, 1.0), i), lambda x, i: media.turned(x, 0.0, 0.5)):
        got = media.copies(rows, every=2, edited=change).collect()
        assert sum(r["query_id"] == r["match_id"] for r in got) >= 24


# --- plain recomputations of draws and likeness


def spark_hash(*values):
    """xxhash64 of longs, ints and strings, one after the other; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), h)
    return h


@pytest.mark.parametrize("weights", [None, {3: 2.5, 11: 0.2, 39: 4.0}])
def test_the_descent_ends_at_the_shortest_straw_of_all(spark, weights):
    keys = [None, -5, *range(1500)]
    docs = spark.createDataFrame([(k,) for k in keys], "doc_id long").withColumn("text", F.lit("x"))
    got = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard(docs, weights=weights).collect()}

    def plain(key, shards):
        straw = lambda s: -math.log(((spark_hash(key, s.to_bytes(4, "little")) >> 11) + 1) / 2.0**53) / (weights or {}).get(s, 1.0)
        return min(range(shards), key=straw)

    assert got == {k: (plain(k, 40), plain(k, 41)) for k in keys}


def test_likeness_equals_plain_sums_of_signs(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdé"), rng.integers(1, 5)))
    texts = {i: " ".join(word() for _ in range(rng.integers(0, 60))).replace(" a ", "\n") for i in range(60)} | {60: "", 61: None, 62: " \n ", 63: "x", 64: "x"}
    got = {r["doc_id"]: r for r in fingerprint.edited_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}

    def like(text):
        lanes = np.zeros(fingerprint.LIKE_LANES)
        for paragraph in text.split("\n"):
            words = re.findall(r"[^\x20\x09-\x0D]+", paragraph)
            for a, b in zip(words, [*words[1:], None]):
                h = spark_hash(a, b)
                half = fingerprint.LIKE_LANES // 2
                lanes += [1 if h >> (j if j < half else 32 + j - half) & 1 else -1 for j in range(fingerprint.LIKE_LANES)]
        return lanes

    def near(x, y):
        a, b = like(x), like(y)
        same = sorted(x.split("\n")) == sorted(y.split("\n"))
        scale = np.sqrt((a @ a) * (b @ b))
        return 1.0 if same else 0.0 if scale == 0 else min(1.0, max(0.0, a @ b / scale))

    order = sorted(texts, reverse=True)
    for key, nxt in zip(order, order[1:] + order[:1]):
        text, other = texts[key] or "", texts[nxt] or ""
        half = len(text) // 2
        assert got[key]["near_next"] == pytest.approx(near(text, other))
        assert got[key]["near_edited"] == pytest.approx(near(text, text[: len(text) - half] + other[:half]))

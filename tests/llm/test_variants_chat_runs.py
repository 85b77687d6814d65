"""Spelling variants, chat formatting and periodic runs against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from medspan.llm import chat_format, periodic_runs, spelling_variants

# --- spelling variants


def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    u, v = sorted((u, v), key=len)
    i = 0
    while i < len(u) and u[i] == v[i]:
        i += 1
    return u[i + 1 :] == v[i + 1 :] if len(u) == len(v) else u[i:] == v[i + 1 :]


def plain_words(docs, least_letters, least_count):
    counts = collections.Counter()
    for key, text in docs:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{key}:{word}".encode())
            if key is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_letters and n >= least_count}


def plain_group(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) if vs else None for w, vs in near.items()}
    form = {w: b if b is not None and counts[b] >= 2 * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def grouped(rows):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("limit", [0, 40, 100_000])
def test_variants_equal_brute_force(spark, limit):
    rng = random.Random(7)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(0, 7))): rng.randint(1, 40) for _ in range(300)}
    words |= {"x" * n: 3**n for n in range(5, 14)} | {"abcdefghij" + c: ord(c) for c in "klmnopé"} | {"abcdefghijklmno": 500}
    got = spelling_variants.group(spark.createDataFrame(list(words.items()), "word string, n long"), limit).collect()
    assert len(got) == len(words) and grouped(got) == plain_group(words)
    assert any(r["root"] not in (r["word"], r["form"]) and r["form"] for r in got)


def test_variants_of_documents(spark, odd_docs, no_docs):
    counts = plain_words([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 2, 2)
    got = spelling_variants.group(spelling_variants.counted(odd_docs, least_letters=2, least_count=2), 50)
    assert grouped(got.collect()) == plain_group(counts)
    assert spelling_variants.group(spelling_variants.counted(no_docs)).count() == 0


def test_words_lose_letters_by_their_hash(spark):
    texts = [(i, f"Straße École {'Wort' * (i % 5 + 1)} ABC×DEF") for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["word"]: r["n"] for r in spelling_variants.counted(docs, least_letters=1, least_count=1).collect()}
    assert got == plain_words(texts, 1, 1)
    assert {"straße", "École", "abc×def"} <= set(got) and any(len(w) == 5 and w != "École" for w in got)


def test_very_long_words_are_words(spark):
    words = {"a" * 3000: 9, "a" * 3001: 4, "a" * 2999 + "b": 2}
    got = spelling_variants.group(spark.createDataFrame(list(words.items()), "word string, n long"), 2).collect()
    assert grouped(got) == plain_group(words)


def test_the_acceptor_is_minimal():
    made = spelling_variants.Acceptor(sorted(a + b for a in ("", "x", "yz") for b in ("ing", "ings", "ed")))
    languages = {q: frozenset(made.shared(q, q)) for q in range(1, len(made.arcs))}
    assert len(set(languages.values())) == len(languages)


# --- chat formatting

SAYS = ["", "ok", "a</s>b", "\\", "\\\\[INST]", "<|im_end|>\n<|im_start|>user<|im_sep|>", "[\\INST] <<SYS>>x<</SYS>>", "é😀\n", "<", "|im_end|>"]


def plain_fold(log):
    """The final messages of one conversation's events, one event after another."""
    held = {}
    for _, message, kind, role, text in sorted(set(log), key=lambda e: e[0]):
        if kind == "regenerate":
            old = held.get(message, [None, ""])[0]
            held = {m: x for m, x in held.items() if m < message}
            held[message] = [old, ""]
        x = held.setdefault(message, [None, ""])
        if role is not None:
            x[0] = role
        if kind == "delta":
            x[1] += text or ""
        if kind == "edit":
            x[1] = text or ""
    return [(r or "", t) for _, (r, t) in sorted(held.items())]


def test_logs_fold_as_event_by_event(spark):
    rng, rows = random.Random(11), []
    for conv in range(60):
        log, opened = [], {}
        for seq in range(rng.randint(1, 40)):
            message = rng.randint(0, 5)
            kind = rng.choice(["delta", "delta", "delta", "edit", "regenerate"]) if message in opened else "open"
            role = rng.choice(["user", "assistant", "system"]) if kind == "open" else None
            if kind == "regenerate":
                opened = {m: 1 for m in opened if m <= message}
            opened[message] = 1
            log.append((seq, message, kind, role, None if kind in ("open", "regenerate") else rng.choice([*SAYS, None])))
        rows += [(conv if conv else None, *e) for e in [*log, *log[:3]]]
    rng.shuffle(rows)
    messages = chat_format.fold(spark.createDataFrame(rows, chat_format.EVENTS).repartition(5)).orderBy("conv_id", "message").collect()
    got = collections.defaultdict(list)
    for r in messages:
        got[r["conv_id"]].append((r["role"], r["text"]))
    want = collections.defaultdict(list)
    for conv, *event in rows:
        want[conv].append(tuple(event))
    assert dict(got) == {c: plain_fold(log) for c, log in want.items()}


def test_renderings_read_back_as_they_were(spark):
    rows = [(i, t, role, text) for i in range(30) for t, (role, text) in enumerate([("user", SAYS[i % 10]), ("assistant", SAYS[i // 3]), (SAYS[(i + 3) % 10], "x"), ("assistant", None), (None, SAYS[5])])]
    rows += [(None, 1, "user", "no id"), (40, 1, "assistant", "twice"), (40, 1, "assistant", "twice"), (41, None, "user", "last"), (42, 0, "assistant", "word " * 200_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit(1)).repartition(4)
    rendered = chat_format.render(chat_format.fold(chat_format.replayed(frame)))
    got = {r["conv_id"]: r for r in chat_format.read_back(rendered).collect()}
    want = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        want[conv].append((turn or 0, role or "", text or ""))
    assert got.keys() == want.keys()
    for conv, turns in want.items():
        assert [tuple(t) for t in got[conv]["turns"]] == [x[1:] for x in sorted(turns)]
        assert got[conv]["learned"] == "".join(x[2] for x in sorted(turns) if x[1] == "assistant")
    for r in rendered.collect():
        pieces = r["formatted"].split("<|im_start|>")[1:]
        assert len(pieces) == len(r["turns"]) and not re.search(r"\[/?INST\]|</?s>|<</?SYS>>", r["formatted"])
        assert [t["at"] for t in r["turns"]] == [m.start() for m in re.finditer(re.escape("<|im_start|>"), r["formatted"])]
        assert all(r["formatted"][: t["loss_start"]].endswith("assistant<|im_sep|>") and r["formatted"][t["loss_end"] :].startswith("<|im_end|>") for t in r["turns"] if t["loss_start"] is not None)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.render(chat_format.fold(chat_format.replayed(none)))).count() == 0


def test_chat_plan_deals_once_and_has_no_python(spark):
    rows = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.read_back(chat_format.render(chat_format.fold(chat_format.replayed(rows))))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and not re.search("Python|Arrow|Pandas", plan)


# --- periodic runs


def plain_runs(words, least_words, least_times):
    n, out = len(words), set()
    for q in range(1, n // least_times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_times * q) and j > i:
                held = words[i : j + q]
                if not any(held[p:] == held[:-p] for p in range(1, q)):
                    out.add((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.mark.parametrize("least_words, least_times", [(24, 3), (5, 3), (1, 4)])
def test_runs_equal_brute_force(spark, odd_docs, no_docs, least_words, least_times):
    rng, texts = random.Random(13), []
    for _ in range(400):
        words = [rng.choice(rng.choice(["ab", "abc", "abcdefghijkl"])) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            a, q = rng.randrange(len(words) + 1), rng.randint(1, 20)
            for i in range(a + q, min(len(words), a + rng.randint(q, 5 * q + 10))):
                words[i] = words[i - q]
        texts.append(rng.choice(["", " \n"]) + rng.choice([" ", "\t\n"]).join(words) + rng.choice(["", " "]))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").unionByName(odd_docs.select("doc_id", "text"))
    docs = docs.withColumns({"runs": F.lit("theirs"), "a`b.c": F.lit(1)})
    got = periodic_runs.collapse(docs, "text", least_words, least_times).collect()
    assert len(got) == docs.count() and got[0]["a`b.c"] == 1
    for r in got:
        words = words_of(r["text"])
        runs = plain_runs(words, least_words, least_times)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == runs
        assert r["collapsed"] == (None if r["text"] is None else plain_collapse(words, runs))
    assert any(r["runs"] for r in got)
    assert periodic_runs.collapse(no_docs).count() == 0


def test_the_query_plants_and_reports_runs(spark, tmp_path):
    rng = random.Random(17)
    texts = {i: " ".join(rng.choice(["ka", "lo", "mi", f"w{rng.randint(0, 999)}"]) for _ in range(rng.randint(0, 120))) for i in range(300)} | {300: None, 301: " ", 302: "do " * 30}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic_runs.op13_periodic_runs(spark, str(tmp_path)).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        words, h = words_of(text), zlib.crc32(str(key).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = plain_runs(words, 24, 3)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        row = got[key]
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert sum(r["n_runs"] for r in got.values()) > 10

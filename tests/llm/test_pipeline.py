"""The pipeline's stages, over odd rows, against plain versions of their decisions."""

import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_the_columns_and_take_effect(spark, odd_docs, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd_docs.select(*columns)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name in ("toxicity", "line_dedup", "suffix_array_dedup"):
            assert docs.count() == before.count()
        if name == "ngram_jaccard_join":
            kept = {r["doc_id"] for r in docs.collect()}
            assert {20, 24, 33, 35} <= kept and not {21, 36} & kept
        if name != "packing":
            assert docs.columns == columns
            assert docs.filter(F.length("text") != F.col("n_chars")).count() == 0
    assert docs.count() > 0


def test_run_applies_the_stages(spark, tmp_path):
    text = lambda i: " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(80))
    rows = [(i, text(i), "en", "s", len(text(i))) for i in range(30)] + [(100, text(3) + " tail", "en", "s", len(text(3)) + 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == set(range(30))


def test_stages_catch_planted_cases_and_leave_the_rest(spark, tmp_path):
    """Near copies, and passages of over fifty words on lines of their own, within lines and across lines, among clean documents."""
    rng = random.Random(23)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = {i: "\n".join(prose(rng.randint(20, 60)) for _ in range(rng.randint(2, 6))) for i in range(60)}
    passages = {}
    for p in range(30):
        words = prose(rng.randint(51, 80)).split()
        for copy in range(rng.randint(2, 4)):
            half = len(words) // 2
            whole = [" ".join(words), f"{prose(9)} {' '.join(words)} {prose(9)}", " ".join(words[:half]) + "\n" + " ".join(words[half:])][p % 3]
            key = 1000 + 10 * p + copy
            texts[key] = f"{prose(60)}\n{whole}\n{prose(60)}"
            passages[key] = words
    copies = {}
    for i in range(30):
        words = texts[i].split(" ")
        for j in rng.sample(range(len(words)), max(1, len(words) // 60)):
            words[j] = "edited" if "\n" not in words[j] else words[j]
        copies[2000 + i] = i
        texts[2000 + i] = " ".join(words)
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    near, last = kept["ngram_jaccard_join"], kept["suffix_array_dedup"]
    # the line stage comes first: it cuts copies of three lines or more to their edited lines, and leaves the others to the next one
    whole = {k: kept["line_dedup"][k] == texts[k] for k in copies}
    assert sum(whole.values()) > 10 and all(k not in near for k in copies if whole[k])
    size = lambda x: len((x or "").split())
    assert sum(size(last.get(k)) for k in copies) <= 0.1 * sum(size(texts[k]) for k in copies)
    left = lambda key: sum(" ".join(passages[key][i : i + 10]) in " ".join(last[key].split()) for i in range(len(passages[key]) - 9))
    assert sum(not left(key) for key in passages) >= 0.9 * len(passages)
    clean = [i for i in range(30, 60)]
    assert all(last.get(i) == texts[i] for i in clean)

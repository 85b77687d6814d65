import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, line long, gram long, bucket int, shard int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties, and columns with clashing names."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6)))
    base = [word() for _ in range(120)]
    passage = " ".join(word() for _ in range(90))
    texts = {i: " ".join(word() for _ in range(rng.randint(1, 60))) for i in range(1, 12)}
    texts |= {20: " ".join(base), 21: " ".join(base), 22: " ".join(base[:-2] + ["x", "y"]), 23: " ".join(["q", *base]), 24: " ".join(base[:60])}
    texts |= {30: "", 31: " \n\t ", 32: None, 33: "One", 34: "one", 35: "a b c", 36: "a b c"}
    texts |= {40: f"{word()} {passage} {word()}", 41: f"{word()}\n{passage}\nend of it", 42: f"{passage}{passage}"}
    texts |= {50: "\n".join(["first line", "second line", "third line", "own"]), 51: "\n".join(["other", "first line", "", "second line", " third line ", "more"]), 52: "\n".join(["l1", "l2", "l3", "l4"] * 3)}
    texts |= {60: " ".join(word() for _ in range(9000)), 61: "aaaa " * 300, 62: "日本語テキスト " * 40, 63: "😀" * 150}
    rows = [(i, t, None if i % 7 == 0 else "en", None, None if t is None else len(t), i, i, i, 1, 2) for i, t in texts.items()]
    rows += [rows[4], rows[12], (None, "no id here at all", None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)

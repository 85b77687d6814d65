"""Runs of common characters are parted by their kinds, many at once, and not one by one."""

import random

import numpy as np

from medspan.llm import packing


def test_common_runs_are_not_parted_one_by_one(monkeypatch):
    from tokenizers import Tokenizer

    def one_by_one(self, run):
        raise AssertionError(f"parted by itself: {run}")

    monkeypatch.setattr(packing.Ids, "_parts", one_by_one)
    tokenizer, ids = Tokenizer.from_file(packing.default_tokenizer()), packing.Ids(packing.default_tokenizer())
    rng, letters = random.Random(3), [chr(i) for i in range(33, 256) if packing.KINDS[i] != packing.OTHER]
    texts = [rng.choice([" ", "\n", "　", " \t"]).join("".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    texts += ["Wörter. WÖRTER, wörter wörter! 12,5 ... -a- É1é", ""]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # learned, then cached
        assert ids.of_all(texts) == want


def test_runs_beyond_the_cache_keep_their_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_ENTRIES", 3)
    ids = packing.Ids(packing.default_tokenizer())
    texts = ["one two, Three", "three four's two. ﬁve", "five. Two <|endoftext|>six"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in ids.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids.of_all(texts) == want and [ids.of(t) for t in texts] == want

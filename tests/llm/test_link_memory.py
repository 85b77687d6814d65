"""Links of sets: what a task holds, and texts of one id."""

import tracemalloc

import numpy as np
import pyarrow as pa

from medspan.llm import ngram_join


def test_counts_of_a_large_batch_are_compared_in_little_memory():
    counts = np.zeros((10_000, 4, ngram_join.BUCKETS), dtype=np.uint8)
    counts[:, 0] = 1
    sides = [pa.array([c.tobytes() for c in counts], pa.binary())] * 2
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array(range(10_000)), *sides], names=["a", "b", "ca", "cb"])
    tracemalloc.start()
    kept = list(ngram_join._possible(85, 100)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert kept[0].num_rows == 10_000 and peak < 20_000_000


def test_near_texts_of_repeated_ids_link(spark):
    text = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    rows = [(5, text(i, 60)) for i in range(12)] + [(100 + i, text(i, 61)) for i in range(12)]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 24 and {r["component_id"] for r in got} == {5}

"""Edit distances of batches, in parts."""

import random
import tracemalloc

import pyarrow as pa

from sonolake.operators import errorrate


def test_distances_in_parts_of_a_batch(spark, monkeypatch):
    rng = random.Random(3)
    some = lambda: None if rng.random() < 0.1 else [rng.choice("abc") for _ in range(rng.randrange(9))]
    rows = [(i, some(), some()) for i in range(200)]
    d = spark.createDataFrame(rows, "i int, a array<string>, b array<string>").coalesce(1)
    found = {r.i: r.errors for r in errorrate.with_distance(d, "a", "b").collect()}

    class Taken:  # hands over the function that Spark would run in a task
        schema = d.schema

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    run = errorrate.with_distance(Taken(), "a", "b")
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())), strict=True)], ["i", "a", "b"])
    monkeypatch.setattr(errorrate, "TOKENS_AT_ONCE", 20)
    parts = list(run([batch, batch.slice(0, 0)]))
    assert len(parts) > 20 and {r["i"]: r["errors"] for p in parts for r in p.to_pylist()} == found
    monkeypatch.undo()
    words = pa.array([["w"] * 400] * 5000, pa.list_(pa.string()))
    tracemalloc.start()
    for part in run([pa.RecordBatch.from_arrays([pa.array(range(5000), pa.int32()), words, words], ["i", "a", "b"])]):
        del part
    assert tracemalloc.get_traced_memory()[1] < 12_000_000, "four million tokens are not held as Python's numbers together"
    tracemalloc.stop()

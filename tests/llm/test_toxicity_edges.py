"""Toxicity inputs that are unusual: letters beyond 16 bits, repeated labels and ids, no ids."""

import zlib

from matchweave.llm import toxicity


def test_stretches_of_any_letters_differ():
    one, other = (set(toxicity.grams([w]).ravel().tolist()) - {0} for w in ("\U00010900" * 6, "ऀ" * 6))
    assert one and other and not one & other


def test_repeated_labels_and_ids(spark):
    rows = [(i, ("nasty " if i % 2 else "calm ") + "word " * (i % 7)) for i in range(200)]
    rows += [(3, "nasty again")] * 3 + [(None, "nasty"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(3, 0), (3, 1)] * 5, "doc_id long, toxic int")
    got = toxicity.score(docs, labels).collect()
    assert len(got) == len(rows)
    assert all(x["held_out"] == (x["doc_id"] is not None and zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got)
    assert all(x["predicted"] == (x["doc_id"] or 0) % 2 for x in got if x["doc_id"] is not None and x["doc_id"] < 200)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    some = spark.createDataFrame([(1, "a", 1), (2, "b", 0)], "doc_id long, text string, toxic int")
    assert toxicity.score(none, some.drop("text")).count() == 0 and toxicity.keep_clean(none, some.drop("text")).count() == 0
    assert toxicity.keep_clean(some, none.drop("text")).count() == 2

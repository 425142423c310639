"""Positional postings: phrases against plain search, filters that change no score."""

import random

from pyspark.sql import functions as F

from matchweave.operators import lexical


def test_phrases_equal_a_plain_search(spark):
    r = random.Random(4)
    words = ["a", "b", "c", "d"]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 40))), " ".join(r.choices(words, k=5))) for i in range(60)] + [(60, None, ""), (61, "a a a a", "b")]
    asked = [(1, "a b"), (2, "c"), (3, "a a"), (4, "a b c d a"), (5, ""), (6, None), (7, "zzz a"), (8, "a a a")]
    table = spark.createDataFrame(docs, "doc_id long, body string, title string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    posted = lexical.postings(table, ["body", "title"], lexical.query_terms(queries))
    want = set()
    for q, text in asked:
        p = (text or "").split()
        for d, body, title in docs:
            for field, t in (("body", (body or "").split()), ("title", title.split())):
                times = sum(t[i : i + len(p)] == p for i in range(len(t) - len(p) + 1)) if p else 0
                if times:
                    want.add((q, d, field, times))
    got = lexical.phrases(posted, {"body": 1.0, "title": 2.0}, queries).collect()
    assert {(r.query_id, r.doc_id, r.field, r.times) for r in got} == want and len(got) == len(want) and all(r.score > 0 for r in got)
    assert {r.field for r in lexical.phrases(posted, {"title": 2.0}, queries).collect()} == {"title"}


def test_filters_change_no_score(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=20)), "x" if i % 3 else "y") for i in range(80)], "doc_id long, text string, kind string")
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=4))) for q in range(5)], "query_id long, text string")
    posted = lexical.postings(docs, ["text"], lexical.query_terms(queries))
    every = {(x.query_id, x.doc_id): x.score for x in lexical.multi_field(posted, {"text": 2.0}, queries).collect()}
    kept = {(x.query_id, x.doc_id): x.score for x in lexical.multi_field(posted, {"text": 2.0}, queries, within=docs.where("kind = 'y'")).collect()}
    assert kept == {k: v for k, v in every.items() if k[1] % 3 == 0} and kept
    pairs = spark.createDataFrame([(1, d) for d in range(0, 80, 2)], "query_id long, doc_id long")
    kept = {(x.query_id, x.doc_id): x.score for x in lexical.multi_field(posted, {"text": 2.0}, queries, within=pairs).collect()}
    assert kept == {k: v for k, v in every.items() if k[0] == 1 and k[1] % 2 == 0}


def test_one_scan_and_one_row_per_document_field(spark):
    docs = spark.createDataFrame([(1, "a b a", None), (2, "", "b")], "doc_id long, one string, two string")
    posted = lexical.postings(docs, ["one", "two"], spark.createDataFrame([("a",), ("b",)], "term string"))
    rows = {(r.doc_id, r.field, r.term): (r.len, r.positions) for r in posted.collect()}
    assert rows[(1, "one", "a")] == (3, [0, 2]) and rows[(1, "one", "b")] == (3, [1]) and rows[(2, "two", "b")] == (1, [0])
    assert {k for k in rows if k[2] == ""} == {(d, f, "") for d in (1, 2) for f in ("one", "two")}
    own = {(r.field, r.term): r.avg_len for r in lexical.weights(posted).collect()}
    assert own == {("one", "a"): 1.5, ("one", "b"): 1.5, ("two", "b"): 0.5}
    assert [lexical.clamped(n) for n in (-1, 0, 7, 200, 999)] == [1, 1, 7, 200, 200]


def test_more_like_this_leaves_itself_out(spark):
    docs = spark.createDataFrame([(1, "spark joins data"), (2, "spark joins tables"), (3, "cooking pasta"), (4, None)], "doc_id long, text string")
    got = lexical.more_like_this(docs, spark.createDataFrame([(1,)], "doc_id long"), 5).orderBy("rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 2)]
    assert lexical.more_like_this(docs, spark.createDataFrame([(4,)], "doc_id long"), 5).where(F.lit(True)).count() == 0

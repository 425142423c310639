"""Picks on a ring and label pools against a plain version."""

import hashlib

from matchweave.operators import quality


def place(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def ring(query, docs):
    own = place(f"7|query|{query}")
    return sorted(docs, key=lambda d: (place(f"7|{d}") < own, place(f"7|{d}"), d))


def test_picks_go_around_the_ring(spark):
    docs = [(i, "ab"[i % 2]) for i in range(3000)]
    items = spark.createDataFrame(docs, "doc_id long, family string")
    queries = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "a")], "query_id long, family string")
    # query 2 matches all of its 1,500 foreign items but two, query 3 all, query 4 the first of them
    taken = {(2, d) for d, f in docs if f == "a"} - {(2, d) for d in (10, 2010)} | {(3, d) for d, _ in docs} | {(4, d) for d in ring(4, [d for d, f in docs if f == "b"])[:200]}
    got = {}
    for r in quality.ring_pick(queries, items, spark.createDataFrame(sorted(taken), "query_id long, doc_id long"), 4).orderBy("query_id", "r").collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    want = {q: ring(q, [d for d, g in docs if g != f and (q, d) not in taken])[:4] for q, f in ((1, "a"), (2, "b"), (3, "a"), (4, "a"))}
    assert got == {q: w for q, w in want.items() if w} and sorted(got[2]) == [10, 2010] and len(got[4]) == 4


def test_pools_fall_back(spark):
    items = spark.createDataFrame([(i, "x" if i < 30 else "y") for i in range(60)], "doc_id long, family string")
    families = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "query_id long, family string")
    # 1 ranks ten of its own family; 2 matches every foreign item; 3 nothing at all
    ranking = [(1, d, d + 1) for d in range(10)] + [(2, 59 - d, d + 1) for d in range(30)]
    pool = quality.label_pool(spark.createDataFrame(ranking, "query_id long, doc_id long, rank int"), items, families, low=15, high=20).collect()
    of = lambda q, b: [r.doc_id for r in sorted(pool, key=lambda r: (r.rank or 0)) if (r.query_id, r.bucket) == (q, b)]
    assert len(pool) == 60 == len({(r.query_id, r.doc_id) for r in pool})
    assert of(1, "top") == list(range(8)) and of(1, "middle") == [] and sorted(of(1, "other")) == sorted(ring(1, range(30, 60))[:4]) and of(1, "fill") == [8, 9] and len(of(1, "any")) == 6
    assert of(2, "top") == list(range(59, 51, -1)) and of(2, "middle") == list(range(45, 39, -1))
    left = [d for d in range(60) if d not in of(2, "top") + of(2, "middle")]
    assert sorted(of(2, "other")) == sorted(ring(2, left)[:4]) and len(of(2, "fill")) + len(of(2, "any")) == 2
    assert sorted(of(3, "other")) == sorted(ring(3, range(30, 60))[:4]) and len(of(3, "any")) == 16

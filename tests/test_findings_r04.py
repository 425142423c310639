"""Cases of the fourth round's findings."""

from matchweave import registry

from test_findings_r03 import JOB_TABLES, against_sql, job_tables


def test_candidates_come_from_three_retrievers(spark, tmp_path):
    """lexical, semantic and graph lists are merged, not two graph lists."""
    job_tables(spark, tmp_path, 3)
    got, want = against_sql("candidate_union", spark, tmp_path, *JOB_TABLES)
    assert got == want and got
    found = registry.queries()["candidate_union"](spark, str(tmp_path)).collect()
    assert {s for r in found for s in r.sources.split(",")} == {"lexical", "semantic", "graph"}
    assert sorted(r.position for r in found) == list(range(1, len(found) + 1)) and len({r.job_id for r in found}) == len(found)


def test_all_skills_that_hold_a_word_count(spark, tmp_path):
    """F16: no word stops at ten of the skills that contain it."""
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    job_tables(spark, tmp_path / "other", 1)
    for t in ("customer", "nation", "region", "orders"):
        spark.read.parquet(f"{tmp_path}/other/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    make("part", [(i, f"Large ring{i:02d}", "Brand#1", 1) for i in range(14)] + [(14, "extralarge bolt", "Brand#2", 1), (15, "old bolt", "Brand#2", 1)], "p_partkey long, p_name string, p_brand string, p_size int")
    make("lineitem", [(0, 13), (1, 12), (1, 13), (2, 0), (3, 15), (4, 14)], "l_orderkey long, l_partkey long")
    got, want = against_sql("graph_text_match", spark, tmp_path, *JOB_TABLES)
    assert got == want
    found = {(r.query_id, r.job_id): (r["rank"], r.skills) for r in registry.queries()["graph_text_match"](spark, str(tmp_path)).collect()}
    assert found[("Brand#1", 1)] == (1, "Large ring12|Large ring13") and found[("Brand#1", 0)][1] == "Large ring13" and ("Brand#1", 4) in found


def test_keywords_meet_all_jobs_that_require_one(spark, tmp_path):
    """jobs with one asked skill are there as well. F2: asked names inside required ones, in either case,
    more of them than a word has bits, against the plain rule."""
    from pyspark.sql import functions as F

    from matchweave.functions import scores as sc
    from matchweave.operators import graph, search

    job_tables(spark, tmp_path, 2)
    got, want = against_sql("keyword_rerank", spark, tmp_path, *JOB_TABLES)
    assert got == want and len(got) == 12  # all jobs, also those of one skill

    names = [f"Skill {i}" for i in range(150)] + ["skill 1", "kill", "", "Go", "golang", "x"]
    asked = [("a", n) for n in names[:140]] + [("a", "kill"), ("b", "go"), ("b", ""), ("c", "y"), ("d", "skill 14"), ("d", "SKILL 14")]
    need = [(j, names[(j * 7 + k * k) % len(names)]) for j in range(200) for k in range(j % 5)]
    q, r = spark.createDataFrame(asked, "query_id string, skill string"), spark.createDataFrame(need, "job_id long, skill string")
    rows = graph.keyword_hits(q, r.select("skill"), r).collect()
    one = {(x.query_id, x.job_id): x.hits for x in graph.one_hop(q, r).collect()}
    assert {(x.query_id, x.job_id): x.hits for x in rows} == one and len(rows) == len(one)
    pairs = spark.createDataFrame([(*k,) for k in one], "query_id string, job_id long").join(q.groupBy("query_id").agg(F.collect_set("skill").alias("asked")), "query_id").join(r.groupBy("job_id").agg(F.collect_set("skill").alias("need")), "job_id")
    share = {(x.query_id, x.job_id): x.share for x in pairs.select("query_id", "job_id", sc.skill_keyword(F.col("need"), F.col("asked")).alias("share")).collect()}
    assert {(x.query_id, x.job_id): min(x.found / x.asked, 1.0) for x in rows} == share and {x.asked for x in rows} > {141}

    scored = spark.createDataFrame([(j % 3, j, float(j * j % 11)) for j in range(500)], "query_id long, job_id long, score double")
    key = lambda df: sorted((x.query_id, x.job_id, x.score, x["rank"]) for x in df.collect())
    assert key(search.ranked_whole(scored)) == key(search.ranked(scored)) and search.ranked_whole(scored).schema["rank"].dataType == search.ranked(scored).schema["rank"].dataType


def broadcast(df):
    return "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()


def test_written_tables_are_broadcast_by_their_rows(spark, monkeypatch):
    """a table that packs well looks small by its files, whatever its rows would hold."""
    from matchweave.sources import shared

    many = shared.written(spark.range(300_001).selectExpr("id div 1000 AS query_id", "0L AS doc_id"), "many")
    rows = spark.range(10).selectExpr("id AS query_id", "id AS doc_id")
    assert broadcast(rows.join(many, ["query_id", "doc_id"], "left_anti"))
    held = rows.join(shared.bounded(many), ["query_id", "doc_id"], "left_anti")
    assert not broadcast(held) and held.count() == 9
    assert broadcast(rows.join(shared.bounded(shared.written(rows, "few")), ["query_id", "doc_id"]))


def test_pools_ask_only_for_pairs_that_are_looked_at(spark, tmp_path, monkeypatch):
    """not all matching pairs are written, also where no table is broadcast; phrases as well."""
    from matchweave.operators import quality
    from matchweave.sources import shared

    r = __import__("random").Random(3)
    texts = [" ".join(r.choices(["data", "engineer", "of", "rust", "plan", "wood"], k=6)) if i % 5 else "cooking pasta" for i in range(600)]
    rows = [(i, t, "ende"[i % 2 * 2 : i % 2 * 2 + 2], "src1") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "data engineer"), (1, "cooking of wood"), (2, "plan"), (3, "none of these"), (4, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(quality, "CELL", 4)
    names, write = [], shared.written
    monkeypatch.setattr(quality, "written", lambda df, name="table": (names.append(name), write(df, name))[1])
    for few in (250_000, 1):
        monkeypatch.setattr(shared, "FEW", few)
        for name in ("label_pool", "pool_report", "phrase_hits", "bm25_multifield"):
            got, want = against_sql(name, spark, tmp_path, "documents", "benchmark")
            assert got == want and got
    assert "looked" in names and "matched" not in names


def test_the_best_of_blocks_are_the_best_of_all(spark, monkeypatch):
    """sums of products against plain ones, over several blocks, with ties, and no row a pair."""
    import random

    import numpy as np

    from matchweave.operators import vectors

    r = random.Random(5)
    items = {i: {p: r.choice([0.5, 1.0, 2.0]) for p in r.sample(range(12), r.randint(1, 4))} for i in range(400)}
    asked = {q: {p: r.choice([1.0, -0.5]) for p in r.sample(range(15), r.randint(1, 5))} for q in range(0, 2**60 * 3, 2**60)} | {7: {1: 1.0}, 8: {2: 1.0}}
    a = spark.createDataFrame([(i, p, x) for i, v in items.items() for p, x in v.items()], "item_id long, place long, x double")
    q = spark.createDataFrame([(i, p, y) for i, v in asked.items() for p, y in v.items()], "query_id long, place long, y double")
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 60)
    monkeypatch.setattr(vectors, "ASKED", 2)
    monkeypatch.setattr(vectors, "ROWS", 1)
    for itself in (True, False):
        want = set()
        for n, v in asked.items():
            sums = {i: round(sum(y * w.get(p, 0) for p, y in v.items()), 6) for i, w in items.items() if itself or i != n}
            want |= {(n, i, s, k) for k, (s, i) in enumerate(sorted(((s, i) for i, s in sums.items() if s > 0), key=lambda t: (-t[0], t[1]))[:9], 1)}
        got = vectors.sparse_best(a, q, 9, 400, itself=itself)
        assert {tuple(x) for x in got.select("query_id", "item_id", "score", "rank").collect()} == want
    whole = vectors.sparse_best(a, q, 9, 400, finish=lambda s: np.floor(s))
    assert all(x.score == int(x.score) >= 1 for x in whole.collect())


def test_similar_documents_write_no_corpus(spark, tmp_path, monkeypatch):
    """no postings of all documents are written; empty texts and equal documents."""
    from matchweave.operators import lexical

    r = __import__("random").Random(8)
    texts = [" ".join(r.choices([f"w{i}" for i in range(60)], k=r.randint(1, 30))) for _ in range(300)] + ["", "w4", "w1 w2 w3", "w1 w2 w3"]
    documents = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0 or i > 299)) for i in range(304)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names, write = [], lexical.written
    monkeypatch.setattr(lexical, "written", lambda df, name="table": (names.append(name), write(df, name))[1])
    spark.createDataFrame([(1, "x")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got, want = against_sql("more_like_this", spark, tmp_path, "documents", "labels", "benchmark")
    assert got == want and len(got) > 150 and "postings" not in names


def test_retrievers_score_no_pair_as_a_row(spark, tmp_path):
    """the best of each list come from blocks; the same rows as plain scores, and skills in
    either case."""
    from matchweave.operators import graph, lexical

    need = spark.createDataFrame([(j, s) for j in range(300) for s in ("a", "b", "B", "c")[: j % 5] + (("d",) if j % 7 == 0 else ())], "job_id long, skill string")
    asked = spark.createDataFrame([("q", "A"), ("q", "b"), ("r", "d"), ("r", "B"), ("s", "z")], "query_id string, skill string")
    key = lambda df: sorted(tuple(x) for x in df.select("query_id", "job_id", "hits", "rank").collect())
    for k in (7, 400):
        assert key(graph.best_by_skills(asked, need, k, any_case=True)) == key(lexical.top_k(graph.one_hop(asked, need), k, item="job_id", score="hits"))
    docs = spark.createDataFrame([(i, " ".join(f"w{i * p % 11}" for p in (1, 3, 5)), 1 + i % 3) for i in range(200)], "doc_id long, text string, copies long")
    queries = spark.createDataFrame([("x", "w1 w2 w2 w9"), ("y", "w0"), ("z", "none")], "query_id string, text string")
    index = lexical.indexed(docs, queries)
    whole = lexical.scores(*index)
    rows = lambda df: sorted(tuple(x) for x in df.select("query_id", "doc_id", "score", "rank").collect())
    best = lexical.best_scores(*index, 9)
    assert rows(best) == rows(lexical.top_k(whole, 9)) and "BatchEvalPython" not in (plan := best._jdf.queryExecution().executedPlan().toString()) and "FlatMapCoGroupsInPandas" in plan
    some = spark.createDataFrame([("x", d) for d in range(0, 200, 3)] + [("z", 1)], "query_id string, doc_id long")
    pairs = {(r.query_id, r.doc_id): r.score for r in whole.collect()}
    assert {(r.query_id, r.doc_id): r.score for r in lexical.scores(*index, within=some).collect()} == {k: v for k, v in pairs.items() if k[0] == "x" and k[1] % 3 == 0}


def test_pairs_of_a_label_travel_as_one_row_a_block(spark, monkeypatch):
    """rankings over several blocks, ties, large ids and one missing; no pair is dealt or sorted as a row."""
    import numpy as np

    from matchweave.operators import vectors

    r = np.random.default_rng(3)
    rows = [(2**60 + i * 7, [float(x) for x in r.integers(-1, 2, 3)], int(i % 2)) for i in range(90)] + [(5, None, 1), (6, [0.0, 0.0, 0.0], 0)]
    items = spark.createDataFrame(rows, "item_id long, embedding array<double>, label int")
    asked = items.where("item_id % 3 = 0").selectExpr("item_id AS query_id", "embedding", "label AS wanted")
    monkeypatch.setattr(vectors, "ITEM_BLOCK", 20)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    ranked = vectors.cosine_alike(items, asked)
    unit = {i: np.zeros(3) if e is None or not np.any(e) else np.array(e) / np.linalg.norm(e) for i, e, _ in rows}
    got = {}
    for x in ranked.orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.item_id, x.score, x["rank"]))
    label = {i: lab for i, _, lab in rows}
    assert set(got) == {i for i in label if i % 3 == 0}
    for q, found in got.items():
        want = sorted(((i, round(float(unit[q] @ unit[i]), 6) + 0.0) for i in label if label[i] == label[q]), key=lambda t: (-t[1], t[0]))
        assert [(i, s + 0.0, k) for i, s, k in found] == [(i, s, k) for k, (i, s) in enumerate(want, 1)]
    assert "Window" not in ranked._jdf.queryExecution().executedPlan().toString()
    missing = vectors.cosine_alike(spark.createDataFrame([(None, [1.0], 1), (4, [1.0], 1)], "item_id long, embedding array<double>, label int"), spark.createDataFrame([(4, [1.0], 1)], "query_id long, embedding array<double>, wanted int"))
    assert [(x.item_id, x["rank"]) for x in missing.orderBy("rank").collect()] == [(None, 1), (4, 2)]

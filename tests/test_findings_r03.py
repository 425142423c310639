"""Cases of the third round's findings."""

import pytest

from matchweave import registry

from test_queries import plain


def against_sql(name, spark, folder, *tables):
    """Rows of a query and of its SQL on the tables of a folder, sorted."""
    import duckdb

    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    rel = con.sql(registry.oracle_sql()[name])
    got = sorted([[plain(r[c]) for c in columns] for r in df.collect()], key=str)
    want = sorted([[plain(r[rel.columns.index(c)]) for c in columns] for r in rel.fetchall()], key=str)
    return got, want


def documents(spark, folder, *texts):
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")


def test_accented_letters_make_no_names(spark, tmp_path):
    documents(spark, tmp_path, "from teéas to Ohio", "eépert and señior", "datá engineeré, data engineer — Austin", None)
    got, want = against_sql("query_keywords", spark, tmp_path, "documents")
    assert got == want
    assert not any("Texas" in str(r) for r in got[:1])


def test_words_end_at_letters_of_any_language(spark, tmp_path):
    documents(spark, tmp_path, "capeño and pmpé", "based in sûr", "fluent in germané; moderné", "based in paris—rn", None)
    got, want = against_sql("hard_constraints", spark, tmp_path, "documents")
    assert got == want


def test_each_brand_asks_for_all_its_skills(spark, tmp_path):
    from matchweave.sources import graph_tables

    rows = [(i, f"skill {i % 12}", "Brand#1", 1 + i % 4) for i in range(48)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = {r["skill"] for r in graph_tables.asked(spark, str(tmp_path)).collect()}
    assert got == {r[1] for r in rows if r[3] <= 3} and len(got) > 5


def test_shares_halfway_between_two_scores(spark, tmp_path):
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    make("part", [(i, f"skill {i}", "Brand#1", 1) for i in range(32)], "p_partkey long, p_name string, p_brand string, p_size int")
    hits = range(2, 32)
    make("lineitem", [(h, i) for h in hits for i in range(h)], "l_orderkey long, l_partkey long")
    make("customer", [(i, i % 2, ("BUILDING", "MACHINERY", "FURNITURE")[i % 3]) for i in range(6)], "c_custkey long, c_nationkey long, c_mktsegment string")
    make("nation", [(0, "A", 0), (1, "B", 1)], "n_nationkey long, n_name string, n_regionkey long")
    make("region", [(0, "ASIA"), (1, "AFRICA")], "r_regionkey long, r_name string")
    orders = [(h, h % 6, "O", "1-URGENT", (5000.0, 8000.0, 400.0)[h % 3]) for h in hits]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double").selectExpr("*", "timestamp_ntz'1997-01-01' AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got, want = against_sql("keyword_rerank", spark, tmp_path, "part", "lineitem", "customer", "nation", "region", "orders")
    assert len(got) == len(hits) and got == want


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_scores_add_up_without_a_shuffle_of_pairs(spark):
    from matchweave.operators import graph, lexical

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "a b")], "query_id long, text string")
    assert exchanges(lexical.bm25(docs, asked)) <= 1
    need = spark.createDataFrame([(1, "x"), (1, "y"), (2, "y")], "job_id long, skill string").repartition(2, "job_id")
    hits = graph.one_hop(spark.createDataFrame([("q", "X"), ("q", "y")], "query_id string, skill string"), need)
    assert exchanges(hits) <= 1
    assert {(r.job_id, r.hits) for r in hits.collect()} == {(1, 2), (2, 1)}


def test_a_label_without_vectors_scores_zero(spark):
    from matchweave.operators import vectors

    items = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, None, 5), (3, [1.0, 0.0], 6)], "item_id long, embedding array<double>, label int")
    asked = items.where("item_id = 1").selectExpr("item_id AS query_id", "embedding", "label AS wanted")
    assert {(r.item_id, r.score, r.rank) for r in vectors.cosine_alike(items, asked).collect()} == {(1, 1.0, 1), (2, 0.0, 2)}


def job_tables(spark, folder, copies, size=lambda i: 1 + i % 3):
    """One brand with 12 skills and jobs that have copies under other numbers, the later ones of earlier dates."""
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    make("part", [(i, f"{'abcdefghijkl'[i]}ed {('bolt', 'gear', 'ring')[i % 3]}", "Brand#1", size(i)) for i in range(12)], "p_partkey long, p_name string, p_brand string, p_size int")
    kinds = [[0], [11], [5, 6, 7], [10, 11], list(range(12)), [3, 3, 4]]
    jobs = [(c * 100 + k, parts) for c in range(copies) for k, parts in enumerate(kinds)]
    make("lineitem", [(j, p) for j, parts in jobs for p in parts], "l_orderkey long, l_partkey long")
    make("customer", [(i, i % 2, ("BUILDING", "MACHINERY")[i % 2]) for i in range(4)], "c_custkey long, c_nationkey long, c_mktsegment string")
    make("nation", [(0, "NATION_0", 0), (1, "NATION_1", 1)], "n_nationkey int, n_name string, n_regionkey int")
    make("region", [(0, "ASIA"), (1, "AFRICA")], "r_regionkey int, r_name string")
    orders = [(j, j % 4, "O", "1-URGENT", 5000.0, j % 7) for j, _ in jobs]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_totalprice double, d int").selectExpr("* except (d)", "timestamp_ntz'1999-01-01' - make_dt_interval(d) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    return len(jobs)


JOB_TABLES = ("part", "lineitem", "customer", "nation", "region", "orders")


@pytest.mark.parametrize("name", ["skill_hops2", "related_skills", "skill_path", "keyword_rerank", "pair_features", "candidate_union", "hybrid_search", "search_chain"])
def test_a_brand_asks_for_more_than_five_skills(name, spark, tmp_path):
    job_tables(spark, tmp_path, 1)
    got, want = against_sql(name, spark, tmp_path, *JOB_TABLES)
    few = registry.oracle_sql()[name].replace("FROM part WHERE p_size <= 3)", "FROM part WHERE p_size <= 3 ORDER BY p_name LIMIT 5)")
    assert got == want and few != registry.oracle_sql()[name]
    import duckdb

    con = duckdb.connect()
    for t in JOB_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(con.sql(few).fetchall(), key=str) != sorted(con.sql(registry.oracle_sql()[name]).fetchall(), key=str)


@pytest.mark.parametrize("name", ["text_search", "feature_vector", "skill_path", "pair_features", "search_chain"])
def test_equal_jobs_are_scored_once_and_all_found(name, spark, tmp_path, monkeypatch):
    from matchweave.operators import graph, lexical

    seen, hops, listed = [], graph.one_hop, lexical._listed
    monkeypatch.setattr(lexical, "_listed", lambda said, keys: (seen.append(said.select("doc_id").distinct().count()), listed(said, keys))[1])
    monkeypatch.setattr(graph, "one_hop", lambda asked, need: (seen.append(need.select("job_id").distinct().count()), hops(asked, need))[1])
    jobs = job_tables(spark, tmp_path, 40)
    got, want = against_sql(name, spark, tmp_path, *JOB_TABLES)
    assert got == want and jobs == 240
    if name in ("text_search", "pair_features", "search_chain"):
        assert seen and max(seen) <= 24  # kinds of jobs, by company


def test_walks_move_no_walkers(spark):
    """a walk from shared node to shared node is by the probability of both steps together, and no
    step deals walkers anew."""
    from pyspark.sql import functions as F

    from matchweave.operators import graph
    from matchweave.sources.shared import written

    owned = {f"o{i}": sorted({i % 3, i % 4, i % 5}) for i in range(60)}
    owners = written(spark.createDataFrame(list(owned.items()), "node string, ids array<long>"), "owners")
    walked = graph._shared_walks(owners, 100, 7, 3)
    plan = walked._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
    rows = walked.collect()
    assert len(rows) == (60 + 5) * 100 and {len(r.line) for r in rows} == {3, 4} and all(len(r.line) == (3 if r.owned else 4) for r in rows)
    assert all(r.line[0] in owned[r.node] if r.owned else r.line[0] == int(r.node) for r in rows)
    met = walked.select(F.posexplode(F.transform(F.slice("line", 1, F.size("line") - 1), lambda x, i: F.struct(x.alias("a"), F.get("line", i + 1).alias("b"))))).groupBy("col.a", "col.b").count().collect()
    steps = {(r.a, r.b): r["count"] for r in met}
    for a in range(5):
        through = [ids for ids in owned.values() if a in ids]
        total = sum(n for (x, _), n in steps.items() if x == a)
        for b in range(5):
            want = sum((b in ids) / len(ids) for ids in through) / len(through)
            assert abs(steps.get((a, b), 0) / total - want) < 0.03


def test_wide_owners_walk_edge_by_edge(spark, monkeypatch):
    from matchweave.operators import graph

    edges = spark.createDataFrame([(f"job:{i}", f"skill:{(i + k) % 7}") for i in range(20) for k in range(3)], "src string, dst string")
    monkeypatch.setattr(graph, "DENSE", 2)
    got = {r.node: r.embedding for r in graph.graph_embedding(edges, dims=8, walks=3, steps=6, parts=1).collect()}
    assert set(got) == {x for r in edges.collect() for x in r} and all(len(v) == 8 for v in got.values())
    some = edges.selectExpr("src AS node").where("src < 'job:15'")
    assert {r.node for r in graph.graph_embedding(edges, dims=8, walks=3, steps=6, parts=1, only=some).collect()} == {r.node for r in some.distinct().collect()}


def test_skills_are_found_in_one_pass_within_the_row(spark, tmp_path):
    """the text is read once for all names of skills, and no skill leaves its document's row."""
    from pyspark.sql import functions as F

    from matchweave.functions import text as tx

    names = sorted({n.replace("\\+", "+").replace("\\.?", ".") for p in tx.SKILLS for n in p[len(r"\b(?:") : -len(r")\b")].split("|")})
    said = [f"{a} {b}, {b}{a} {a}-{b}/{a}" for a, b in zip(names, names[7:] + names[:7])] + [" ".join(names).upper(), "C++Go C#x CI/CD/API web services-rest scikit-learn.git", ""]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    apart = F.concat(*[F.regexp_extract_all("text", F.lit("(?i)" + p), F.lit(0)) for p in tx.SKILLS])
    assert df.where(tx.skills(F.col("text")) != F.array_sort(F.array_distinct(F.transform(apart, lambda x: F.lower(x))))).count() == 0
    documents(spark, tmp_path, *said, None)
    got, want = against_sql("marketability", spark, tmp_path, "documents")
    assert got == want
    plan = registry.queries()["marketability"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_pools_are_ranked_once_and_scored_in_bounded_tasks(spark, tmp_path, monkeypatch):
    """the pool is written before labels are made of it twice, and a task scores a bounded number
    of documents."""
    from matchweave.operators import lexical

    documents(spark, tmp_path, *[f"data {i} engineer" for i in range(40)], None)
    spark.createDataFrame([(i, f"engineer of data {i}") for i in range(4)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(lexical, "SCORED", 10)
    assert lexical.by_document(spark.range(41).withColumnRenamed("id", "doc_id"), 41).rdd.getNumPartitions() == 5
    for name in ("first_issues", "label_validation"):
        got, want = against_sql(name, spark, tmp_path, "documents", "benchmark")
        assert got == want and got
        plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "/pool-" in plan and "/counts-" not in plan


def test_character_ngrams_are_hashed_once_each(spark, tmp_path, monkeypatch):
    """letters of any script, empty and short texts, groups of texts; no lambda runs for each letter."""
    from matchweave.operators import vectors

    documents(spark, tmp_path, "Straße 東京 naïve 😀😀x", "", None, "a", "ab", "banana bananas\nBANANA", "ÀÉ" * 50, "abc")
    got, want = against_sql("char_ngram_embedding", spark, tmp_path, "documents")
    assert got == want and len(got) > 50
    parts = [vectors._ngram_buckets(t, 2, 4, 768) for t in (["banana", "", "ban"], ["banana"], ["ban"])]
    assert {(r, b): w for r, b, w in zip(*parts[0])} == {(r, b): w for r, b, w in zip(*parts[1])} | {(2, b): w for _, b, w in zip(*parts[2])}
    plan = registry.queries()["char_ngram_embedding"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan and "Exchange" not in plan


def test_missing_skills_are_those_without_a_close_one(spark):
    """words of own skills once instead of every needed skill with every own one."""
    from pyspark.sql import functions as F

    from matchweave.functions import scores as sc

    rows = [(["big data", "go", "python 3", "sql", "x"], own) for own in (["python"], ["golang", "data science"], ["no sql", " x"], [""], [], ["big  data", "sq"])]
    df = spark.createDataFrame(rows, "need array<string>, own array<string>")
    plain_ = F.filter(F.zip_with("need", sc.fuzzy_skills(F.col("need"), F.col("own")), lambda n, x: F.when(x.isNull(), n)), lambda x: x.isNotNull())
    got = df.select(plain_.alias("a"), sc.fuzzy_missing(F.col("need"), F.col("own"), sc.skill_words(F.col("own"))).alias("b")).collect()
    assert all(r.a == r.b for r in got) and len({tuple(r.a) for r in got}) > 3

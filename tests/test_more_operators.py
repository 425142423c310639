"""Small cases of posting, graph, score, vector and store operators."""

import datetime as dt

from pyspark.sql import functions as F

from matchweave.functions import scores as sc
from matchweave.functions import text as tx
from matchweave.operators import evaluation, graph, postings, search, vectors
from matchweave.plans import vectors as vector_plans
from matchweave.sources import readers

DATA = "/root/testdata/sf0.01"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_sections_and_requirements(spark):
    text = "Intro line\n\nRequired qualifications\n Python and SQL \nGit\nBenefits:\nRequired qualifications\nDocker\nSalary\n100k\nLocation"
    df = spark.createDataFrame([(1, text), (2, None), (3, "Salary")], "job_id long, text string")
    found = postings.sections(df)
    got = {(r["job_id"], r["section"]): r["content"] for r in found.collect()}
    assert got == {(1, "general"): "Intro line", (1, "required qualifications"): "Docker", (1, "salary"): "100k"}
    r = postings.requirements(found).first()
    assert (r["required_skills"], r["preferred_skills"], r["qualifications"], r["salary"], r["location"]) == (["docker"], [], 1, "100k", None)


def test_terms_and_places_in_text(spark):
    t = F.lit("We met in San Jose, CA and near Paris. React and Json Tools; Software")
    assert one(spark, tx.technical_terms(t)) == ["Json Tools", "React"]
    assert one(spark, tx.named_places(t)) == ["Paris", "San Jose, CA"] or "San Jose, CA" in one(spark, tx.named_places(t))
    assert [one(spark, tx.salaries(F.lit(x))) for x in ("pays 80k to 100k annual", "70 - 90k per year", "500 to 700 yearly", "9999999999999999999 - 5 yearly")] == [(80_000, 100_000), (70_000, 90_000), (500, 700), (5, 5)]
    assert one(spark, tx.salaries(F.lit("$9999999999999999999 and $9223372036854775k"))) == one(spark, tx.salaries(F.lit("$9223372036854775k and $9999999999999999999")))


def test_years_and_degrees(spark):
    held = F.expr("array(named_struct('start', date'2020-01-01', 'end', date'2021-01-01'), named_struct('start', date'2022-01-01', 'end', cast(null as date)), named_struct('start', cast(null as date), 'end', cast(null as date)))")
    now = F.lit("2022-12-31").cast("date")
    assert abs(one(spark, sc.worked_years(held, F.array(F.lit(9.0)), now)) - (366 + 364) / 365.25) < 1e-9
    empty = F.array().cast("array<struct<start: date, end: date>>")
    assert one(spark, sc.worked_years(empty, F.array(F.lit(2.0), F.lit(None).cast("double")), now)) == 2.0
    assert one(spark, sc.worked_years(F.lit(None).cast("array<struct<start: date, end: date>>"), F.lit(None).cast("array<double>"), now)) == 0.0
    assert one(spark, sc.degree_value(F.array(F.lit("Master of arts"), F.lit("bachelor")))) == 3 and one(spark, sc.degree_value(F.lit(None).cast("array<string>"))) == -1


def test_keyword_scores(spark):
    need, asked = F.array(F.lit("small ring"), F.lit("tool")), F.array(F.lit("ring"), F.lit("hat"))
    assert one(spark, sc.skill_keyword(need, asked)) == 0.5  # a name inside another counts
    assert one(spark, sc.keyword_mix(F.lit(1.0), F.lit(0.5))) == 0.8
    assert one(spark, sc.attributions({"a": F.lit(0.125), "b": F.lit(-0.375)}, 2)) == "b=-0.38, a=+0.12"


def test_graph_writes_and_paths(spark):
    known = spark.createDataFrame([("a", "b", "x", 0.5, 1)], "src string, dst string, kind string, confidence double, seq int")
    new = spark.createDataFrame([("b", "a", "y", 0.9, 2)], known.schema)
    assert [tuple(r)[:4] for r in graph.write_relations(known, new).collect()] == [("a", "b", "y", 0.9)]
    skills = spark.createDataFrame([(1, "s", None, None), (1, "s", None, None)], "candidate_id long, skill string, level string, years int")
    past = spark.createDataFrame([(1, "c", "p", dt.date(2020, 1, 1), None)], "candidate_id long, company string, position string, start_date date, end_date date")
    e = {r["type"]: r["props"] for r in graph.candidate_edges(skills, past).collect()}
    assert len(e) == 2 and '"level":"intermediate"' in e["HAS_SKILL"] and '"years":"0"' in e["HAS_SKILL"] and "2020-01-01" in e["WORKED_AT"]
    asked = spark.createDataFrame([("q", "Rome")], "query_id string, place string")
    located = spark.createDataFrame([(1, "rome"), (1, "Italy"), (2, "italy"), (3, "Peru")], "job_id long, place string")
    assert sorted((r["job_id"], r["hops"]) for r in graph.path_to_place(asked, located).collect()) == [(1, 1), (2, 3)]
    pairs = spark.createDataFrame([("a", "b")], "a string, b string")
    assert graph.relatedness(pairs, None).first()["relatedness"] == 0.5
    need, own = spark.createDataFrame([(5, "s"), (5, "t")], "job_id long, skill string"), spark.createDataFrame([(1, "s")], "candidate_id long, skill string")
    gap = graph.skill_gap(spark.createDataFrame([(1, 5, "f", "f"), (1, 6, "f", "f")], "candidate_id long, job_id long, family string, job_family string"), need, own).orderBy("job_id").collect()
    assert (gap[0]["family_match"], gap[1]["family_match"], gap[0]["coverage"]) == (1, 0, 0.5) and gap[0]["evidence"] == ["candidate 1 -HAS_SKILL-> s <-REQUIRES_SKILL- job 5"]


def test_texts_ranked_on_the_fly(spark):
    q = spark.createDataFrame([(1, "data engineer")], "query_id long, text string")
    t = spark.createDataFrame([(7, "engineer of data"), (8, " "), (9, None), (10, "cook")], "item_id long, text string")
    pairs = t.selectExpr("1L as query_id", "item_id")
    got = [(r["item_id"], r["rank"]) for r in vectors.rank_texts(pairs, q, t).orderBy("rank").collect()]
    assert got == [(7, 1), (8, 2), (9, 3), (10, 4)]
    assert [r["item_id"] for r in vectors.sparse_topk(q, t, 3).collect()] == [7]


def test_fuzzy_search_finds_mistyped_words(spark):
    day = dt.datetime(2024, 1, 1)
    jobs = spark.createDataFrame([(1, "engineer", "pipes", ["python"], day), (2, "engineer", "pipes", ["python"], day + dt.timedelta(1)), (3, "cook", "food", [], day)], "job_id long, title string, description string, skills array<string>, posted_date timestamp")
    asked = spark.createDataFrame([(1, "enginer pythn")], "query_id long, text string")
    assert [r["doc_id"] for r in search.fuzzy_text_search(jobs, asked, 5).orderBy("rank").collect()] == [2, 1]  # the newest first


def test_recall_of_hashed_vectors(spark):
    items = vector_plans._items(spark, DATA)
    asked = vector_plans._asked(items)
    true = {tuple(r) for r in vectors.cosine_topk(items, asked, 10).select("query_id", "item_id").collect()}
    got = {tuple(r) for r in vectors.lsh_candidates(items, asked, 10).select("query_id", "item_id").collect()}
    assert len(true & got) >= 0.9 * len(true)


def test_repeated_labels_count_once(spark):
    ranking = spark.createDataFrame([(1, 5, 1, 1.0), (1, 6, 2, 0.5)], "query_id long, doc_id long, rank int, score double")
    labels = spark.createDataFrame([(1, 5, 3, 1), (1, 5, 0, 2), (1, 6, 2, 1)], "query_id long, doc_id long, grade int, seq int")
    r = evaluation.metrics(ranking, labels).first()
    assert (r["mrr"], r["recall_5"]) == (0.5, 1.0)


def test_stores(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 1, 1), (1, "b", 2, 2), (None, "c", 1, 3), (2, None, 1, 4), (3, "x", 1, 5), (3, "y", 1, 6)], "job_id long, title string, ingest_ts int, line int")
    report = sorted((r["kind"], r["n"], r["line"] or 0) for r in readers.bulk_store(rows, f"{tmp_path}/s", order="line").collect())
    assert report == [("accepted", 4, 0), ("no id", 1, 3), ("no title", 1, 4), ("refused", 2, 0)]
    assert sorted((r["job_id"], r["title"]) for r in spark.read.parquet(f"{tmp_path}/s").collect()) == [(1, "b"), (3, "y")]
    readers.clear(rows, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == 0
    asked = spark.createDataFrame([(3, 1), (9, 2), (1, 3)], "job_id long, pos int")
    assert [r["pos"] for r in readers.multi_get(rows.where("ingest_ts = 1 and title != 'y'"), asked).orderBy("pos").collect()] == [1, 3]
    assert readers.without(rows, asked).where("job_id is not null").select("job_id").distinct().count() == 1

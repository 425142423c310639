"""Hand-made rows for the rules that a reader would not guess."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from matchweave.functions import normalize as nz
from matchweave.functions import scores as sc
from matchweave.functions import text as tx
from matchweave.operators import evaluation, graph, lexical, vectors
from matchweave.operators.candidates import merge, source_counts
from matchweave.sources import readers
from matchweave.streaming import ingest


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "want"),
    [("Austin, TX", ("Austin", "TX", "USA")), ("New York NY", ("New York", "NY", "USA")), ("Paris", ("Paris", "Unknown", "USA")), ("", ("Unknown", "Unknown", "USA")), ("Bonn, NRW, Germany", ("Bonn", "NRW", "Germany"))],
)
def test_location(spark, text, want):
    assert tuple(one(spark, nz.location(F.col("t")), t=text)) == want


@pytest.mark.parametrize(("text", "want"), [("$80,000 - $90,000", (80000, 90000)), ("120000", (120000, 120000)), ("n/a", (None, None)), ("0", (None, None)), ("competitive", (None, None))])
def test_salary(spark, text, want):
    assert tuple(one(spark, nz.salary_bounds(F.col("t")), t=text)) == want


@pytest.mark.parametrize(("text", "want"), [("1700000000000", dt.date(2023, 11, 14)), ("2024-02-03", dt.date(2024, 2, 3)), ("1901-01-01", None), ("soon", None)])
def test_dates(spark, text, want):
    assert one(spark, nz.date_field(F.col("t")), t=text) == want


def test_terms_and_flags(spark):
    assert one(spark, nz.unique_terms(F.array(F.lit("SQL"), F.lit("sql "), F.lit(" "), F.lit("Go")))) == ["SQL", "Go"]
    assert one(spark, nz.boolean_field(F.lit(" YES "))) is True and one(spark, nz.boolean_field(F.lit(None).cast("string"))) is False
    assert "r" in one(spark, nz.dictionary_skills(F.lit("word")))  # short words match inside others
    assert one(spark, nz.safe_int(F.lit("3.9"))) == 3 and one(spark, nz.safe_float(F.lit("x"), -1.0)) == -1.0
    assert one(spark, nz.sections(job_text=F.lit("a"), other=F.lit(" "))) == "Job text:\na"
    assert one(spark, nz.number_field(F.lit("x"), F.lit("$1,200.9"))) == 1200
    assert one(spark, nz.experience_level(F.lit("Senior director"))) == "senior"  # senior is tried first


def test_skill_borders(spark):
    assert one(spark, tx.skills(F.lit("C++ and C++x, C#, python"))) == ["c++", "python"]  # C++ needs a word character after it


def test_constraint_rules(spark):
    c = tx.constraints(F.col("t"))
    row = spark.createDataFrame([("Hybrid but not remote. AWS certified developer. minimum phd, minimum 5 years of experience",)], "t string").select(*[v.alias(k) for k, v in c.items()]).first()
    assert row["remote_allowed"] is False and row["certifications"] == ["DEVELOPER"] and row["min_degree"] == "doctorate" and row["min_years"] == 5


def test_cjk_tokens(spark):
    assert one(spark, tx.tokens(F.lit("C++ 数据 Eng"))) == ["c++", "数", "据", "eng"]


def test_score_branches(spark):
    assert one(spark, sc.salary_match(F.lit(10), F.lit(None).cast("int"), F.lit(10))) == 1.0
    assert one(spark, sc.visa_match(F.lit(True), F.lit(False))) == 0.0
    assert one(spark, sc.salary_factor(F.lit(100), F.lit(120), F.lit(10))) == 0.8
    assert one(spark, sc.salary_keyword(F.lit(80), F.lit(120), F.lit(100), F.lit(100))) == 0.0
    assert one(spark, sc.company_factor(F.lit("Acme Labs"), F.array(F.lit("acme gmbh")))) == 0.8
    assert one(spark, sc.fuzzy_skills(F.array(F.lit("python 3"), F.lit("go")), F.array(F.lit("python")))) == ["python", None]
    with pytest.raises(ValueError):
        sc.check_weights({"a": 0.5})


def test_ideal_ranking_has_ndcg_one(spark):
    labels = spark.createDataFrame([(1, 1, 3), (1, 2, 2), (1, 3, 0)], "query_id long, doc_id long, grade int")
    ranking = spark.createDataFrame([(1, 1, 1, 3.0), (1, 2, 2, 2.0), (1, 3, 3, 1.0), (2, 1, 1, 1.0)], "query_id long, doc_id long, rank int, score double")
    rows = evaluation.metrics(ranking, labels).collect()
    assert len(rows) == 1 and rows[0]["ndcg_5"] == rows[0]["mrr"] == rows[0]["recall_5"] == 1.0
    assert evaluation.averages(evaluation.metrics(ranking, labels)).first()["queries"] == 1


def test_bm25_ranks_are_gapless(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b a"), (2, "zzz")], "query_id long, text string")
    rows = lexical.top_k(lexical.bm25(docs, asked), 10).orderBy("rank").collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in rows] == [(1, 1, 1), (1, 2, 2)]


def test_dense_hash_vector(spark):
    docs = spark.createDataFrame([(1, "a a b")], "doc_id long, text string")
    v = vectors.dense(vectors.hashed_embedding(docs, vectors.word_terms(F.col("text")), 64), 64).first()["embedding"]
    assert len(v) == 64 and abs(sum(x * x for x in v) - 1) < 1e-5


def test_merge_keeps_first_source(spark):
    s = "query_id long, job_id long, rank int, source string, o int"
    a, b = spark.createDataFrame([(1, 10, 1, "x", 1)], s), spark.createDataFrame([(1, 11, 1, "y", 2), (1, 10, 2, "y", 2)], s)
    assert [tuple(r) for r in merge([a, b], 5).orderBy("position").collect()] == [(1, 10, "x,y", 1), (1, 11, "y", 2)]
    assert source_counts([a, b]).count() == 2


def test_walks_stay_on_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    for r in graph.random_walks(edges, 2, 5).collect():
        assert all({x, y} in ({"a", "b"}, {"b", "c"}) for x, y in zip(r["path"], r["path"][1:]))


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Position Title,Company,Work Model,Is New Grad,Salary,Qualifications\nData Engineer,Acme,Hybrid,yes,\"$80,000 - $90,000\",\"SQL;\nSpark\"\n,Nobody,Remote,no,,\n", encoding="utf-8")
    rows = readers.jobs_from_swe_csv(readers.read_csv(spark, str(tmp_path / "a.csv"))).collect()
    assert len(rows) == 1 and rows[0]["remote_allowed"] and rows[0]["experience_level"] == "entry" and rows[0]["salary"]["high"] == 90000
    (tmp_path / "b.csv").write_bytes("title,company\n工程师,公司\n".encode("gb18030"))
    assert readers.read_csv(spark, str(tmp_path / "b.csv")).first()["title"] == "工程师"
    (tmp_path / "c.json").write_text('{"a": 1}{"a":\n 2}')
    assert sorted(r["a"] for r in readers.read_json_stream(spark, str(tmp_path / "c.json"), "a int").collect()) == [1, 2]
    (tmp_path / "d.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "e.json").write_text('{"a": 1}\n{"a": 2}\n')
    assert readers.read_json(spark, str(tmp_path / "d.json"), "a int").count() == readers.read_json(spark, str(tmp_path / "e.json"), "a int").count() == 2
    flat = spark.createDataFrame([("q", [(None, "j1", 1.0, 1), ("other", "j2", 0.5, 2)], None)], "query_id string, results array<struct<query_id: string, job_id: string, score: double, rank: int>>, candidates array<struct<query_id: string, job_id: string, score: double, rank: int>>")
    assert sorted((r["query_id"], r["job_id"]) for r in readers.flatten_rankings(flat).collect()) == [("other", "j2"), ("q", "j1")]
    assert one(spark, readers.coordinates(F.lit("1.5, 2")))["lat"] == 2.0 and one(spark, readers.coordinates(F.lit("x"))) is None


def test_stream_without_repeats_equals_batch(spark, tmp_path):
    rows = [(i, i % 5, dt.datetime(2024, 1, 1, 0, i % 60)) for i in range(100)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(str(tmp_path / "in" / "events.parquet"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), "events")
    seen = ingest.first_seen(stream, "ts", ["user_id"], "1 day")
    seen.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("user_id").distinct().count() == 5 == spark.read.parquet(str(tmp_path / "out")).count()


def test_feed_mappers(spark, tmp_path):
    from matchweave.sources import mappers

    city = [{"job_id": None, "business_title": "Data Lead", "process_date": "2024", "work_location": "1 Queens Blvd", "full_time_part_time_indicator": "P", "career_level": "Senior Manager", "salary_range_from": "50000.0", "salary_range_to": "x", "salary_frequency": "Hourly", "job_description": "ETL; remote work", "preferred_skills": "a\n b", "residency_requirement": "yes", "posting_date": "2024-01-02T00:00:00.000", "to_apply": "https://x.org"}]
    (tmp_path / "city.json").write_text(json.dumps(city))
    r = mappers.city_jobs(readers.read_json(spark, str(tmp_path / "city.json"), mappers.CITY_SCHEMA)).first()
    assert (r["job_id"], r["location"]["city"], r["job_type"], r["experience_level"]) == ("nyc_data_lead_2024", "Queens", "part_time", "senior")
    assert r["salary"]["min_salary"] == 50000 and r["salary"]["period"] == "hourly" and r["required_skills"] == ["data-engineering"] and r["remote_allowed"] and r["apply_url"] == "https://x.org" and r["benefits"][0]["category"] == "eligibility"
    (tmp_path / "board.json").write_text(json.dumps([{"_id": "1", "title": "T", "owner": {"companyName": "C", "benefits": {"benefits": ["Dental", "", "Life cover"]}}, "locationAddress": "Austin, TX", "skillRequirements": ["b"], "skills_suggest": ["a", "b"], "workModel": "Hybrid", "seniority": "Senior-Level", "url": "u"}]))
    r = mappers.board_jobs(readers.read_json(spark, str(tmp_path / "board.json"), mappers.BOARD_SCHEMA)).first()
    assert r["required_skills"] == ["a", "b"] and [b["category"] for b in r["benefits"]] == ["health", "insurance"] and r["remote_allowed"] and r["experience_level"] == "senior" and r["apply_url"] == "u" and r["salary"] is None
    (tmp_path / "net.json").write_text(json.dumps([{"entityUrn": "urn:li:job:77", "title": "T", "description": "remote python", "location": "Rome", "experienceLevel": "DIRECTOR", "employmentType": "TEMPORARY"}, {"title": " "}]))
    ok, bad = mappers.accepted(mappers.network_jobs(readers.read_json(spark, str(tmp_path / "net.json"), mappers.NETWORK_SCHEMA)))
    r = ok.first()
    assert (r["job_id"], r["job_type"], r["experience_level"], r["remote_allowed"]) == ("77", "contract", "senior", True) and bad.count() == 1


def test_employer_and_label_rows(spark):
    from matchweave.sources import mappers

    schema = "job_id string, job_title string, standard_job string, job_responsibility string, job_requirement string, detailed string, traditional_skills string, new_skills string, skills string, publish_time string"
    rows = spark.createDataFrame([("1", "Dev", "dev", "build", "", None, "SQL;Go", "go; ", "sql", "2024/01/02")], schema)
    titles = spark.createDataFrame([("dev", "IT")], "standard_job_title string, standard_category string")
    r = mappers.employer_jobs(rows, titles).first()
    assert r["job_family"] == "IT" and r["skills"] == ["sql", "Go"] and r["posted"] == dt.date(2024, 1, 2)
    with pytest.raises(ValueError):
        mappers.employer_jobs(rows.union(rows), titles)
    silver = spark.createDataFrame([("r1", "j", "A", ["x", "y"], "t1", "d", "c", "l", 2), ("r2", "j", "B", ["y"], "t2", "d", "c", "l", 1), ("r3", "j", "B", None, "t3", "d", "c", "l", 0)], "resume_id string, job_id string, target_job_family string, matched_skills array<string>, job_title string, job_description string, company_name string, location string, grade int")
    r = mappers.silver_jobs(silver).first()
    assert (r["title"], r["job_family"], r["skills"]) == ("t1", "B", ["y", "x"])
    assert mappers.label_pairs(silver, "silver").where("pair_key = 'r1::j'").count() == 1


def test_resume_profiles(spark):
    from matchweave.operators import resumes

    text = "RESUME\nDr. Ada Lovelace\nada@example.org\n555-123-4567\nSenior Engineer, Acme\nBuilt things in Python and SQL\nmore\nAnalyst\nLondon University\nBSc\nMaths\nwith honours"
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "resume_id string, text string")
    rows = {r["resume_id"]: r for r in resumes.profiles(df).collect()}
    a, b = rows["a"], rows["b"]
    assert (a["name"], a["email"], a["phone"]) == ("Ada Lovelace", "ada@example.org", "555-123-4567")
    assert a["skills"] == ["python", "sql"] and a["leadership"] == ["Senior Engineer, Acme"] and a["has_progression"]
    assert a["education"][0]["degree"] == "BSc" and a["education"][0]["description"] == "with honours"
    assert b["name"] == "Name Not Found" and b["email"] is None and len(b["advice"]) == 5 and len(rows) == 3


def test_queries_from_profiles(spark):
    from matchweave.operators import resumes

    p = spark.createDataFrame([(1, "s", [f"k{i}" for i in range(12)], ["t"] * 5, ["d"] * 4, 6)], "candidate_id long, summary string, skills array<string>, titles array<string>, degrees array<string>, years int")
    r = resumes.as_queries(p).first()
    assert r["level"] == "senior" and r["min_salary"] == 80000 and r["preferred_skills"] == ["k5", "k6", "k7", "k8", "k9"] and r["text"].endswith("t t t d d")
    near = spark.createDataFrame([("Python", "pandas")], "src string, dst string")
    e = resumes.enriched(spark.createDataFrame([(1, "python dev")], "query_id long, text string"), near).first()
    assert e["all_skills"] == ["python", "pandas"]
    s = resumes.external_scores(spark.createDataFrame([(1, 2, '```json\n{"skill": 3, "salary": "x"}\n```'), (1, 3, None)], "query_id long, job_id long, answer string")).orderBy("job_id").collect()
    assert (s[0]["skill"], s[0]["salary"], s[1]["skill"]) == (1.0, 0.5, 0.5)


def test_search_chain(spark):
    from matchweave.operators import packs, search

    jobs = spark.createDataFrame([(1, "Data engineer", "pipes", "sql", "Rome", "IT", 10, [1.0, 0.0]), (2, "Cook", "food", "", "Paris", "FR", 20, [0.0, 1.0])], "job_id long, title string, description string, skills string, city string, state string, min_salary int, embedding array<double>")
    asked = spark.createDataFrame([(7, "data engineer", [1.0, 0.0]), (8, "zzz", [0.0, 1.0])], "query_id long, text string, embedding array<double>")
    assert [r["job_id"] for r in search.structured(jobs, place="IT", low=5, high=15).collect()] == [1]
    text = search.text_search(jobs, asked, 5).withColumnRenamed("doc_id", "job_id")
    assert [(r["query_id"], r["job_id"]) for r in text.collect()] == [(7, 1)]
    near = spark.createDataFrame([(7, 2, 1), (7, 1, 2)], "query_id long, job_id long, rank int")
    page = search.hybrid({"text": text, "graph": near}, asked, jobs, boosted="graph").orderBy("rank").collect()
    assert [(r["job_id"], r["score"], r["sources"]) for r in page] == [(1, 1.5, "graph,text"), (2, 0.0, "graph")]
    both = search.with_fallback(text.select("query_id", "job_id"), spark.createDataFrame([(7, 9), (8, 2)], "query_id long, job_id long"), asked)
    assert {(r["query_id"], r["job_id"]) for r in both.collect()} == {(7, 1), (8, 2)}
    pairs = spark.createDataFrame([(7, 1, "years"), (7, 2, None)], "query_id long, job_id long, r string")
    kept, out = search.split_by_constraints(pairs, F.col("r"))
    assert kept.first()["job_id"] == 2 and search.follow_ups(out).first()["prompts"] == ["How many years have you worked?"]
    assert one(spark, search.path_reason(F.array().cast("array<string>"), F.lit(3), F.lit(1))) == "reached in 3 steps"
    said = one(spark, search.factor_reasons({"skill": F.lit(0.5), "salary": F.lit(1.0)}, F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")), F.lit("x"), F.lit("y")))
    assert said == {"skill": "0.50; shared: a; missing: b", "salary": "1.00"}
    nested = spark.createDataFrame([(["a", "b"], ("c", 1), None)], "l array<string>, s struct<x: string, y: int>, n string")
    assert nested.select(packs.row_text(nested, "l", "s", "n", "gone").alias("t")).first()["t"] == "a b c 1"
    people = spark.createDataFrame([(i,) for i in range(8)], "candidate_id long")
    labels = spark.createDataFrame([(0, 2, "silver"), (1, 1, "gold"), (7, 1, "gold")], "candidate_id long, job_id long, label_source string")
    p, j, lab = packs.sample_pack(people, jobs, labels)
    assert p.count() == 5 and [r["job_id"] for r in j.collect()] == [1, 2] and lab.count() == 2
    assert packs.manifest(people=people).first()["rows"] == 8
    ids = spark.createDataFrame([(1, None, ["x", "x"])], "query_id long, job_ids array<string>, ids array<string>")
    assert packs.candidate_ids(ids).count() == 1
    assert one(spark, packs.query_text(F.lit("IT"), F.array(F.lit("a"), F.lit("A")), F.array(F.lit("r")), F.lit("m"), F.lit(3))) == "IT a r m 3年经验"

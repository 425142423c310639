"""Loaders with fallbacks, counts of bad rows, reports, compact views and vertices."""

import json

from pyspark.sql import functions as F

from matchweave.operators import graph, packs
from matchweave.sources import readers


def test_jobs_under_other_names(spark, tmp_path):
    lines = [
        {"job_id": "a", "title": "工程师", "skills": ["x"], "company": "C", "location": {"city": "Rome", "state": "IT", "country": "Italy"}, "source": "s"},
        {"id": "b", "required_skills": ["y", "z"], "skills": [], "company_name": "D", "location": "Rome"},
        {"job_id": "", "id": 7, "company": "", "location": None},
        {"job_id": "d", "location": {"city": "Oslo"}},
    ]
    (tmp_path / "j.jsonl").write_text("\n".join([*map(json.dumps, lines), "", "   "]))
    got = {r.job_id: r for r in readers.load_jobs(spark, str(tmp_path / "j.jsonl")).collect()}
    assert set(got) == {"a", "b", "7", "d"}
    assert (got["a"].title, got["a"].skills, got["a"].company, got["a"].location.city, got["a"].source) == ("工程师", ["x"], "C", "Rome", "s")
    assert (got["b"].skills, got["b"].company, tuple(got["b"].location), got["b"].source) == (["y", "z"], "D", readers.DEFAULT_PLACE, "jobs.jsonl")
    assert got["7"].company == readers.NO_COMPANY and tuple(got["7"].location) == readers.DEFAULT_PLACE and got["7"].skills == []
    assert tuple(got["d"].location) == ("Oslo", None, None)


def test_malformed_rows_are_counted(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,company\nengineer,acme\n,none\nbad,row,of,four\nshort\n"a\nb",c\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), fields=True)
    assert readers.csv_counts(rows).first().asDict() == {"rows": 5, "malformed": 1, "without_title": 1, "jobs": 3}
    assert {r.title: r.extra_fields for r in rows.collect()} == {"engineer": 0, None: 0, "bad": 2, "short": -1, "a\nb": 0}


def test_reports_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None)], "a long, b string, c string")
    readers.write_report(df, str(tmp_path / "r"))
    (report,) = (tmp_path / "r").glob("part-*.txt")
    assert json.loads(report.read_text(encoding="utf-8")) == {"a": 1, "b": "é"} and "\n" in report.read_text().strip()
    readers.write_jsonl(df, str(tmp_path / "l"))
    assert readers.read_jsonl(spark, str(tmp_path / "l"), "a long, b string").first()["b"] == "é"


def test_resumes_and_merged_sources(spark, tmp_path):
    (tmp_path / "ann.txt").write_text("Ann\nengineer")
    (tmp_path / "bob.txt").write_text("\n")
    (tmp_path / "none.txt").write_text("")
    assert {r.resume_id: r.text for r in readers.read_resumes(spark, str(tmp_path)).collect()} == {"ann": "Ann\nengineer", "bob": "\n"}
    one = spark.createDataFrame([(1, "Data Engineer", "Acme", "x")], "job_id long, title string, company string, place string")
    two = spark.createDataFrame([(2, " data engineer", "ACME "), (3, "Cook", "Acme")], "job_id long, title string, company string")
    assert sorted((r.job_id, r.place) for r in readers.merge_sources(one, two).collect()) == [(1, "x"), (3, None)]


def test_compact_views(spark):
    jobs = spark.createDataFrame([(1, None, "cook", "C", [], ["s"], "d" * 900), (2, "t", "u", None, ["k"], [], None)], "job_id long, title string, standard_job string, company_name string, skills array<string>, required_skills array<string>, description string")
    got = {r.job_id: r for r in packs.compact_job(jobs).collect()}
    assert (got[1].title, got[1].company, got[1].skills, len(got[1].description_preview), got[1].job_family) == ("cook", "C", ["s"], 500, "")
    assert (got[2].title, got[2].company, got[2].skills, got[2].description_preview) == ("t", "", ["k"], "")
    people = spark.createDataFrame([(1, "s" * 1000, None, "f", None)], "candidate_id long, summary string, skills array<string>, target_job_family string, preferred_location string")
    snapshot = packs.candidate_snapshot(people).first()["snapshot"]
    assert len(snapshot.summary) == 800 and snapshot.skills == [] and snapshot.target_job_family == "f" and snapshot.preferred_location == ""


def test_vertices_keep_what_a_write_leaves_out(spark):
    place = "key string, country string, at struct<lon: double, lat: double>"
    known = spark.createDataFrame([("Rome_IT", "Italy", None), ("Oslo_NO", None, (10.7, 59.9))], place)
    new = spark.createDataFrame([("Rome_IT", "12.5,41.9", 1), ("Rome_IT", None, 2), ("Lima_PE", "bad", 1)], "key string, text string, seq int")
    new = new.select("key", readers.coordinates(F.col("text")).alias("at"), "seq")
    got = {r.key: r for r in graph.upsert_vertices(known, new.drop("seq"), "key", F.desc_nulls_last("at.lon")).collect()}
    assert set(got) == {"Rome_IT", "Oslo_NO", "Lima_PE"} and got["Rome_IT"].country == "Italy" and got["Rome_IT"].at.lon == 12.5
    assert got["Oslo_NO"].at.lat == 59.9 and got["Lima_PE"].at is None
    people = spark.createDataFrame([(1, "Ann", "a@x", 3)], "id long, name string, email string, years int")
    again = spark.createDataFrame([(1, None, "b@x", None), (2, "Bob", None, 1)], people.schema)
    assert sorted(map(tuple, graph.upsert_vertices(people, again, "id").collect())) == [(1, "Ann", "b@x", 3), (2, "Bob", None, 1)]

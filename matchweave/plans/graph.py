"""Registered graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import candidates, graph, lexical
from ..sources import graph_tables as g
from ..sources.shared import folder, written
from ..sources.tables import table
from ..streaming import applications, ingest

SQL = g.SQL
REACHED = """
hop1 AS (SELECT DISTINCT query_id, skill AS origin, dst AS skill FROM asked JOIN linked ON skill = src),
reach AS (SELECT query_id, skill FROM hop1 UNION SELECT query_id, l.dst FROM hop1 h JOIN linked l ON h.skill = l.src WHERE l.dst != h.origin)"""


def _top(hits: str) -> str:
    return f"SELECT * FROM (SELECT query_id, job_id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, job_id) AS rank FROM {hits}) WHERE rank <= 20"


def skill_hops1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(graph.one_hop(g.asked(spark, sf_dir), g.requires(spark, sf_dir)), 20, item="job_id", score="hits")


def skill_hops2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(graph.two_hops(g.asked(spark, sf_dir), g.related(spark, sf_dir), g.requires(spark, sf_dir)), 20, item="job_id", score="hits")


def related_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reached(g.asked(spark, sf_dir), g.related(spark, sf_dir))


def skill_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from the skills that each brand asks for to jobs. Jobs of the same skills are as far, so one
    of them is walked to for all."""
    alike = written(candidates.fold(graph.skill_sets(g.requires(spark, sf_dir)), ["skills"]), "alike")
    paths = graph.path_to_skill(g.asked(spark, sf_dir), g.related(spark, sf_dir), alike.select("job_id", F.explode("skills").alias("skill")))
    return paths.join(alike.select("job_id", "copies"), "job_id").groupBy("query_id", "hops").agg(F.sum("copies").alias("jobs"), F.min("job_id").alias("first_job"))


SKILL_PATH = f"""WITH {SQL},
j1 AS (SELECT DISTINCT query_id, job_id FROM asked JOIN requires USING (skill)),
s1 AS (SELECT DISTINCT query_id, dst AS skill FROM asked JOIN linked ON skill = src EXCEPT SELECT * FROM asked),
j2 AS (SELECT DISTINCT query_id, job_id FROM s1 JOIN requires USING (skill) EXCEPT SELECT * FROM j1),
s2 AS (SELECT query_id, skill FROM j1 JOIN requires USING (job_id) UNION SELECT query_id, dst FROM s1 JOIN linked ON skill = src EXCEPT (SELECT * FROM asked UNION SELECT * FROM s1)),
j3 AS (SELECT DISTINCT query_id, job_id FROM s2 JOIN requires USING (skill) EXCEPT (SELECT * FROM j1 UNION SELECT * FROM j2)),
s3 AS (SELECT query_id, skill FROM j2 JOIN requires USING (job_id) UNION SELECT query_id, dst FROM s2 JOIN linked ON skill = src EXCEPT (SELECT * FROM asked UNION SELECT * FROM s1 UNION SELECT * FROM s2)),
j4 AS (SELECT DISTINCT query_id, job_id FROM s3 JOIN requires USING (skill) EXCEPT (SELECT * FROM j1 UNION SELECT * FROM j2 UNION SELECT * FROM j3)),
path AS (SELECT *, 1 AS hops FROM j1 UNION ALL SELECT *, 2 FROM j2 UNION ALL SELECT *, 3 FROM j3 UNION ALL SELECT *, 4 FROM j4)
SELECT query_id, hops, count(*) AS jobs, min(job_id) AS first_job FROM path GROUP BY query_id, hops"""


def location_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops from each brand's city to jobs: one where they lie in it, three over another place."""
    located = g.jobs(spark, sf_dir).select("job_id", F.explode(F.array_distinct(F.array("city", "state"))).alias("place"))
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query_id")).distinct()
    asked = brands.select("query_id", F.concat(F.lit("nation_"), F.regexp_extract("query_id", "[0-9]+", 0)).alias("place"))
    paths = graph.path_to_place(asked, located)
    return paths.groupBy("query_id", "hops").agg(F.count("*").alias("jobs"), F.min("job_id").alias("first_job"))


def graph_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.select(F.col("p_brand").alias("query_id"), F.substring_index("p_name", " ", 1).alias("text")).distinct()
    found = written(graph.text_match(asked, part.select(F.col("p_name").alias("skill")), g.requires(spark, sf_dir), k=10), "found")
    return found.join(g.jobs(spark, sf_dir, only=found), "job_id").select("query_id", "job_id", "matched", "rank", F.array_join("skills", "|").alias("skills"), "company", "city", "state")


TEXT_MATCH = f"""WITH {SQL},
ask AS (SELECT DISTINCT p_brand AS query_id, string_split(p_name, ' ')[1] AS word FROM part),
hit AS (SELECT word, skill FROM (SELECT DISTINCT word FROM ask WHERE length(word) > 3) JOIN names ON contains(lower(skill), lower(word))),
want AS (SELECT DISTINCT query_id, skill FROM ask JOIN hit USING (word)),
sc AS (SELECT query_id, job_id, list_sort(list(DISTINCT skill)) AS s FROM requires JOIN want USING (skill) GROUP BY query_id, job_id)
SELECT t.*, company, city, state FROM (SELECT query_id, job_id, CAST(len(s) AS INTEGER) AS matched, row_number() OVER (PARTITION BY query_id ORDER BY len(s) DESC, job_id) AS rank, array_to_string(s, '|') AS skills FROM sc) t JOIN jobs USING (job_id) WHERE rank <= 10"""


def match_pairs(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(candidate_id, job_id): each candidate's own country's best-paid jobs from the split on."""
    who = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("city"))
    late = g.jobs(spark, sf_dir).where(F.col("posted_date") >= F.lit(g.SPLIT).cast("timestamp_ntz"))
    best = lexical.top_k(late, k, key="city", item="job_id", score="min_salary").select("city", "job_id")
    return who.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(best, "city").select("candidate_id", "job_id")


PAIRS = f"""
late AS (SELECT city, job_id, row_number() OVER (PARTITION BY city ORDER BY min_salary DESC, job_id) AS r FROM jobs WHERE posted_date >= TIMESTAMP '{g.SPLIT}'),
pairs AS (SELECT c_custkey AS candidate_id, job_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN late ON city = n_name WHERE r <= 20)"""


def pair_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = graph.pair_match(match_pairs(spark, sf_dir), g.requires(spark, sf_dir), g.has(spark, sf_dir))
    return out.select("candidate_id", "job_id", "job_skills", "candidate_skills", "matched", "ratio")


PAIR_MATCH = f"""WITH {SQL}, {PAIRS},
js AS (SELECT job_id, count(*) AS job_skills FROM requires GROUP BY job_id), cs AS (SELECT candidate_id, count(*) AS candidate_skills FROM has GROUP BY candidate_id),
co AS (SELECT candidate_id, job_id, count(*) AS matched FROM pairs JOIN requires USING (job_id) JOIN has USING (candidate_id, skill) GROUP BY ALL)
SELECT candidate_id, job_id, job_skills, candidate_skills, coalesce(matched, 0) AS matched, round(coalesce(matched, 0) / job_skills, 6) AS ratio FROM pairs JOIN js USING (job_id) JOIN cs USING (candidate_id) LEFT JOIN co USING (candidate_id, job_id)"""


def skill_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = match_pairs(spark, sf_dir).withColumns({"family": F.col("candidate_id") % 3, "job_family": F.col("job_id") % 3})
    out = graph.skill_gap(families, g.requires(spark, sf_dir), g.has(spark, sf_dir))
    return out.select("candidate_id", "job_id", "family_match", F.array_join("evidence", "; ").alias("evidence"), F.array_join("matched", "|").alias("matched"), F.array_join("missing", "|").alias("missing"), "coverage", "jaccard")


SKILL_GAP = f"""WITH {SQL}, {PAIRS},
need AS (SELECT job_id, list_sort(list(skill)) AS need FROM requires GROUP BY job_id), own AS (SELECT candidate_id, list_sort(list(skill)) AS own FROM has GROUP BY candidate_id),
b AS (SELECT candidate_id, job_id, coalesce(need, []) AS need, coalesce(own, []) AS own FROM pairs LEFT JOIN need USING (job_id) LEFT JOIN own USING (candidate_id)),
m AS (SELECT *, list_filter(need, lambda x: list_contains(own, x)) AS hit, list_filter(need, lambda x: NOT list_contains(own, x)) AS miss FROM b)
SELECT candidate_id, job_id, CASE WHEN len(need) > 0 AND candidate_id % 3 = job_id % 3 THEN 1 ELSE 0 END AS family_match, array_to_string(list_transform(hit, lambda s: 'candidate ' || candidate_id || ' -HAS_SKILL-> ' || s || ' <-REQUIRES_SKILL- job ' || job_id), '; ') AS evidence, array_to_string(hit, '|') AS matched, array_to_string(miss, '|') AS missing, CASE WHEN len(need) > 0 THEN round_even(len(hit) / len(need), 2) ELSE 0.0 END AS coverage,
CASE WHEN len(need) > 0 THEN round_even(len(hit) / (len(need) + len(own) - len(hit)), 4) ELSE 0.0 END AS jaccard FROM m"""


def skill_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.demand(g.requires(spark, sf_dir))


def skill_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.symmetric(g.related(spark, sf_dir)).select(F.col("src").alias("skill"), F.col("dst").alias("other"))


def market_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.market_trends(g.requires(spark, sf_dir), g.has(spark, sf_dir), g.related(spark, sf_dir))


MARKET = f"""WITH {SQL},
inc AS (SELECT skill, count(*) AS demand FROM (SELECT skill FROM requires UNION ALL SELECT skill FROM has UNION ALL SELECT src FROM linked) GROUP BY skill),
rel AS (SELECT src AS skill, count(*) AS related FROM (SELECT src, dst FROM linked UNION SELECT a.src, b.dst FROM linked a JOIN linked b ON a.dst = b.src WHERE b.dst != a.src) GROUP BY src)
SELECT skill, demand, coalesce(related, 0) AS related FROM inc LEFT JOIN rel USING (skill)"""


def applications_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user about each job, newest first per user."""
    e = table(spark, sf_dir, "events").select(F.col("user_id"), F.get_json_object("props", "$.k").cast("long").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("applied_at"), "event_id")
    last = graph.keep_latest(e, ["user_id", "job_id"], F.desc("applied_at"), F.desc("event_id"))
    return lexical.top_k(last, 10**9, key="user_id", item="event_id", score="applied_at").select("user_id", "job_id", "status", "event_id", "rank")


APPLICATIONS = """WITH l AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS job_id, event_type AS status, ts, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, json_extract(props, '$.k') ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, job_id, status, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rank FROM l"""


def applications_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream that keeps state, with the job's title and company."""
    path = folder(spark, "applications")
    e = ingest.read_stream(spark, sf_dir, "events", files=16)
    applications.drain(e.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("job_id"), F.col("ts").alias("applied_at"), "event_id", F.col("event_type").alias("status")), f"{path}/store", f"{path}/state")
    titled = g.jobs(spark, sf_dir).select("job_id", F.concat_ws(" ", "company", "level").alias("title"), "company")
    return applications.listed(applications.current(spark, f"{path}/store"), titled).select("user_id", "job_id", "status", "event_id", "title", "company")


APPLICATIONS_STREAM = f"""WITH {SQL}, l AS (SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS job_id, event_type AS status, ts, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, json_extract(props, '$.k') ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, l.job_id, status, event_id, company || ' ' || level AS title, company FROM l LEFT JOIN jobs ON jobs.job_id = l.job_id"""


def replace_user_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' skills of all events, replaced by those of their purchases where they have any."""
    e = table(spark, sf_dir, "events").select("user_id", F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("skill"), "event_type")
    return graph.replace_edges(e.select("user_id", "skill").distinct(), e.where("event_type = 'purchase'").select("user_id", "skill").distinct(), "user_id")


REPLACE = """WITH e AS (SELECT DISTINCT user_id, 'k' || CAST(json_extract(props, '$.k') AS VARCHAR) AS skill, event_type FROM events),
n AS (SELECT DISTINCT user_id, skill FROM e WHERE event_type = 'purchase')
SELECT DISTINCT user_id, skill FROM e WHERE user_id NOT IN (SELECT user_id FROM n) UNION ALL SELECT user_id, skill FROM n"""


def job_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of every job by kind: how many, and how many different ends."""
    need = g.requires(spark, sf_dir).groupBy("job_id").agg(F.collect_set("skill").alias("required_skills"))
    none = F.array().cast("array<string>")
    offers = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job_id")).agg(F.collect_set("l_returnflag").alias("benefits"))
    job = g.jobs(spark, sf_dir).join(need, "job_id", "left").join(offers, "job_id", "left")
    job = job.withColumns({"required_skills": F.coalesce("required_skills", none), "preferred_skills": none, "benefits": F.coalesce("benefits", none)})
    return graph.job_edges(job).groupBy("type").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("jobs"), F.countDistinct("dst").alias("ends"))


JOB_GRAPH = f"""WITH {SQL}, e AS (SELECT job_id, skill AS dst, 'REQUIRES_SKILL' AS type FROM requires JOIN jobs USING (job_id) UNION ALL SELECT job_id, company, 'OFFERED_BY' FROM jobs UNION ALL SELECT job_id, city || '_' || state, 'LOCATED_IN' FROM jobs UNION ALL SELECT DISTINCT l_orderkey, l_returnflag, 'OFFERS_BENEFIT' FROM lineitem JOIN jobs ON l_orderkey = job_id)
SELECT type, count(*) AS edges, count(DISTINCT job_id) AS jobs, count(DISTINCT dst) AS ends FROM e GROUP BY type"""


def edge_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate-skill and job-skill edges as one list, counted per skill and kind."""
    both = g.has(spark, sf_dir).select(F.lit("HAS_SKILL").alias("type"), "skill").unionAll(g.requires(spark, sf_dir).select(F.lit("REQUIRES_SKILL").alias("type"), "skill"))
    return both.groupBy("type", "skill").agg(F.count("*").alias("edges"))


def key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items that share (order, line number): a key that is not one."""
    return graph.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("count").alias("n"))


def graph_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How near candidates and their country's jobs are by vectors of four walks of 30 steps from
    every job, candidate and skill."""
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    has = g.has(spark, sf_dir).select(key("candidate", "candidate_id").alias("src"), key("skill", "skill").alias("dst"))
    need = g.requires(spark, sf_dir).select(key("job", "job_id").alias("src"), key("skill", "skill").alias("dst"))
    pairs = written(match_pairs(spark, sf_dir).select(key("candidate", "candidate_id").alias("a"), key("job", "job_id").alias("b")), "pairs")
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b"))
    return graph.relatedness(pairs, graph.graph_embedding(written(has.union(need), "edges"), walks=4, only=ends))


QUERIES = {
    "skill_hops1": (skill_hops1, f"WITH {SQL}, h AS (SELECT query_id, job_id, count(DISTINCT skill) AS hits FROM requires JOIN asked USING (skill) GROUP BY ALL) {_top('h')}"),
    "skill_hops2": (skill_hops2, f"WITH {SQL}, {REACHED}, h AS (SELECT query_id, job_id, count(DISTINCT skill) AS hits FROM requires JOIN reach USING (skill) GROUP BY ALL) {_top('h')}"),
    "related_skills": (related_skills, f"WITH {SQL}, {REACHED} SELECT query_id, skill FROM reach"),
    "skill_path": (skill_path, SKILL_PATH),
    "location_path": (location_path, f"WITH {SQL}, p AS (SELECT job_id, lower(city) AS place FROM jobs UNION SELECT job_id, lower(state) FROM jobs), b AS (SELECT DISTINCT p_brand AS query_id, 'nation_' || regexp_extract(p_brand, '[0-9]+') AS place FROM part), h1 AS (SELECT DISTINCT query_id, job_id FROM b JOIN p USING (place)), n3 AS (SELECT DISTINCT query_id, p.place FROM h1 JOIN p USING (job_id) ANTI JOIN b ON b.query_id = h1.query_id AND b.place = p.place), h AS (SELECT query_id, job_id, 1 AS hops FROM h1 UNION ALL SELECT DISTINCT query_id, job_id, 3 FROM n3 JOIN p USING (place)), m AS (SELECT query_id, job_id, min(hops) AS hops FROM h GROUP BY ALL) SELECT query_id, hops, count(*) AS jobs, min(job_id) AS first_job FROM m GROUP BY ALL"),
    "graph_text_match": (graph_text_match, TEXT_MATCH),
    "pair_match": (pair_match, PAIR_MATCH),
    "skill_gap": (skill_gap, SKILL_GAP),
    "skill_demand": (skill_demand, f"WITH {SQL} SELECT skill, count(DISTINCT job_id) AS jobs FROM requires GROUP BY skill"),
    "skill_relations": (skill_relations, f"WITH {SQL} SELECT src AS skill, dst AS other FROM linked"),
    "market_trends": (market_trends, MARKET),
    "applications_latest": (applications_latest, APPLICATIONS),
    "applications_stream": (applications_stream, APPLICATIONS_STREAM),
    "replace_user_skills": (replace_user_skills, REPLACE),
    "job_graph": (job_graph, JOB_GRAPH),
    "edge_export": (edge_export, f"WITH {SQL} SELECT type, skill, count(*) AS edges FROM (SELECT 'HAS_SKILL' AS type, skill FROM has UNION ALL SELECT 'REQUIRES_SKILL', skill FROM requires) GROUP BY ALL"),
    "key_check": (key_check, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1"),
    "graph_embedding": (graph_embedding, None),
}

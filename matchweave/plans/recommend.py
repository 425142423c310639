"""From profile to page: one search of all steps, reranked jobs with reasons; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as sc
from ..functions import text as tx
from ..operators import candidates, lexical, resumes, search
from ..sources import graph_tables as g
from ..sources.shared import written
from ..sources.tables import table
from .chains import LEVELS, RETRIEVED, _vector_sql, features, retrieved
from .graph import SQL
from .matching import FACTORS, LEVEL_SQL, _factors, frame


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of each nation: the seven skills that most of its customers have, and what its key says."""
    nation, who = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), "c_nationkey")
    counts = g.has(spark, sf_dir).join(who, "candidate_id").groupBy("c_nationkey", "skill").agg(F.count("*").alias("n"))
    first = F.row_number().over(W.partitionBy("c_nationkey").orderBy(F.desc("n"), "skill"))
    own = counts.withColumn("r", first).where("r <= 7").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list("skill")).alias("skills"))
    k, none = F.col("n_nationkey"), F.array().cast("array<string>")
    degree = F.element_at(F.array(*[F.lit(d) for d in (-1, 4, 2, 3, 1)]), (k % 5 + 1).cast("int"))
    return nation.join(own, "n_nationkey").select(
        k.cast("long").alias("candidate_id"), F.lit("").alias("summary"), "skills", none.alias("titles"), none.alias("degrees"), (k % 8).alias("years"), degree.alias("degree"),
        (k % 4 == 1).alias("needs_visa"), F.when(k % 2 == 1, F.array(F.lit("german"))).otherwise(none).alias("languages"), none.alias("certifications"), F.col("n_name").alias("place"),
    )


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with a posting's sentences about who may apply."""
    need = g.requires(spark, sf_dir).groupBy("job_id").agg(F.array_sort(F.collect_set("skill")).alias("skills"))
    j = g.jobs(spark, sf_dir).join(need, "job_id")
    said = F.concat_ws(
        " ", "city", "state", "company",
        F.when(F.col("job_type") == "F", "Must be authorized to work in the US. No visa sponsorship."), F.when(F.col("company") == "BUILDING", "Required bachelor.").otherwise("Required associate."),
        F.when(F.col("level") == "5-LOW", "At least 4 years of experience."), F.when(F.col("company") == "MACHINERY", "Fluent in german."),
    )
    level = F.when(F.col("level") == "1-URGENT", "executive").when(F.col("level") == "2-HIGH", "senior").when(F.col("level") == "3-MEDIUM", "mid").otherwise("entry")
    return j.select("job_id", F.concat_ws(" ", "company", "level").alias("title"), said.alias("description"), "skills", F.array_join("skills", " ").alias("text"), "city", "state", "company", "min_salary", "max_salary", level.alias("seniority"))


def profile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations of each profile: a search made of it, with related skills, over three retrievers;
    features of what they found; jobs that its constraints rule out taken away; the rest by the
    weighted parts, 20 each; a plain text search for profiles left without any; then all scored by
    fit, ten each, with why."""
    profiles, jobs = written(_profiles(spark, sf_dir)), written(_jobs(spark, sf_dir))
    near, need = written(g.related(spark, sf_dir)), written(g.requires(spark, sf_dir))
    both = near.union(near.select("dst", "src"))
    asked = resumes.enriched(resumes.as_queries(profiles), both, stated="required_skills")
    own = profiles.select(F.col("candidate_id").alias("query_id"), F.col("skills").alias("own"), "years", "degree", "needs_visa", "languages", "certifications", "place")
    asked = written(asked.join(own, "query_id").withColumn("company", F.lit("")))
    merged, index = retrieved(asked, jobs, asked.select("query_id", F.explode("own").alias("skill")), near, need)

    every = asked.select("query_id", F.explode(F.array_union("own", "related")).alias("skill"))
    found = features(asked.select("query_id", "text", F.col("all_skills").alias("skills"), "place", "company"), jobs, merged, index, every, near, need)
    rules = jobs.join(merged.select("job_id").distinct(), "job_id", "left_semi")
    rules = rules.select("job_id", *[v.alias(k) for k, v in tx.constraints(F.col("description")).items()])
    who = {c: F.col(f"w_{c}") for c in ("needs_visa", "certifications", "degree", "years", "languages")}
    judged = merged.select("query_id", "job_id").join(asked.select("query_id", *[F.col(c).alias(f"w_{c}") for c in who]), "query_id").join(rules, "job_id")
    kept, out = search.split_by_constraints(judged, sc.constraint_reason({c: F.col(c) for c in rules.columns}, who))
    kept, out = written(kept.select("query_id", "job_id", F.col("no_sponsorship"))), written(out.select("query_id", "job_id", "reason"))

    profile = asked.select("query_id", "own", "years", "needs_visa", "place", F.col("min_salary").alias("wanted"))
    posting = jobs.select("job_id", F.col("skills").alias("need"), "city", "state", "company", F.col("min_salary").alias("low"), F.col("max_salary").alias("high"), "seniority")

    def parts(similar) -> dict:
        return {
            "skill": sc.skill_share(F.col("need"), F.col("own")), "semantic": similar, "location": sc.location_match(F.col("city"), F.col("state"), F.col("place")),
            "salary": sc.salary_match(F.col("low"), F.col("high"), F.col("wanted")), "visa": sc.visa_match(F.col("needs_visa"), ~F.coalesce(F.col("no_sponsorship"), F.lit(False))),
            "experience": sc.experience_match(F.col("seniority"), F.col("years")),
        }

    ready = kept.join(found.select("query_id", "job_id", "sem_skills", "hop1", "hop2", "skill_path"), ["query_id", "job_id"]).join(profile, "query_id").join(posting, "job_id")
    best = lexical.page(ready.withColumn("score", F.round(sc.weighted(parts(F.col("sem_skills")), sc.MATCH_WEIGHTS), 6)), 1, 20, item="job_id")
    shape = ("query_id", "job_id", "from", "total", "skill_path", "hop2")
    searched = best.select("query_id", "job_id", F.lit("search").alias("from"), "total", "skill_path", "hop2")
    searched = written(searched.select(*shape))
    # only profiles without any are searched for again
    texts, counts, weights = index
    scored = lexical.scores(counts, weights.join(searched.select("query_id").distinct(), "query_id", "left_anti")).withColumnRenamed("doc_id", "job_id").join(texts, "job_id")
    total = scored.groupBy("query_id").agg(F.sum("copies").alias("total"))
    plain = candidates.unfold(written(lexical.top_k(scored, 20, item="job_id"), "best"), jobs.select("job_id", "text"), ["text"], 20).join(total, "query_id").select("query_id", "job_id", F.lit("text").alias("from"), "total", F.lit(0).alias("skill_path"), F.lit(0).cast("long").alias("hop2"))
    both_ = search.with_fallback(searched, plain.select(*shape), asked)

    # what a posting says of sponsorship counts for jobs of the plain search as well
    sponsor = jobs.select("job_id", tx.constraints(F.col("description"))["no_sponsorship"].alias("no_sponsorship"))
    f = both_.join(profile, "query_id").join(posting, "job_id").join(sponsor, "job_id").withColumn("found", sc.fuzzy_skills(F.col("need"), F.col("own")))
    fit = parts(F.lit(0.0)) | {"skill": F.when(F.size("need") > 0, F.size(F.filter("found", lambda x: x.isNotNull())) / F.size("need")).otherwise(0.0)}
    missing = F.filter(F.zip_with("need", "found", lambda n, x: F.when(x.isNull(), n)), lambda x: x.isNotNull())
    shared = F.array_sort(F.array_intersect("need", "own"))
    why = search.path_reason(shared, F.col("skill_path"), F.col("hop2"))
    ranked = lexical.top_k(f.withColumn("score", F.round(sc.weighted(fit, sc.FIT_WEIGHTS), 6)), 10, item="job_id")
    asks = search.follow_ups(out).select("query_id", F.array_join("prompts", "|").alias("prompts"))
    refused = out.groupBy("query_id").agg(F.count("*").alias("refused"))
    return ranked.join(refused, "query_id", "left").join(asks, "query_id", "left").select(
        "query_id", "job_id", "rank", "score", sc.fit(F.col("score")).alias("fit"), "from", "total", F.array_join(missing, "|").alias("missing"), why.alias("reason"), F.coalesce("refused", F.lit(0)).alias("refused"), "prompts",
    )


_ASKED = SQL[SQL.index("asked AS (") :]
_PROFILES = """cn AS (SELECT c_nationkey, skill, count(*) AS n FROM has JOIN customer ON c_custkey = candidate_id GROUP BY ALL),
asked AS (SELECT query_id, skill FROM (SELECT CAST(c_nationkey AS BIGINT) AS query_id, skill, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, skill) AS r FROM cn) WHERE r <= 7)"""
_PAID = "CASE WHEN years >= 5 THEN 80000 WHEN years >= 2 THEN 60000 ELSE 40000 END"
PROFILE_SEARCH = f"""WITH {RETRIEVED.replace(_ASKED, _PROFILES)},
sq AS (SELECT query_id, text || ' ' || n_name AS text FROM qx JOIN nation ON n_nationkey = query_id), {_vector_sql("sv", "sq", "query_id")},
ow AS (SELECT query_id, list_sort(list(skill)) AS own FROM asked GROUP BY query_id),
af AS (SELECT query_id, skill, row_number() OVER (PARTITION BY query_id ORDER BY skill) AS r FROM asked),
ev AS (SELECT query_id, skill FROM asked UNION SELECT query_id, dst FROM af JOIN linked ON skill = src WHERE r <= 5),
{LEVELS.replace("asked", "ev")}
hx AS (SELECT DISTINCT query_id, skill AS origin, dst AS skill FROM ev JOIN linked ON skill = src), rx AS (SELECT query_id, skill FROM hx UNION SELECT query_id, l.dst FROM hx h JOIN linked l ON h.skill = l.src WHERE l.dst != h.origin),
h3 AS (SELECT query_id, job_id, count(DISTINCT skill) AS hop2 FROM requires JOIN rx USING (skill) GROUP BY ALL),
pr AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, n_name AS place, n_nationkey % 8 AS years, [-1, 4, 2, 3, 1][n_nationkey % 5 + 1] AS degree, n_nationkey % 4 = 1 AS needs_visa, n_nationkey % 2 = 1 AS german FROM nation),
nd AS (SELECT job_id, list_sort(list(skill)) AS need FROM requires GROUP BY job_id),
jx AS (SELECT *, {LEVEL_SQL} AS seniority, job_type = 'F' AS closed FROM jobs JOIN nd USING (job_id)),
jd AS (SELECT query_id, job_id, closed, CASE WHEN closed AND needs_visa THEN 'work authorisation' WHEN (CASE WHEN company = 'BUILDING' THEN 2 ELSE 1 END) > degree THEN 'degree' WHEN level = '5-LOW' AND 4 > years THEN 'years' WHEN company = 'MACHINERY' AND NOT german THEN 'language' END AS why
  FROM merged JOIN pr USING (query_id) JOIN jx USING (job_id)),
rd AS (SELECT k.query_id, k.job_id, coalesce(skill_path, 0) AS skill_path, coalesce(hop2, 0) AS hop2, coalesce(CAST(sm.s AS DOUBLE), 0.0) AS sem FROM jd k LEFT JOIN sp USING (query_id, job_id) LEFT JOIN h3 USING (query_id, job_id)
  LEFT JOIN (SELECT m.query_id, m.job_id, CAST(sum(x.w * sv.w) AS BIGINT) // 1000000 / 1000000 AS s FROM merged m JOIN jv x ON x.doc_id = m.job_id JOIN sv USING (query_id, b) GROUP BY ALL) sm USING (query_id, job_id) WHERE why IS NULL),
bs AS (SELECT query_id, job_id, need, own, CASE WHEN len(need) > 0 THEN len(list_filter(need, lambda x: list_contains(own, x))) / len(need) ELSE 0.5 END AS skill,
  CASE WHEN contains(lower(city || ', ' || state), lower(place)) THEN 1.0 ELSE 0.3 END AS loc, CASE WHEN {_PAID} BETWEEN min_salary AND max_salary THEN 1.0 WHEN {_PAID} < min_salary THEN 0.3 ELSE 0.7 END AS sal,
  CASE WHEN NOT needs_visa THEN 0.8 WHEN NOT closed THEN 1.0 ELSE 0.0 END AS visa,
  CASE WHEN years >= (CASE seniority WHEN 'entry' THEN 0 WHEN 'senior' THEN 5 ELSE 2 END) THEN 1.0 WHEN years > 0 THEN years / greatest(CASE seniority WHEN 'entry' THEN 0 WHEN 'senior' THEN 5 ELSE 2 END, 1) ELSE 0.0 END AS exper
  FROM (SELECT query_id, job_id FROM rd UNION SELECT query_id, doc_id FROM ranked WHERE rank <= 20) JOIN pr USING (query_id) JOIN ow USING (query_id) JOIN jx USING (job_id)),
p9 AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, job_id) AS r FROM (SELECT query_id, job_id, skill_path, hop2, round(0.35 * skill + 0.3 * sem + 0.15 * loc + 0.12 * sal + 0.08 * visa, 6) AS score FROM rd JOIN bs USING (query_id, job_id))),
tx AS (SELECT query_id, doc_id AS job_id, total, rank FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM ranked) WHERE rank <= 20),
al AS (SELECT query_id, job_id, 'search' AS "from", total, skill_path, hop2 FROM p9 WHERE r <= 20 UNION ALL SELECT query_id, job_id, 'text', total, 0, 0 FROM tx ANTI JOIN p9 USING (query_id)),
fx AS (SELECT *, list_filter(need, lambda j: len(list_filter(own, lambda o: contains(j, o) OR contains(o, j) OR len(list_filter(string_split(o, ' '), lambda w: contains(j, w))) > 0)) > 0) AS got, list_sort(list_filter(need, lambda x: list_contains(own, x))) AS common FROM al JOIN bs USING (query_id, job_id)),
fs AS (SELECT *, round(0.4 * (CASE WHEN len(need) > 0 THEN len(got) / len(need) ELSE 0.0 END) + 0.3 * exper + 0.15 * loc + 0.1 * sal + 0.05 * visa, 6) AS score FROM fx),
rf AS (SELECT query_id, count(*) AS refused, array_to_string(list_sort(list(DISTINCT CASE why WHEN 'work authorisation' THEN 'Do you have work authorisation?' WHEN 'degree' THEN 'What is your highest degree?' WHEN 'years' THEN 'How many years have you worked?' ELSE 'Which languages do you speak?' END)), '|') AS prompts FROM jd WHERE why IS NOT NULL GROUP BY query_id)
SELECT query_id, job_id, rank, score, CASE WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair' ELSE 'poor' END AS fit, "from", total, array_to_string(list_filter(need, lambda j: NOT list_contains(got, j)), '|') AS missing,
CASE WHEN len(common) > 0 THEN 'requires ' || common[1] WHEN skill_path > 0 THEN 'reached in ' || skill_path || ' steps' WHEN hop2 > 0 THEN hop2 || ' related skills' END AS reason, coalesce(refused, 0) AS refused, prompts
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, job_id) AS rank FROM fs) LEFT JOIN rf USING (query_id) WHERE rank <= 10"""

def reranked_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate's five best jobs by six factors, a sentence for each factor, and what all of the
    candidate's jobs score."""
    parts, c = _factors(), F.col
    every = search.reranked(frame(spark, sf_dir).withColumnRenamed("candidate_id", "query_id").withColumn("candidate_id", c("query_id")), parts)
    stats = every.groupBy("query_id").agg(F.count("*").alias("jobs"), F.round(F.avg("score"), 8).alias("mean"), F.max("score").alias("best"))
    said = search.factor_reasons(
        {n: c(f"f_{n}") for n in parts}, c("need"), c("own"), F.concat_ws(", ", "city", "state"), c("company"),
        experience=F.concat(c("level"), F.lit(" job, "), c("years"), F.lit(" years")), salary=F.concat(F.lit("pays "), F.floor("min_salary"), F.lit(" to "), F.floor("max_salary")),
    )
    reasons = F.array_join(F.array(*[F.concat(F.lit(f"{n}: "), said[n]) for n in parts]), " | ")
    return every.where("rank <= 5").join(stats, "query_id").select(c("query_id").alias("candidate_id"), "job_id", "rank", "score", reasons.alias("reasons"), "jobs", "mean", "best")


_SOME = "CASE WHEN len({x}) > 0 THEN array_to_string({x}[1:3], ', ') ELSE 'none' END"
RERANKED = f"""WITH {FACTORS}, r AS (SELECT *, round(0.35 * f_skill + 0.25 * f_exp + 0.15 * f_loc + 0.1 * f_sal + 0.1 * semantic + 0.05 * f_com, 6) AS score, list_sort(list_filter(need, lambda x: NOT list_contains(own, x))) AS miss, list_sort(hits) AS got FROM fac),
k AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY score DESC, job_id) AS rank, count(*) OVER w AS jobs, round(avg(score) OVER w, 8) AS mean, max(score) OVER w AS best FROM r WINDOW w AS (PARTITION BY candidate_id))
SELECT candidate_id, job_id, rank, score, 'skill: ' || printf('%.2f', f_skill) || '; shared: ' || {_SOME.format(x="got")} || '; missing: ' || {_SOME.format(x="miss")} || ' | experience: ' || printf('%.2f', f_exp) || '; ' || level || ' job, ' || years || ' years | location: ' || printf('%.2f', f_loc) || '; job in ' || city || ', ' || state
|| ' | salary: ' || printf('%.2f', f_sal) || '; pays ' || CAST(floor(min_salary) AS BIGINT) || ' to ' || CAST(floor(max_salary) AS BIGINT) || ' | semantic: ' || printf('%.2f', semantic) || ' | company: ' || printf('%.2f', f_com) || '; at ' || company AS reasons, jobs, mean, best FROM k WHERE rank <= 5"""

QUERIES = {"profile_search": (profile_search, PROFILE_SEARCH), "reranked_reasons": (reranked_reasons, RERANKED)}

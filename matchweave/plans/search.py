"""Registered search chains, resumes and packs, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import graph, packs, resumes, search
from ..sources import graph_tables as g
from ..sources.shared import bounded, written
from ..sources.tables import table
from .graph import SQL
from .text import _SKILL_SQL, WHOLE, _cascade_sql, whole

_HOPS = """
hop1x AS (SELECT DISTINCT query_id, skill AS origin, dst AS skill FROM asked JOIN linked ON skill = src),
reach AS (SELECT query_id, skill FROM hop1x UNION SELECT query_id, l.dst FROM hop1x h JOIN linked l ON h.skill = l.src WHERE l.dst != h.origin),
h1 AS (SELECT query_id, job_id, count(DISTINCT skill) AS hits FROM requires JOIN asked USING (skill) GROUP BY ALL), h2 AS (SELECT query_id, job_id, count(DISTINCT skill) AS hits FROM requires JOIN reach USING (skill) GROUP BY ALL),
u AS (SELECT query_id, job_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, job_id) AS rank, 'direct' AS source, 0 AS o FROM h1 UNION ALL SELECT query_id, job_id, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, job_id), 'related', 1 FROM h2),
m AS (SELECT query_id, job_id, min(o * 1000000 + rank) AS first, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM u WHERE rank <= CASE source WHEN 'direct' THEN 200 ELSE 100 END GROUP BY query_id, job_id),
merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, job_id) AS position FROM m) WHERE position <= 400)"""


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 1 of jobs found directly and by related skills, reranked by how well all the skills
    fit, with more weight for those that the graph found."""
    asked, need, near = written(g.asked(spark, sf_dir), "asked"), written(g.requires(spark, sf_dir), "requires"), g.related(spark, sf_dir)
    lists = {
        "direct": graph.best_by_skills(asked, need, 200, any_case=True),
        "related": graph.best_by_skills(graph.reached(asked, near), need, 100),
    }
    merged = written(search.retrieve(lists), "merged")
    # what else is asked of jobs is worked out for those found
    need = need.join(bounded(written(merged.select("job_id").distinct(), "found")), "job_id", "left_semi")
    sizes = asked.groupBy("query_id").agg(F.count("*").alias("a")), need.groupBy("job_id").agg(F.count("*").alias("n"))
    both = graph.one_hop(asked, need)
    pairs = merged.join(both, ["query_id", "job_id"], "left").join(sizes[0], "query_id").join(sizes[1], "job_id")
    boost = F.when(F.array_contains(F.split("sources", ","), "related"), 1.5).otherwise(1.0)
    score = F.coalesce("hits", F.lit(0)) / F.sqrt((F.col("a") * F.col("n")).cast("double")) * boost
    best = search.ranked(pairs.select("query_id", "job_id", "sources", F.round(score, 6).alias("score")))
    return best.where("rank <= 10")


HYBRID = f"""WITH {SQL}, {_HOPS},
a AS (SELECT query_id, count(*) AS a FROM asked GROUP BY query_id), n AS (SELECT job_id, count(*) AS n FROM requires GROUP BY job_id),
s AS (SELECT query_id, job_id, sources, round(coalesce(hits, 0) / sqrt(CAST(a * n AS DOUBLE)) * CASE WHEN contains(sources, 'related') THEN 1.5 ELSE 1.0 END, 6) AS score FROM merged LEFT JOIN h1 USING (query_id, job_id) JOIN a USING (query_id) JOIN n USING (job_id))
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, job_id) AS rank FROM s) WHERE rank <= 10"""


def _job_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, skill, required, done): parts of an order, preferred where all of them came back; done if all are finished."""
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("skill"))
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("l_orderkey").alias("job_id"), "skill").agg(F.max(F.col("l_returnflag") != "R").alias("required"), F.min(F.col("l_linestatus") == "F").alias("done"))


def static_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all jobs, refreshed after those of the skills that were done before."""
    skills, related = written(_job_skills(spark, sf_dir)), written(g.related(spark, sf_dir))
    known = written(search.refreshed_features(None, skills.where("done").drop("done"), related))
    return search.refreshed_features(known, skills.drop("done"), related).drop("content")


STATIC = f"""WITH {SQL}, k AS (SELECT l_orderkey AS job_id, p_name AS skill, bool_or(l_returnflag != 'R') AS need FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
c AS (SELECT job_id, count(*) FILTER (need) AS required, count(*) FILTER (NOT need) AS preferred FROM k GROUP BY job_id),
n AS (SELECT job_id, count(DISTINCT dst) AS near FROM k JOIN linked ON skill = src WHERE need GROUP BY job_id),
r2 AS (SELECT src, dst FROM linked UNION SELECT a.src, b.dst FROM linked a JOIN linked b ON a.dst = b.src WHERE b.dst != a.src),
n2 AS (SELECT job_id, count(DISTINCT dst) AS near2 FROM k JOIN r2 ON skill = src WHERE need GROUP BY job_id)
SELECT job_id, required, preferred, coalesce(near, 0) AS near, coalesce(near2, 0) AS near2 FROM c LEFT JOIN n USING (job_id) LEFT JOIN n2 USING (job_id)"""


def resume_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experience entries of the documents and their sentences: title lines and how long their text is."""
    texts = whole(spark, sf_dir).select(F.col("doc_id").alias("resume_id"), F.regexp_replace("t", r"[.,] ", "\n").alias("text"))
    return resumes.experience(resumes.lines(texts)).select("resume_id", "entry", "title", F.coalesce(F.length("description"), F.lit(0)).alias("chars"))


_ROLE = " OR ".join(f"contains(lower(x), '{w}')" for w in resumes.ROLE_WORDS)
ENTRIES = f"""WITH {WHOLE}, l AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '[.,] ', chr(10), 'g'), chr(10))) AS line, generate_subscripts(string_split(regexp_replace(t, '[.,] ', chr(10), 'g'), chr(10)), 1) AS i FROM said),
f AS (SELECT doc_id, i, trim(line) AS x FROM l WHERE trim(line) != ''), h AS (SELECT *, ({_ROLE}) AS first FROM f),
e AS (SELECT *, sum(CAST(first AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS entry FROM h)
SELECT doc_id AS resume_id, CAST(entry AS BIGINT) AS entry, max(CASE WHEN first THEN x END) AS title, CAST(coalesce(length(nullif(coalesce(string_agg(CASE WHEN NOT first THEN x END, ' ' ORDER BY i), ''), '')), 0) AS INTEGER) AS chars FROM e WHERE entry > 0 GROUP BY doc_id, entry"""


def resume_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles of the conversations, each taken as a resume."""
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("resume_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    p = resumes.profiles(talks)
    return p.select("resume_id", "name", "email", F.array_join("skills", "|").alias("skills"), F.size("leadership").alias("leadership"), "has_progression", "market_score", F.array_join("advice", "|").alias("advice"))


_SKILLS = f"list_sort(list_distinct(list_transform({_SKILL_SQL}, lambda x: lower(x))))"
_CATEGORY = _cascade_sql(tx.CATEGORIES, "other", "lower(s)")
_ANY = lambda column, words: " OR ".join(f"contains(lower({column}), '{w}')" for w in words)
_NAME = r"^[A-ZÀ-Ý][\p{L}''.-]+( [A-ZÀ-Ý][\p{L}''.-]+){1,3}$"
_TITLES = r"(?i)^(name|mr\.?|mrs\.?|ms\.?|dr\.?)\s*:?\s+|,?\s+(jr\.?|sr\.?|phd|md)$"
_ADVICE = ", ".join(f"CASE WHEN {test} THEN '{said}' END" for (_, said), test in zip(resumes.ADVICE, ("trim(text) = ''", "len(skills) < 5", "schools = 0", "langs = 0", "soft = 0")))
RESUMES = f"""WITH talk AS (SELECT conv_id AS id, coalesce(string_agg(text, chr(10) ORDER BY turn, text), '') AS text FROM conversations GROUP BY conv_id),
li AS (SELECT id, trim(unnest(string_split(text, chr(10)))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM talk), ln AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM li WHERE x != ''),
cl AS (SELECT *, trim(regexp_replace(x, '{_TITLES}', '', 'g')) AS clean FROM ln),
na AS (SELECT id, arg_min(clean, n) AS name FROM cl WHERE regexp_matches(clean, '{_NAME}') AND NOT regexp_matches(x, '{resumes.NOT_NAMES}') AND NOT regexp_matches(x, '@|[0-9]{{3}}') AND length(x) <= 50 GROUP BY id),
ro AS (SELECT *, ({_ANY("x", resumes.ROLE_WORDS)}) AS first FROM ln), en AS (SELECT *, sum(CAST(first AS INTEGER)) OVER (PARTITION BY id ORDER BY n) AS entry FROM ro), ti AS (SELECT id, entry, max(CASE WHEN first THEN x END) AS title FROM en WHERE entry > 0 GROUP BY id, entry),
jo AS (SELECT id, count(*) AS jobs, count(*) FILTER ({_ANY("title", resumes.LEADERSHIP)}) AS lead FROM ti GROUP BY id), sc AS (SELECT id, count(*) AS schools FROM ln WHERE regexp_matches(x, '{resumes.EDUCATION}') GROUP BY id),
pl AS (SELECT id, text, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS t FROM talk), sk AS (SELECT id, text, {_SKILLS} AS skills FROM pl), ct AS (SELECT id, {_CATEGORY} AS c FROM (SELECT id, unnest(skills) AS s FROM sk)),
cc AS (SELECT id, count(DISTINCT c) AS kinds, count(*) FILTER (c IN ('programming_languages', 'frameworks', 'databases')) AS tech, count(*) FILTER (c = 'soft_skills') AS soft, count(*) FILTER (c = 'programming_languages') AS langs FROM ct GROUP BY id),
al AS (SELECT sk.*, coalesce(name, 'Name Not Found') AS name, coalesce(jobs, 0) AS jobs, coalesce(lead, 0) AS lead, coalesce(schools, 0) AS schools, coalesce(kinds, 0) AS kinds, coalesce(tech, 0) AS tech, coalesce(soft, 0) AS soft, coalesce(langs, 0) AS langs FROM sk LEFT JOIN na USING (id) LEFT JOIN jo USING (id) LEFT JOIN sc USING (id) LEFT JOIN cc USING (id))
SELECT id AS resume_id, name, nullif(regexp_extract(text, '{tx.EMAIL}'), '') AS email, array_to_string(skills, '|') AS skills, CAST(lead AS INTEGER) AS leadership, jobs > 1 AS has_progression, CAST(least(100, least(5 * kinds, 30) + least(5 * jobs, 25) + least(3 * tech, 25) + least(4 * soft, 20)) AS INTEGER) AS market_score, array_to_string(list_filter([{_ADVICE}], lambda x: x IS NOT NULL), '|') AS advice FROM al"""


def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packs.distribution(table(spark, sf_dir, "documents"), "source", "lang")


def label_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to label of each order, from its columns, and a preview of it."""
    o = table(spark, sf_dir, "orders")
    text = packs.row_text(o, "o_orderpriority", "o_orderstatus", "no_such_column", "o_orderkey")
    return o.select("o_orderkey", text.alias("text"), packs.preview(text, 8).alias("preview"))


QUERIES = {
    "hybrid_search": (hybrid_search, HYBRID),
    "static_features": (static_features, STATIC),
    "resume_entries": (resume_entries, ENTRIES),
    "resume_profiles": (resume_profiles, RESUMES),
    "source_counts": (source_counts, "SELECT 'source' AS field, source AS value, count(*) AS n FROM documents GROUP BY source UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang"),
    "label_text": (label_text, "SELECT o_orderkey, o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey AS text, substring(o_orderpriority || ' ' || o_orderstatus || ' ' || o_orderkey, 1, 8) AS preview FROM orders"),
}

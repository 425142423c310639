"""Registered reader, feed and ingest queries, and their SQL.

The tables hold no landed feeds, so orders, parts and events are written in each feed's own form
and mapped back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..operators import packs
from ..sources import mappers, readers
from ..sources.shared import folder
from ..sources.tables import table
from .text import _WORD_SQL, _cascade_sql


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("o_orderkey").alias("k"), F.floor("o_totalprice").cast("int").alias("p"), F.col("o_orderdate").alias("d"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("pr"), F.col("c_mktsegment").alias("m"), F.col("o_custkey").alias("u"), F.col("n_name").alias("n"), F.col("r_name").alias("r"))


ORDERS = "o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice) AS INTEGER) AS p, o_orderdate AS d, o_orderstatus AS s, o_orderpriority AS pr, c_mktsegment AS m, o_custkey AS u, n_name AS n, r_name AS r FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def format_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV, JSON lines, objects back to back and plain JSON, and read back."""
    path, schema = folder(spark, "feed"), "key long, name string, note string"
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.concat(F.lit('say "'), "c_mktsegment", F.lit('",\nthen ü')).alias("note"))
    rows.write.csv(f"{path}/csv", header=True, escape='"')
    readers.write_jsonl(rows, f"{path}/jsonl")
    rows.select(F.to_json(F.struct("key", "name", "note"))).write.option("lineSep", " ").text(f"{path}/stream")
    found = {
        "csv": readers.read_csv(spark, f"{path}/csv").withColumn("key", F.col("key").cast("long")),
        "json": readers.read_json(spark, f"{path}/jsonl", schema),
        "jsonl": readers.read_jsonl(spark, f"{path}/jsonl", schema),
        "stream": readers.read_json_stream(spark, f"{path}/stream", schema),
    }
    parts = [df.agg(F.count("*").alias("rows"), F.sum("key").alias("keys"), F.max("name").alias("last"), F.countDistinct("note").alias("notes"), F.max(F.length("note")).alias("longest")).withColumn("format", F.lit(name)) for name, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


ROUND_TRIP = """SELECT f AS format, count(*) AS rows, CAST(sum(c_custkey) AS BIGINT) AS keys, max(c_name) AS last, count(DISTINCT c_mktsegment) AS notes, CAST(max(length(c_mktsegment)) + 14 AS INTEGER) AS longest
FROM customer, (SELECT unnest(['csv', 'json', 'jsonl', 'stream']) AS f) GROUP BY f"""


def _posted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of a job CSV, everything text; every eleventh has no title."""
    k = F.col("k")
    money = F.concat(F.lit("$"), F.col("p").cast("string"))
    return _orders(spark, sf_dir).select(
        F.when(k % 11 != 0, F.concat("m", F.lit(" "), F.when(k % 3 == 0, "lead developer").when(k % 3 == 1, "intern").otherwise("clerk"))).alias("Position Title"),
        F.when(k % 4 != 0, F.col("m")).alias("employer"), F.concat("n", F.lit(", "), F.col("r")).alias("job_location"),
        F.when(k % 5 == 0, "n/a").when(k % 5 == 1, money).otherwise(F.concat(money, F.lit(" - "), (F.col("p") + 1000).cast("string"))).alias("salary_range"),
        F.concat(F.lit("We use Python and Docker, level "), "pr").alias("Qualifications"), F.when(k % 2 == 0, "SQL; Go | x").otherwise("Excel").alias("tools"),
        F.when(k % 3 == 0, "Remote").when(k % 3 == 1, "Hybrid").otherwise("On site").alias("Work Model"), F.when(k % 2 == 0, "Yes").otherwise("no").alias("H1b Sponsored"),
        F.when(k % 7 == 0, "yes").alias("Is New Grad"), F.concat(F.lit("http://x.example/"), k).alias("Apply"),
    )


def csv_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job CSV rows mapped by column aliases: hybrid counts as remote, new graduates as entry."""
    j = readers.jobs_from_swe_csv(_posted_rows(spark, sf_dir))
    return j.select(
        F.substring_index("source_url", "/", -1).cast("long").alias("k"), "title", "company", "location.city", "location.state", "salary.low", "salary.high", F.array_join("required_skills", "|").alias("skills"),
        "job_type", "experience_level", "remote_allowed", "visa_sponsorship",
    )


_POSTED = f"""{ORDERS}, w AS (SELECT *, m || ' ' || CASE k % 3 WHEN 0 THEN 'lead developer' WHEN 1 THEN 'intern' ELSE 'clerk' END AS title, 'We use Python and Docker, level ' || pr AS t FROM o WHERE k % 11 != 0),
x AS (SELECT *, lower(title || ' ' || t) AS b FROM w)"""
CSV_JOBS = f"""WITH {_POSTED} SELECT k, title, CASE WHEN k % 4 != 0 THEN m ELSE 'Unknown Company' END AS company, n AS city, r AS state, CASE WHEN k % 5 != 0 AND p > 0 THEN p END AS low, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN CASE WHEN p > 0 THEN p END ELSE p + 1000 END AS high,
array_to_string(list_sort(list_distinct(list_concat(CASE WHEN k % 2 = 0 THEN ['sql', 'go'] ELSE ['excel'] END, {_WORD_SQL}))), '|') AS skills, {_cascade_sql(nz.JOB_TYPES, "full_time", "b")} AS job_type,
CASE WHEN k % 7 = 0 THEN 'entry' ELSE {_cascade_sql(nz.LEVELS, "entry", "b")} END AS experience_level, k % 3 != 2 AS remote_allowed, k % 2 = 0 AS visa_sponsorship FROM x"""


def csv_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reading the job CSV counted: rows, rows without a title, and jobs."""
    return readers.csv_counts(_posted_rows(spark, sf_dir))


def city_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a city's open data, mapped to jobs."""
    k = F.col("k")
    text = F.concat(F.lit("ETL and tableau work, "), F.when(k % 2 == 0, "hybrid").otherwise("at the desk"))
    rows = _orders(spark, sf_dir).select(
        F.when(k % 5 != 0, k.cast("string")).alias("job_id"), F.concat("m", F.lit(" Analyst")).alias("business_title"), F.when(k % 3 == 0, F.concat(F.lit(" "), "n", F.lit(" "))).alias("agency"), F.when(k % 4 == 0, "9 Queens Blvd").when(k % 4 == 1, "Bronx").otherwise("1 Main St").alias("work_location"),
        F.when(k % 3 == 0, "F").when(k % 3 == 1, "P").otherwise("T").alias("full_time_part_time_indicator"), F.when(k % 4 == 0, "Senior Manager").when(k % 4 == 1, "Entry-Level").when(k % 4 == 2, "Executive").alias("career_level"),
        F.col("p").cast("string").alias("salary_range_from"), F.when(k % 2 == 0, F.col("p") + 10).cast("string").alias("salary_range_to"), F.when(k % 2 == 0, "Annual").otherwise("Hourly").alias("salary_frequency"), F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("posting_date"),
        F.lit("20240101").alias("process_date"), F.when(k % 2 == 0, "a; b").alias("preferred_skills"), text.alias("job_description"), F.when(k % 7 == 0, "must live here").alias("residency_requirement"), F.when(k % 6 == 0, "https://apply.example").otherwise("by post").alias("to_apply"),
    )
    made = [f.strip().split(" ")[0] for f in mappers.CITY_SCHEMA.split(",")]
    rows = rows.select("*", *[F.lit(None).cast("string").alias(c) for c in made if c not in rows.columns])
    j = mappers.city_jobs(rows)
    return j.select(
        "job_id", "title", "company", "location.city", "job_type", "experience_level", "salary.min_salary", "salary.max_salary", "salary.period", F.array_join("required_skills", "|").alias("skills"), F.array_join("preferred_skills", "|").alias("preferred"),
        F.size("benefits").alias("benefits"), F.col("posted_date").cast("date").alias("posted"), "remote_allowed", "apply_url",
    )


CITY = f"""WITH {ORDERS}, i AS (SELECT *, CASE WHEN k % 5 != 0 THEN CAST(k AS VARCHAR) ELSE lower(replace(m || ' Analyst', ' ', '_')) || '_20240101' END AS id FROM o)
SELECT 'nyc_' || id AS job_id, m || ' Analyst' AS title, CASE WHEN k % 3 = 0 THEN trim(n) ELSE 'City of New York' END AS company, CASE k % 4 WHEN 0 THEN 'Queens' WHEN 1 THEN 'Bronx' ELSE 'New York' END AS city, CASE k % 3 WHEN 0 THEN 'full_time' WHEN 1 THEN 'part_time' ELSE 'contract' END AS job_type,
CASE k % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'entry' WHEN 2 THEN 'executive' ELSE 'mid' END AS experience_level, CASE WHEN p != 0 OR k % 2 = 0 THEN p END AS min_salary, CASE WHEN k % 2 = 0 THEN p + 10 END AS max_salary, CASE WHEN p != 0 OR k % 2 = 0 THEN CASE WHEN k % 2 = 0 THEN 'yearly' ELSE 'hourly' END END AS period,
'data-engineering|tableau' AS skills, CASE WHEN k % 2 = 0 THEN 'a|b' ELSE '' END AS preferred, CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS benefits, CAST(d AS DATE) AS posted, k % 2 = 0 AS remote_allowed, CASE WHEN k % 6 = 0 THEN 'https://apply.example' ELSE 'https://cityjobs.nyc.gov/jobsearch.html?job_id=' || id END AS apply_url FROM i"""


def board_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON of a job board, mapped to jobs."""
    k = F.col("k")
    f = lambda c: F.col(c)
    body = F.to_json(F.struct(
        k.cast("string").alias("_id"), f("m").alias("title"), F.struct(F.when(k % 3 != 0, f("n")).alias("companyName"), F.struct(F.array(F.lit("Dental plan"), F.lit(""), F.when(k % 2 == 0, "Life cover")).alias("benefits")).alias("benefits")).alias("owner"),
        F.when(k % 2 == 0, F.concat("n", F.lit(", "), f("r"))).otherwise(f("n")).alias("locationAddress"), F.when(k % 2 == 0, "Part-Time").alias("employmentType"), F.when(k % 3 == 0, "Senior-Level").when(k % 3 == 1, "other").alias("seniority"),
        F.when(k % 5 != 0, f("p")).alias("salaryRangeMinYearly"), F.array(F.lit("sql"), F.lower("m")).alias("skillRequirements"), F.array(F.lit("sql"), F.lit("go")).alias("skills_suggest"), F.when(k % 3 == 0, "Hybrid").when(k % 3 == 1, "Remote").alias("workModel"), F.lit("u").alias("url"),
        F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("createdAt"),
    ))
    rows = _orders(spark, sf_dir).select(F.from_json(body, mappers.BOARD_SCHEMA).alias("j")).select("j.*")
    j = mappers.board_jobs(rows)
    return j.select(F.col("job_id").cast("long").alias("k"), "title", "company", "location.city", "location.state", "job_type", "experience_level", "salary.min_salary", F.array_join(F.transform("benefits", lambda b: F.concat(b["name"], F.lit("="), b["category"])), "|").alias("benefits"), F.array_join("required_skills", "|").alias("skills"), "remote_allowed", F.col("posted_date").cast("date").alias("posted"), "apply_url")


BOARD = f"""WITH {ORDERS} SELECT k, m AS title, CASE WHEN k % 3 != 0 THEN n ELSE 'Unknown Company' END AS company, n AS city, CASE WHEN k % 2 = 0 THEN r ELSE 'Unknown' END AS state, CASE WHEN k % 2 = 0 THEN 'part_time' ELSE 'full_time' END AS job_type, CASE WHEN k % 3 = 0 THEN 'senior' ELSE 'mid' END AS experience_level,
CASE WHEN k % 5 != 0 AND p != 0 THEN p END AS min_salary, 'Dental plan=health' || CASE WHEN k % 2 = 0 THEN '|Life cover=insurance' ELSE '' END AS benefits, array_to_string(list_sort(['go', lower(m), 'sql']), '|') AS skills, k % 3 != 2 AS remote_allowed, CAST(d AS DATE) AS posted, 'u' AS apply_url FROM o"""


def network_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings of a network, those without an id or title counted apart."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    body = F.to_json(F.struct(
        F.when(i % 13 != 0, F.concat(F.lit("urn:li:job:"), i)).alias("entityUrn"), F.when(i % 17 != 0, F.col("event_type")).alias("title"), F.when(i % 2 == 0, "remote Python work").otherwise("Excel at a desk").alias("description"), F.lit("C").alias("companyName"), F.lit("Austin TX").alias("location"),
        F.when(i % 3 == 0, "TEMPORARY").when(i % 3 == 1, "PART_TIME").alias("employmentType"), F.when(i % 4 == 0, "DIRECTOR").when(i % 4 == 1, "ASSOCIATE").otherwise("x").alias("experienceLevel"), F.when(i % 2 == 0, F.struct((i % 1000).cast("int").alias("start"))).alias("salary"), F.lit("p").alias("jobPostingUrl"),
    ))
    ok, bad = mappers.accepted(mappers.network_jobs(e.select(F.from_json(body, mappers.NETWORK_SCHEMA).alias("j")).select("j.*")))
    kept = ok.groupBy(F.lit("kept").alias("kind"), "job_type", "experience_level", "remote_allowed", "location.city", "location.state", F.array_join("required_skills", "|").alias("skills")).agg(F.count("*").alias("jobs"), F.sum("salary.min_salary").alias("pay"), F.max(F.col("job_id").cast("long")).alias("last"))
    none = F.lit(None)
    return kept.unionByName(bad.agg(F.count("*").alias("jobs")).select(F.lit("rejected").alias("kind"), *[none.cast("string").alias(c) for c in ("job_type", "experience_level")], none.cast("boolean").alias("remote_allowed"), *[none.cast("string").alias(c) for c in ("city", "state", "skills")], "jobs", none.cast("long").alias("pay"), none.cast("long").alias("last")))


_NETWORK_WORDS = _WORD_SQL.replace("lower(t)", "lower(CASE WHEN i % 2 = 0 THEN 'remote Python work' ELSE 'Excel at a desk' END)")
NETWORK = f"""WITH e AS (SELECT event_id AS i FROM events), ok AS (SELECT CASE i % 3 WHEN 0 THEN 'contract' WHEN 1 THEN 'part_time' ELSE 'full_time' END AS job_type, CASE i % 4 WHEN 0 THEN 'senior' WHEN 1 THEN 'entry' ELSE 'mid' END AS experience_level, i % 2 = 0 AS remote_allowed, array_to_string(list_sort({_NETWORK_WORDS}), '|') AS skills, CASE WHEN i % 2 = 0 THEN i % 1000 END AS pay, i
FROM e WHERE i % 13 != 0 AND i % 17 != 0)
SELECT 'kept' AS kind, job_type, experience_level, remote_allowed, 'Austin' AS city, 'TX' AS state, skills, count(*) AS jobs, CAST(sum(pay) AS BIGINT) AS pay, max(i) AS last FROM ok GROUP BY ALL
UNION ALL SELECT 'rejected', NULL, NULL, NULL, NULL, NULL, NULL, count(*), NULL, NULL FROM e WHERE i % 13 = 0 OR i % 17 = 0"""


def employer_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of an employer's CSV, joined to the titles' families."""
    k = F.col("k")
    none = F.lit(None).cast("string")
    rows = _orders(spark, sf_dir).select(
        k.cast("string").alias("job_id"), F.concat("m", F.lit(" role")).alias("job_title"), F.col("m").alias("standard_job"), F.concat(F.lit("build "), "n").alias("job_responsibility"), F.when(k % 2 == 0, "care").alias("job_requirement"), none.alias("detailed"),
        F.lit("SQL;Go").alias("traditional_skills"), F.when(k % 2 == 0, "go; Rust ").alias("new_skills"), F.lit("sql").alias("skills"), F.date_format("d", "yyyy/MM/dd").alias("publish_time"),
    ).fillna("", ["new_skills"])
    titles = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("standard_job_title"), F.substring("c_mktsegment", 1, 3).alias("standard_category")).distinct().where("standard_job_title != 'BUILDING'")
    j = mappers.employer_jobs(rows, titles)
    return j.select(F.col("job_id").cast("long").alias("k"), "title", "job_family", F.length("description").alias("chars"), F.array_join("skills", "|").alias("skills"), "posted", "content_hash")


EMPLOYER = f"""WITH {ORDERS}, t AS (SELECT *, 'Responsibilities:' || chr(10) || 'build ' || n || CASE WHEN k % 2 = 0 THEN chr(10) || chr(10) || 'Requirements:' || chr(10) || 'care' ELSE '' END AS t FROM o)
SELECT k, m || ' role' AS title, CASE WHEN m != 'BUILDING' THEN substring(m, 1, 3) END AS job_family, CAST(length(t) AS INTEGER) AS chars, CASE WHEN k % 2 = 0 THEN 'sql|Go|Rust' ELSE 'sql|Go' END AS skills, CAST(d AS DATE) AS posted, sha256('{{"job_id":"' || k || '","text":"' || replace(t, chr(10), '\\n') || '"}}') AS content_hash FROM t"""


def _silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as label rows: customers are resumes, parts are jobs."""
    line, o, part = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part"))
    return line.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat(F.lit("r"), F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lit("-"), F.col("l_linenumber")).alias("resume_id"), F.col("p_partkey").alias("job_id"), F.col("o_orderpriority").alias("target_job_family"), F.when(F.col("l_linenumber") != 2, F.array("l_returnflag", "l_linestatus")).alias("matched_skills"),
        F.concat(F.lit("t"), "l_orderkey").alias("job_title"), F.col("p_name").alias("job_description"), F.col("p_brand").alias("company_name"), F.lit("here").alias("location"), (F.col("l_quantity") % 4).cast("int").alias("grade"),
    )


def silver_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per part from its label rows: commonest family, skills by votes, first text."""
    j = mappers.silver_jobs(_silver(spark, sf_dir))
    return j.select("job_id", "title", "company", "job_family", F.array_join("skills", "|").alias("skills"))


SILVER_ROWS = "x AS (SELECT 'r' || lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || '-' || l_linenumber AS resume_id, p_partkey AS job_id, o_orderpriority AS fam, CASE WHEN l_linenumber != 2 THEN [l_returnflag, l_linestatus] END AS sk, 't' || l_orderkey AS title, p_brand AS company, CAST(l_quantity % 4 AS INTEGER) AS grade FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"
SILVER = f"""WITH {SILVER_ROWS}, f AS (SELECT job_id, fam, count(*) AS n FROM x GROUP BY ALL), ff AS (SELECT job_id, fam AS job_family FROM f QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY n DESC, fam DESC) = 1),
v AS (SELECT job_id, s, count(*) AS n FROM (SELECT job_id, unnest(sk) AS s FROM x) GROUP BY ALL), vv AS (SELECT job_id, string_agg(s, '|' ORDER BY n DESC, s) AS skills FROM v GROUP BY job_id),
t AS (SELECT job_id, title, company FROM x QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY resume_id) = 1)
SELECT job_id, title, company, job_family, coalesce(skills, '') AS skills FROM t JOIN ff USING (job_id) LEFT JOIN vv USING (job_id)"""


def label_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows of two sources in the pair contract, counted by grade."""
    rows = _silver(spark, sf_dir)
    pairs = mappers.label_pairs(rows, "silver").unionByName(mappers.label_pairs(rows.where("grade = 3"), "gold"))
    return pairs.groupBy("label_source", "grade").agg(F.count("*").alias("rows"), F.countDistinct("pair_key").alias("pairs"), F.max("pair_key").alias("last"))


CONTRACT = f"""WITH {SILVER_ROWS}, u AS (SELECT 'silver' AS label_source, grade, resume_id || '::' || job_id AS pair_key FROM x UNION ALL SELECT 'gold', grade, resume_id || '::' || job_id FROM x WHERE grade = 3)
SELECT label_source, grade, count(*) AS rows, count(DISTINCT pair_key) AS pairs, max(pair_key) AS last FROM u GROUP BY ALL"""


def profile_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as rows of a resume CSV, their skills as JSON text."""
    c, i = table(spark, sf_dir, "customer"), F.col("c_custkey")
    rows = c.select(
        F.concat(F.lit("p"), i).alias("resume_id"), F.col("c_name").alias("profile_text"), F.when(i % 3 == 0, "broken").otherwise(F.concat(F.lit('[{"name":"sql","level":"'), "c_mktsegment", F.lit('"},{"name":"go"}]'))).alias("skills_normalized"), F.col("c_mktsegment").alias("target_job_family"), F.lit("x").alias("preferred_location"),
        F.lit("BSc").alias("education"), F.lit("bachelor").alias("degree"), F.when(i % 2 == 0, "maths").alias("major"), F.when(i % 4 == 0, "3.7").when(i % 4 == 1, "many").alias("years_experience"), F.lit("secret name").alias("name"),
    )
    p = mappers.profiles(rows)
    return p.select("candidate_id", "summary", F.coalesce(F.array_join(F.transform("skills", lambda s: F.concat_ws(":", s["name"], s["level"])), "|"), F.lit("")).alias("skills"), "target_job_family", "education.major", "years_experience")


PROFILES = """SELECT 'p' || c_custkey AS candidate_id, c_name AS summary, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'sql:' || c_mktsegment || '|go' END AS skills, c_mktsegment AS target_job_family, CASE WHEN c_custkey % 2 = 0 THEN 'maths' END AS major, CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END AS years_experience FROM customer"""


def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, first texts, listed terms, titled parts and search texts of orders."""
    k = F.col("k")
    o = _orders(spark, sf_dir)
    rows = o.withColumns({"Salary": F.when(k % 3 == 0, F.concat(F.lit("$"), "p", F.lit(",000"))).when(k % 3 == 1, "x"), "pay": F.col("p").cast("string"), "blank": F.when(k % 2 == 0, F.concat(F.lit(" "), "m", F.lit(" "))).otherwise("  ")})
    terms = nz.listed_skills(F.concat(F.lit("Python, "), "m", F.lit("|q;;\n R ")), F.lit("docker and aws"))
    j = rows.select("k", F.lit("T").alias("title"), F.col("n").alias("company"), F.lit("D").alias("description"), F.array("m", "r").alias("required_skills"), "Salary", "pay", "blank", terms.alias("terms"))
    j = readers.with_search_text(j)
    return j.select(
        "k", nz.number_field(F.col("Salary"), F.col("pay")).alias("number"), nz.first_text(F.col("blank"), F.col("company")).alias("first"),
        F.array_join("terms", "|").alias("terms"), F.length(nz.sections(about_us=F.col("blank"), pay=F.col("pay"))).alias("chars"), "all_text", nz.safe_float(F.col("Salary"), -1.0).alias("amount"), readers.coordinates(F.concat(F.lit("1.5, "), (k % 90).cast("string")))["lat"].alias("lat"),
        F.array_join(nz.split_terms(F.col("blank")), "|").alias("parts"), packs.preview(F.col("company"), 3).alias("preview"),
    )


VALUES = f"""WITH {ORDERS} SELECT k, CASE WHEN k % 3 = 0 THEN p * 1000 ELSE p END AS number, CASE WHEN k % 2 = 0 THEN m ELSE n END AS first, array_to_string(list_sort(list_distinct(['python', lower(m), 'docker', 'aws', 'r'])), '|') AS terms,
CAST(length('Pay:') + 1 + length(CAST(p AS VARCHAR)) + CASE WHEN k % 2 = 0 THEN length('About us:') + 1 + length(m) + 2 ELSE 0 END AS INTEGER) AS chars, 'T ' || n || ' D ' || m || ' ' || r AS all_text, CAST(-1.0 AS DOUBLE) AS amount, CAST(k % 90 AS DOUBLE) AS lat, CASE WHEN k % 2 = 0 THEN m ELSE '' END AS parts, substring(n, 1, 3) AS preview FROM o"""


def bulk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored by key with faults put in: what was stored, refused, and the first refusals."""
    o = table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderkey")).alias("job_id"), F.when(F.col("o_orderkey") % 23 != 0, F.col("o_orderstatus")).alias("title"), F.lit(1).alias("ingest_ts"), F.col("o_orderkey").alias("line"))
    again = o.where("job_id % 3 = 0").withColumns({"ingest_ts": F.lit(2), "title": F.concat("title", F.lit("!"))})
    path = folder(spark, "feed")
    report = readers.bulk_store(o.unionByName(again), f"{path}/jobs", order="line")
    stored = spark.read.parquet(f"{path}/jobs")
    tally = stored.agg(F.count("*").alias("n"), F.count_if(F.col("title").endswith("!")).alias("newer")).select(F.lit("stored").alias("kind"), "n", F.col("newer").alias("line"))
    return tally.unionByName(report)


BULK = """WITH o AS (SELECT CASE WHEN o_orderkey % 17 != 0 THEN o_orderkey END AS id, CASE WHEN o_orderkey % 23 != 0 THEN o_orderstatus END AS title, o_orderkey AS line FROM orders),
r AS (SELECT * FROM o UNION ALL SELECT * FROM o WHERE id % 3 = 0), bad AS (SELECT *, CASE WHEN id IS NULL THEN 'no id' ELSE 'no title' END AS kind FROM r WHERE id IS NULL OR title IS NULL)
SELECT 'stored' AS kind, count(*) AS n, count(*) FILTER (id % 3 = 0) AS line FROM o WHERE id IS NOT NULL AND title IS NOT NULL
UNION ALL SELECT 'accepted', count(*), NULL FROM r WHERE id IS NOT NULL AND title IS NOT NULL UNION ALL SELECT 'refused', count(*), NULL FROM bad
UNION ALL SELECT kind, 1, line FROM (SELECT *, row_number() OVER (ORDER BY line) AS i FROM (SELECT DISTINCT kind, line FROM bad)) WHERE i <= 20"""


def embedding_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors saved as one table of ids and vectors, read back; then the table cleared."""
    path = folder(spark, "feed")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    readers.save_vectors(vectors, f"{path}/vectors")
    back = readers.load_vectors(spark, f"{path}/vectors")
    readers.clear(back, f"{path}/cleared")
    left = spark.read.parquet(f"{path}/cleared").count()
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("id", F.size("vector").alias("dims"), F.round(total, 4).alias("total"), F.lit(left).cast("long").alias("left"))


VECTORS = "SELECT vec_id AS id, CAST(len(embedding) AS INTEGER) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, CAST(0 AS BIGINT) AS \"left\" FROM embeddings"

QUERIES = {
    "format_round_trip": (format_round_trip, ROUND_TRIP),
    "csv_jobs": (csv_jobs, CSV_JOBS),
    "csv_counts": (csv_counts, "SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 11 = 0) AS without_title, count(*) FILTER (o_orderkey % 11 != 0) AS jobs FROM orders"),
    "city_feed": (city_feed, CITY),
    "board_feed": (board_feed, BOARD),
    "network_feed": (network_feed, NETWORK),
    "employer_feed": (employer_feed, EMPLOYER),
    "silver_feed": (silver_feed, SILVER),
    "label_contract": (label_contract, CONTRACT),
    "profile_rows": (profile_rows, PROFILES),
    "normalize_values": (normalize_values, VALUES),
    "bulk_store": (bulk_store, BULK),
    "embedding_store": (embedding_store, VECTORS),
}

"""Registered text queries and their SQL.

The documents hold few postings or resumes, so each gets one sentence of that kind, by its id,
after its own text; all queries read both, whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as nz
from ..functions import scores as sc
from ..functions import text as tx
from ..sources.tables import table

SENTENCES = (
    "US work authorization required. Unable to sponsor. Minimum bachelor in physics, minimum 5 years of experience.",
    "Open to remote. AWS Certified Solutions Architect, PMP and CKA wanted. Fluent in German.",
    "On-site only, based in Berlin Mitte. Required master degree; at least 3 years of relevant work. Secret clearance.",
    "No remote. CCNA or CISSP. Spanish fluency, native in French. 7+ years of Python, SQL and Docker.",
    "Remote-first team. CPA or registered nurse. We use Java, React, Kubernetes and machine learning.",
    "Senior data engineer in Austin, Texas, salary of $120k, knows SQL and Agile.",
    "Junior software developer, $80,000 to start, remote, with leadership and teamwork.",
    "Write to jo.doe@example.org or call 555-123-4567 or (555) 987-6543 about Photoshop and MongoDB.",
    "Product manager, 90k annual, Seattle. Jira, Scrum, communication and C#.",
    "Nothing in particular.",
)
_LIST = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SENTENCES) + "]"
POSTED = f"posted AS (SELECT doc_id, text || chr(10) || {_LIST}[CAST(doc_id % {len(SENTENCES)} AS INTEGER) + 1] AS t FROM documents)"
WHOLE = f"said AS (SELECT doc_id, concat_ws(chr(10), text, {_LIST}[CAST(doc_id % {len(SENTENCES)} AS INTEGER) + 1]) AS t FROM documents)"


def _sentence() -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SENTENCES]), (F.col("doc_id") % len(SENTENCES) + 1).cast("int"))


def _posted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit("\n"), _sentence()).alias("t"))


def whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of each document's text, and its sentence."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", _sentence()).alias("t"))


def _sql_any(pattern: str, text: str = "lower(t)") -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _bordered(source: str) -> str:
    """Texts whose words end for RE2 where they end for Spark: beyond ASCII, a letter or digit becomes _,
    which is part of a word and of no pattern or name, and anything else ?."""
    letters = "regexp_replace(lower(coalesce(t, '')), '[^\\x00-\\x7F\\p{L}\\p{Nd}\\p{Mn}]', '?', 'g')"
    return f"plain AS (SELECT doc_id, regexp_replace({letters}, '[^\\x00-\\x7F]', '_', 'g') AS t FROM {source})"


def hard_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each posting demands, and why it rules out a fixed candidate."""
    # one column per step: the text in lower case, each constraint, the reason from their columns
    lowered = _posted(spark, sf_dir).select("doc_id", F.lower(F.coalesce("t", F.lit(""))).alias("t"))
    found = lowered.select("doc_id", *[v.alias(k) for k, v in tx.constraints(F.col("t"), lowered=True).items()])
    c = {k: F.col(k) for k in found.columns if k != "doc_id"}
    none = lambda *x: F.array(*[F.lit(v) for v in x]).cast("array<string>")
    candidate = {"needs_visa": F.col("doc_id") % 2 == 0, "certifications": none("PMP", "CKA", "CCNA"), "languages": none("german"), "degree": F.lit(2), "years": F.lit(4)}
    flat = {k: F.array_join(v, "|") if k in ("certifications", "languages", "licences") else v for k, v in c.items()}
    return found.select("doc_id", *[v.alias(k) for k, v in flat.items()], sc.constraint_reason(c, candidate).alias("reason"))


def _extract_all() -> str:
    parts = [f"regexp_extract_all(lower(t), '{p}', {g})" for p, g in tx.CERTIFICATES]
    return "flatten([" + ", ".join(parts) + "])"


def _pick(pairs: list[tuple[str, str]]) -> str:
    items = ", ".join(f"CASE WHEN {_sql_any(p)} THEN '{n}' END" for n, p in pairs)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


_FLUENT = r"(fluent|fluency|proficient|native|excellent)\s+in\s+{x}\b|{x}\s+(fluency|required)\b"
CONSTRAINTS = f"""WITH {POSTED}, {_bordered("posted")}, c AS (SELECT doc_id, {_sql_any(tx.WORK_AUTHORISATION)} AS requires_work_authorisation, {_sql_any(tx.NO_SPONSORSHIP)} AS no_sponsorship,
CASE WHEN {_sql_any(tx.ON_SITE)} THEN false WHEN {_sql_any(tx.REMOTE)} THEN true END AS remote_allowed, nullif(trim(regexp_extract(lower(t), '{tx.LOCATED}', 2)), '') AS location_required,
list_distinct({_extract_all()}) AS cert_set, {_extract_all()} AS cert_all,
CASE {" ".join(f"WHEN {_sql_any(rf'(minimum|required)\s+({p})')} THEN '{n}'" for n, p in tx.DEGREES)} END AS min_degree,
CAST(coalesce(nullif(regexp_extract(lower(t), '{tx.YEARS}', 2), ''), nullif(regexp_extract(lower(t), '{tx.YEARS_PLUS}', 1), '')) AS INTEGER) AS min_years,
CASE {" ".join(f"WHEN {_sql_any(p)} THEN '{p}'" for p in tx.CLEARANCES)} END AS clearance,
{_pick([(x, _FLUENT.replace("{x}", x)) for x in tx.LANGUAGES])} AS langs, {_pick([(p, p) for p in tx.LICENCES])} AS lics FROM plain),
d AS (SELECT *, list_transform(list_filter(cert_all, lambda x, i: list_position(cert_all, x) = i), lambda x: upper(x)) AS certs FROM c)
SELECT doc_id, requires_work_authorisation, no_sponsorship, remote_allowed, location_required, array_to_string(certs, '|') AS certifications, min_degree, min_years, clearance, array_to_string(langs, '|') AS languages, array_to_string(lics, '|') AS licences,
CASE WHEN requires_work_authorisation AND no_sponsorship AND doc_id % 2 = 0 THEN 'work authorisation' WHEN no_sponsorship AND doc_id % 2 = 0 THEN 'no sponsorship'
 WHEN len(list_filter(certs, lambda x: NOT list_contains(['PMP', 'CKA', 'CCNA'], x))) > 0 THEN 'certification' WHEN min_degree IN ('master', 'doctorate') THEN 'degree' WHEN min_years > 4 THEN 'years'
 WHEN len(list_filter(langs, lambda x: x != 'german')) > 0 THEN 'language' END AS reason FROM d"""


def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posted(spark, sf_dir).select("doc_id", F.array_join(tx.emails(F.col("t")), "|").alias("emails"), F.array_join(tx.phones(F.col("t")), "|").alias("phones"))


CONTACTS = f"""WITH {POSTED} SELECT doc_id, array_to_string(regexp_extract_all(t, '{tx.EMAIL}'), '|') AS emails, array_to_string(list_concat(regexp_extract_all(t, '{tx.PHONES[0]}'), regexp_extract_all(t, '{tx.PHONES[1]}')), '|') AS phones FROM posted"""


def skill_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posted(spark, sf_dir).select("doc_id", F.array_join(tx.skills(F.col("t")), "|").alias("skills"), F.array_join(nz.dictionary_skills(F.col("t")), "|").alias("words"))


_SKILL_SQL = "flatten([" + ", ".join(f"regexp_extract_all(t, '(?i){p}')" for p in tx.SKILLS) + "])"
_WORD_SQL = "list_filter([" + ", ".join(f"'{w}'" for w in nz.SKILL_WORDS) + "], lambda w: contains(lower(t), w))"
# word borders are ASCII in RE2: an accented letter stands as a plain one there
_ASCII = "plain AS (SELECT doc_id, regexp_replace(t, '[^\\x00-\\x7F]', 'x', 'g') AS t FROM posted)"
_PLAIN = _ASCII.replace("posted", "said")
SKILLS = f"WITH {POSTED}, {_ASCII} SELECT doc_id, array_to_string(list_sort(list_distinct(list_transform({_SKILL_SQL}, lambda x: lower(x)))), '|') AS skills, array_to_string(list_sort({_WORD_SQL}), '|') AS words FROM plain"


def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    pay = tx.salaries(t)
    return whole(spark, sf_dir).select("doc_id", F.array_join(tx.titles(t), "|").alias("titles"), pay["low"].alias("low"), pay["high"].alias("high"), F.array_join(tx.places(t), "|").alias("places"), nz.job_type(t).alias("job_type"), nz.experience_level(t).alias("level"))


def _pay_sql(f: str) -> str:
    parts = []
    for p in tx.SINGLE_SALARIES:
        number = f"TRY_CAST(replace(regexp_extract_all(lower(t), '{p}', 1)[i], ',', '') AS BIGINT)"
        parts.append(f"list_transform(regexp_extract_all(lower(t), '{p}', 0), lambda w, i: TRY_CAST(CASE WHEN contains(w, 'k') OR {number} < 1000 THEN 1000 ELSE 1 END * CAST({number} AS HUGEINT) AS BIGINT))")
    for k in (1, 2):
        end = f"TRY_CAST(regexp_extract_all(lower(t), '{tx.SALARY_RANGE}', {k})[i] AS BIGINT)"
        parts.append(f"list_transform(regexp_extract_all(lower(t), '{tx.SALARY_RANGE}', 0), lambda w, i: TRY_CAST(CASE WHEN contains(w, 'k') THEN 1000 ELSE 1 END * CAST({end} AS HUGEINT) AS BIGINT))")
    return f"{f}(flatten([{', '.join(parts)}]))"


_TITLE_SQL = "flatten([" + ", ".join(f"regexp_extract_all(lower(t), '{p}')" for p in tx.TITLES) + "])"
_PLACE_SQL = "list_filter([" + ", ".join(f"'{x}'" for x in dict.fromkeys(tx.STATES + tx.CITIES)) + "], lambda x: contains(lower(t), lower(x)))"


def _cascade_sql(table_: tuple, default: str, text: str = "lower(t)") -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'contains({text}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{v}'" for v, words in table_) + f" ELSE '{default}' END"


KEYWORDS = f"""WITH {WHOLE}, {_bordered("said")} SELECT doc_id, array_to_string(list_sort(list_distinct({_TITLE_SQL})), '|') AS titles, {_pay_sql("list_min")} AS low, {_pay_sql("list_max")} AS high,
array_to_string(list_sort(list_concat({_PLACE_SQL}, CASE WHEN regexp_matches(lower(t), '\\bremote\\b') THEN ['Remote'] ELSE [] END)), '|') AS places, {_cascade_sql(nz.JOB_TYPES, "full_time")} AS job_type, {_cascade_sql(nz.LEVELS, "entry")} AS level FROM plain"""


def skill_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's skills by category, and the share of the market score they give."""
    named = whole(spark, sf_dir).select("doc_id", F.explode(F.array_distinct(F.concat(tx.skills(F.col("t")), nz.dictionary_skills(F.col("t"))))).alias("skill"))
    return named.groupBy("doc_id", tx.category(F.col("skill")).alias("category")).agg(F.array_join(F.array_sort(F.collect_set("skill")), "|").alias("skills"))


_BOTH_SQL = f"list_distinct(list_concat(list_transform({_SKILL_SQL}, lambda x: lower(x)), {_WORD_SQL}))"
CATEGORIES = f"""WITH {WHOLE}, {_PLAIN}, n AS (SELECT doc_id, unnest({_BOTH_SQL}) AS skill FROM plain)
SELECT doc_id, {_cascade_sql(tx.CATEGORIES, "other", "lower(skill)")} AS category, array_to_string(list_sort(list(DISTINCT skill)), '|') AS skills FROM n GROUP BY 1, 2"""


def marketability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's skills counted by kind, and its market score; all within the row."""
    named = whole(spark, sf_dir).select("doc_id", F.array_distinct(F.concat(tx.skills(F.col("t")), nz.dictionary_skills(F.col("t")))).alias("skills"))
    kinds = named.select("doc_id", F.transform("skills", lambda s: tx.category(s)).alias("c"))
    count = lambda *names: F.size(F.filter("c", lambda x: x.isin(*names))).cast("long")
    per = kinds.select("doc_id", F.size(F.array_distinct("c")).cast("long").alias("categories"), count("programming_languages", "frameworks", "databases").alias("technical"), count("soft_skills").alias("soft"))
    return per.select("doc_id", "categories", "technical", "soft", tx.marketability(F.col("categories"), F.col("doc_id") % 7, F.col("technical"), F.col("soft")).cast("long").alias("score"))


MARKETABILITY = f"""WITH {WHOLE}, {_PLAIN}, n AS (SELECT doc_id, unnest({_BOTH_SQL}) AS skill FROM plain), c AS (SELECT doc_id, {_cascade_sql(tx.CATEGORIES, "other", "lower(skill)")} AS c FROM n),
p AS (SELECT said.doc_id, count(DISTINCT c) AS categories, count(*) FILTER (c IN ('programming_languages', 'frameworks', 'databases')) AS technical, count(*) FILTER (c = 'soft_skills') AS soft FROM said LEFT JOIN c USING (doc_id) GROUP BY said.doc_id)
SELECT *, CAST(least(100, least(5 * categories, 30) + least(5 * (doc_id % 7), 25) + least(3 * technical, 25) + least(4 * soft, 20)) AS BIGINT) AS score FROM p"""


def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document by section; a line of at most three words starts one."""
    from pyspark.sql.window import Window as W

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    head = F.size(F.split(F.trim("line"), r"\s+")) <= 3
    w = W.partitionBy("doc_id").orderBy("at")
    numbered = lines.withColumn("head", head).withColumn("section", F.sum(F.col("head").cast("int")).over(w))
    return numbered.groupBy("doc_id", "section").agg(F.max(F.when(F.col("head"), F.lower(F.trim("line")))).alias("title"), F.count_if(~F.col("head")).alias("lines"), F.sum(F.when(~F.col("head"), F.length("line")).otherwise(0)).alias("chars"))


SECTIONS = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
h AS (SELECT *, len(regexp_split_to_array(trim(line), '\\s+')) <= 3 AS head FROM l), n AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
SELECT doc_id, CAST(section AS BIGINT) AS section, max(CASE WHEN head THEN lower(trim(line)) END) AS title, count(*) FILTER (NOT head) AS lines, CAST(sum(CASE WHEN head THEN 0 ELSE length(line) END) AS BIGINT) AS chars FROM n GROUP BY doc_id, section"""


def normalize_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job fields written as people write them, read back: place, pay, dates and lists."""
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("o_orderkey")
    place = F.when(k % 3 == 0, F.concat("n_name", F.lit(", "), F.col("r_name"))).when(k % 3 == 1, F.concat("n_name", F.lit(" "), F.col("r_name"))).otherwise("")
    low = F.floor("o_totalprice").cast("string")
    pay = F.when(k % 4 == 0, F.concat(F.lit("$"), low, F.lit(" - "), F.floor(F.col("o_totalprice") * 2).cast("string"))).when(k % 4 == 1, low).when(k % 4 == 2, "n/a").otherwise("open")
    date = F.when(k % 3 == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(k % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise("soon")
    spot, money = nz.location(place), nz.salary_bounds(pay)
    terms = nz.unique_terms(F.array(F.col("c_mktsegment"), F.lower("c_mktsegment"), F.lit(" "), F.col("o_orderpriority")))
    return j.select(
        k.alias("job_id"), spot["city"].alias("city"), spot["state"].alias("state"), spot["country"].alias("country"), money["low"].alias("low"), money["high"].alias("high"),
        nz.date_field(date).alias("posted"), nz.boolean_field(F.when(k % 2 == 0, " Yes ").otherwise("no")).alias("flag"), F.array_join(terms, "|").alias("terms"),
        nz.safe_int(F.when(k % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("x"), -1).alias("amount"), nz.value_map(F.col("o_orderstatus"), {"f": "full_time", "p": "part_time"}, "contract").alias("kind"),
    )


NORMALIZE = """WITH j AS (SELECT o_orderkey AS k, n_name, r_name, o_totalprice AS p, o_orderdate AS d, c_mktsegment AS m, o_orderpriority AS pr, o_orderstatus AS s FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT *, string_split(n_name || ' ' || r_name, ' ') AS ws FROM j)
SELECT k AS job_id, CASE k % 3 WHEN 0 THEN n_name WHEN 1 THEN array_to_string(ws[1:len(ws) - 1], ' ') ELSE 'Unknown' END AS city, CASE k % 3 WHEN 0 THEN r_name WHEN 1 THEN ws[-1] ELSE 'Unknown' END AS state, 'USA' AS country,
CASE WHEN k % 4 IN (0, 1) AND floor(p) >= 1 THEN CAST(floor(p) AS INTEGER) END AS low, CASE WHEN k % 4 = 0 AND floor(p * 2) >= 1 THEN CAST(floor(p * 2) AS INTEGER) WHEN k % 4 = 1 AND floor(p) >= 1 THEN CAST(floor(p) AS INTEGER) END AS high,
CASE WHEN k % 3 IN (0, 1) THEN CAST(d AS DATE) END AS posted, k % 2 = 0 AS flag, m || '|' || pr AS terms, CASE WHEN k % 2 = 0 THEN CAST(trunc(p) AS INTEGER) ELSE -1 END AS amount, CASE s WHEN 'F' THEN 'full_time' WHEN 'P' THEN 'part_time' ELSE 'contract' END AS kind FROM w"""

QUERIES = {
    "hard_constraints": (hard_constraints, CONSTRAINTS),
    "contact_extract": (contact_extract, CONTACTS),
    "skill_extract": (skill_extract, SKILLS),
    "query_keywords": (query_keywords, KEYWORDS),
    "skill_categories": (skill_categories, CATEGORIES),
    "marketability": (marketability, MARKETABILITY),
    "section_split": (section_split, SECTIONS),
    "normalize_fields": (normalize_fields, NORMALIZE),
}

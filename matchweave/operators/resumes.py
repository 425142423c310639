"""Resume texts to profiles. Lines are numbered once and entries are told apart by a running
count of their first lines, so nothing is parsed row by row in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx

# Words that start an entry, and words that a name line does not hold.
ROLE_WORDS = ("engineer", "developer", "analyst", "manager", "director", "consultant", "specialist", "coordinator", "assistant", "intern", "volunteer", "freelance", "contract")
EDUCATION = r"(?i)(education|academic|degree|university|college|school|bachelor|master|phd|doctorate|associate|certificate)"
LEADERSHIP = ("manager", "director", "lead", "senior", "principal", "architect")
NOT_NAMES = r"(?i)\b(resume|cv|curriculum|vitae|profile|summary|objective|experience|education|skills|contact|phone|email|address)\b"
TECHNICAL = ("programming_languages", "frameworks", "databases")
ADVICE = (
    ("no_summary", "add a summary"),
    ("few_skills", "name more technical skills"),
    ("no_education", "add education"),
    ("no_language", "name programming languages"),
    ("no_soft_skill", "name soft skills"),
)


def lines(texts: DataFrame) -> DataFrame:
    """(resume_id, at, line) of non-blank trimmed lines."""
    parts = texts.select("resume_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))
    return parts.withColumn("line", F.trim("line")).where("line != ''")


def _entries(numbered: DataFrame, starts: Column) -> DataFrame:
    w = W.partitionBy("resume_id").orderBy("at")
    return numbered.withColumn("first", starts).withColumn("entry", F.sum(F.col("first").cast("int")).over(w)).where("entry > 0")


def _has_word(line: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower(line), F.lit(w))
    return hit


def experience(numbered: DataFrame) -> DataFrame:
    """(resume_id, entry, title, description): a line with a role word starts an entry."""
    e = _entries(numbered, _has_word(F.col("line"), ROLE_WORDS))
    rest = F.transform(F.array_sort(F.collect_list(F.when(~F.col("first"), F.struct("at", "line")))), lambda x: x["line"])
    return e.groupBy("resume_id", "entry").agg(F.max(F.when(F.col("first"), F.col("line"))).alias("title"), F.nullif(F.array_join(rest, " "), F.lit("")).alias("description"))


def education(numbered: DataFrame) -> DataFrame:
    """(resume_id, entry, institution, degree, description): the next line is the degree, the last
    further one the description."""
    e = _entries(numbered, F.col("line").rlike(EDUCATION))
    rest = F.transform(F.array_sort(F.collect_list(F.when(~F.col("first"), F.struct("at", "line")))), lambda x: x["line"])
    out = e.groupBy("resume_id", "entry").agg(F.max(F.when(F.col("first"), F.col("line"))).alias("institution"), rest.alias("rest"))
    return out.select("resume_id", "entry", "institution", F.get("rest", F.lit(0)).alias("degree"), F.when(F.size("rest") > 1, F.element_at("rest", -1)).alias("description"))


def names(numbered: DataFrame) -> DataFrame:
    """(resume_id, name): the first of the top five lines that is two to four capitalised words and
    no header or contact line, else any such line, else 'Name Not Found'."""
    w = W.partitionBy("resume_id").orderBy("at")
    n = numbered.withColumn("n", F.row_number().over(w))
    clean = F.trim(F.regexp_replace("line", r"(?i)^(name|mr\.?|mrs\.?|ms\.?|dr\.?)\s*:?\s+|,?\s+(jr\.?|sr\.?|phd|md)$", ""))
    ok = clean.rlike(r"^[A-ZÀ-Ý][\p{L}'.-]+( [A-ZÀ-Ý][\p{L}'.-]+){1,3}$") & ~F.col("line").rlike(NOT_NAMES) & ~F.col("line").rlike("@|[0-9]{3}") & (F.length("line") <= 50)
    order = F.struct(F.when(F.col("n") <= 5, 1).otherwise(2).alias("s"), F.col("n"))
    found = n.groupBy("resume_id").agg(F.min_by(F.when(ok, clean), F.when(ok, order)).alias("name"))
    return found.select("resume_id", F.coalesce("name", F.lit("Name Not Found")).alias("name"))


def profiles(texts: DataFrame) -> DataFrame:
    """One profile per resume: name, contacts (null where there are none), skills by category,
    entries, leadership roles, market score and advice."""
    numbered = lines(texts)
    jobs = experience(numbered).groupBy("resume_id").agg(F.array_sort(F.collect_list(F.struct("entry", "title", "description"))).alias("experience"))
    schools = education(numbered).groupBy("resume_id").agg(F.array_sort(F.collect_list(F.struct("entry", "institution", "degree", "description"))).alias("education"))
    out = texts.join(names(numbered), "resume_id", "left").join(jobs, "resume_id", "left").join(schools, "resume_id", "left")
    out = out.withColumns({"skills": tx.skills(F.col("text")), "name": F.coalesce("name", F.lit("Name Not Found"))})
    pairs = F.transform("skills", lambda s: F.struct(tx.category(s).alias("c"), s.alias("s")))
    count = lambda cs: F.size(F.filter(pairs, lambda p: p["c"].isin(*cs)))
    entries, titles = F.coalesce(F.size("experience"), F.lit(0)), F.transform("experience", lambda e: e["title"])
    kinds = F.size(F.array_distinct(F.transform(pairs, lambda p: p["c"])))
    lacks = {"no_summary": F.coalesce(F.trim("text"), F.lit("")) == "", "few_skills": F.size("skills") < 5, "no_education": F.col("education").isNull(), "no_language": count(("programming_languages",)) == 0, "no_soft_skill": count(("soft_skills",)) == 0}
    summary = F.transform("experience", lambda e: F.concat(e["title"], F.coalesce(F.concat(F.lit(" - "), F.substring(e["description"], 1, 100), F.lit("...")), F.lit(""))))
    return out.select(
        "resume_id", "name", F.get(tx.emails(F.col("text")), F.lit(0)).alias("email"), F.get(tx.phones(F.col("text")), F.lit(0)).alias("phone"), "skills", "experience", "education",
        F.coalesce(F.array_join(summary, " | "), F.lit("No work experience found in resume.")).alias("experience_summary"),
        F.coalesce(F.filter(titles, lambda t: _has_word(t, LEADERSHIP)), F.array().cast("array<string>")).alias("leadership"), (entries > 1).alias("has_progression"),
        tx.marketability(kinds, entries, count(TECHNICAL), count(("soft_skills",))).alias("market_score"),
        F.filter(F.array(*[F.when(lacks[k], F.lit(a)) for k, a in ADVICE]), lambda x: x.isNotNull()).alias("advice"),
    )


def as_queries(profile: DataFrame) -> DataFrame:
    """Search queries of profiles (candidate_id, summary, skills, titles, degrees, years): text,
    level, least pay, five required and five preferred skills."""
    none = F.array().cast("array<string>")
    list_ = lambda c: F.coalesce(F.col(c), none)
    level = F.when(F.col("years") >= 5, "senior").when(F.col("years") >= 2, "mid").otherwise("entry")
    return profile.select(
        F.col("candidate_id").alias("query_id"),
        F.concat_ws(" ", F.nullif("summary", F.lit("")), F.nullif(F.array_join(list_("skills"), " "), F.lit("")), F.slice(list_("titles"), 1, 3), F.slice(list_("degrees"), 1, 2)).alias("text"),
        level.alias("level"), F.when(level == "senior", 80000).when(level == "mid", 60000).otherwise(40000).alias("min_salary"),
        F.slice(list_("skills"), 1, 5).alias("required_skills"), F.slice(list_("skills"), 6, 5).alias("preferred_skills"),
    )


def enriched(queries: DataFrame, related: DataFrame, stated: str | None = None) -> DataFrame:
    """Queries (query_id, text) with their skills, the skills related to those, and all of them; with
    ``stated``, an array of skills that the query names besides its text."""
    said = tx.skills(F.col("text"))
    named = queries.withColumn("skills", said if stated is None else F.array_union(said, F.transform(stated, lambda s: F.lower(s))))
    near = named.select("query_id", F.explode("skills").alias("src")).join(related.withColumn("src", F.lower("src")), "src").groupBy("query_id").agg(F.array_sort(F.collect_set("dst")).alias("related"))
    none = F.array().cast("array<string>")
    return named.join(near, "query_id", "left").withColumn("related", F.coalesce("related", none)).withColumn("all_skills", F.array_union("skills", "related"))


def external_scores(rows: DataFrame, factors: tuple[str, ...] = ("skill", "experience", "location", "salary", "semantic", "company")) -> DataFrame:
    """Scores that another service answered as JSON text (in a code fence or not): each factor
    between 0 and 1, 0.5 where it is missing or no number."""
    body = F.regexp_replace(F.coalesce("answer", F.lit("")), r"^\s*```(?:json)?|```\s*$", "")
    parsed = F.from_json(body, "map<string, string>")
    number = lambda f: F.try_element_at(parsed, F.lit(f)).try_cast("double")
    value = lambda f: F.when(number(f).isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number(f))))
    return rows.select("query_id", "job_id", *[value(f).alias(f) for f in factors])

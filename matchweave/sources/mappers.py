"""Landed job feeds and CSV exports mapped to one job or profile form by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import normalize as nz

# Code tables of the feeds.
CITY_TYPES = {"f": "full_time", "full-time": "full_time", "full time": "full_time", "p": "part_time", "part-time": "part_time", "part time": "part_time", "t": "contract", "c": "contract", "intern": "internship"}
CITY_LEVELS = (("entry", ("entry", "intern")), ("executive", ("executive", "director")), ("senior", ("senior", "manager")))
PERIODS = {"annual": "yearly", "year": "yearly", "hourly": "hourly", "daily": "daily"}
BOROUGHS = (("brooklyn", "Brooklyn"), ("queens", "Queens"), ("bronx", "Bronx"), ("staten island", "Staten Island"), ("manhattan", "New York"))
BOARD_TYPES = {"full-time": "full_time", "part-time": "part_time", "contract": "contract", "internship": "internship"}
BOARD_LEVELS = {"entry-level": "entry", "mid-level": "mid", "senior-level": "senior", "executive": "executive"}
BENEFITS = (("health", ("health", "medical", "dental", "vision")), ("retirement", ("retirement", "401k", "pension")), ("time_off", ("time", "vacation", "holiday", "leave")), ("insurance", ("life", "disability", "insurance")))
NETWORK_TYPES = {"full_time": "full_time", "part_time": "part_time", "contract": "contract", "internship": "internship", "temporary": "contract"}
NETWORK_LEVELS = {"entry_level": "entry", "associate": "entry", "mid_senior_level": "mid", "senior_level": "senior", "executive": "senior", "director": "senior"}
CITY_SKILLS = {
    "react": ("react", "react.js", "reactjs"), "javascript": ("javascript", "js", "ecmascript"), "python": ("python",), "sql": ("sql", "structured query language"),
    "data-engineering": ("data engineering", "etl", "data pipeline", "data integration"), "project-management": ("project management", "pmp", "agile", "scrum", "ms project"),
    "procurement": ("procurement", "purchasing", "sourcing", "supply management"), "contract-management": ("contract management", "contract administration", "negotiation"),
    "operations-analytics": ("data analysis", "analytics", "insights", "reporting"), "power-bi": ("power bi", "power-bi"), "tableau": ("tableau",), "excel": ("excel", "microsoft excel", "spreadsheets"),
    "aws": ("aws", "amazon web services"), "gis": ("gis", "geographic information system"), "arcgis": ("arcgis", "arcmap", "arc-pro", "arc pro"), "autocad": ("autocad", "civil 3d", "cad"),
    "public-health": ("public health", "epidemiology", "health promotion"), "osha": ("osha", "occupational safety", "safety compliance"), "social-work": ("social work", "case manager", "lcsw"),
    "customer-service": ("customer service", "constituent services", "call center"), "bilingual-spanish": ("bilingual spanish", "spanish speaking", "spanish fluency"),
}

CITY_SCHEMA = "job_id string, business_title string, civil_service_title string, agency string, work_location string, work_location_1 string, full_time_part_time_indicator string, career_level string, salary_range_from string, salary_range_to string, salary_frequency string, posting_date string, posting_updated string, post_until string, process_date string, preferred_skills string, minimum_qual_requirements string, job_description string, additional_information string, to_apply string, residency_requirement string"
BOARD_SCHEMA = "_id string, title string, owner struct<companyName: string, benefits: struct<benefits: array<string>>>, locationAddress string, locationCoordinates struct<lat: double, lon: double>, employmentType string, seniority string, salaryRangeMinYearly int, salaryRangeMaxYearly int, skillRequirements array<string>, skills_suggest array<string>, descriptionBreakdown struct<oneSentenceJobSummary: string>, workModel string, createdAt string, url string, applyUrl string"
NETWORK_SCHEMA = "entityUrn string, title string, description string, companyName string, location string, employmentType string, experienceLevel string, salary struct<start: int, end: int, currency: string>, jobPostingUrl string, applyUrl string"


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(text, F.lit(w))
    return hit


def keyword_map(text: Column, table: tuple, default: str) -> Column:
    out = None
    for value, words in table:
        hit = contains_any(F.lower(F.coalesce(text, F.lit(""))), words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def clue_skills(text: Column, clues: dict[str, tuple[str, ...]] = CITY_SKILLS) -> Column:
    """Sorted canonical skills with a clue inside the lower-case text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array_sort(F.filter(F.array(*[F.when(contains_any(t, words), F.lit(name)) for name, words in clues.items()]), lambda x: x.isNotNull()))


def iso_time(text: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS][XXX]")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def salary_struct(low: Column, high: Column, period: Column) -> Column:
    return F.when((F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0), F.struct(low.alias("min_salary"), high.alias("max_salary"), F.lit("USD").alias("currency"), period.alias("period")))


def city_jobs(rows: DataFrame) -> DataFrame:
    """Jobs of a city's open data."""
    c = F.col
    title = nz.first_text(c("business_title"), c("civil_service_title"), F.lit("NYC Job Opening"))
    fallback = F.concat(F.lower(F.regexp_replace(F.coalesce("business_title", F.lit("nyc_job")), " ", "_")), F.lit("_"), F.coalesce("process_date", F.lit("")))
    ident = F.coalesce(F.nullif("job_id", F.lit("")), fallback)
    text = F.concat_ws("\n\n", F.nullif("job_description", F.lit("")), nz.sections(Minimum_Qualifications=F.coalesce("minimum_qual_requirements", F.lit("")), Preferred_Skills=F.coalesce("preferred_skills", F.lit("")), Additional_Information=F.coalesce("additional_information", F.lit("")), To_Apply=F.coalesce("to_apply", F.lit(""))))
    place = F.lower(F.coalesce("work_location_1", "work_location", F.lit("New York, NY")))
    city = None
    for word, name in BOROUGHS:
        city = F.when(F.contains(place, F.lit(word)), name) if city is None else city.when(F.contains(place, F.lit(word)), name)
    source = F.concat(F.lit("https://cityjobs.nyc.gov/jobsearch.html?job_id="), ident)
    residency = F.struct(F.lit("Residency Requirement").alias("name"), c("residency_requirement").alias("description"), F.lit("eligibility").alias("category"))
    return rows.select(
        F.concat(F.lit("nyc_"), ident).alias("job_id"), title.alias("title"), text.alias("description"), F.trim(F.coalesce("agency", F.lit("City of New York"))).alias("company"),
        F.struct(city.otherwise("New York").alias("city"), F.lit("NY").alias("state"), F.lit("USA").alias("country")).alias("location"),
        nz.value_map(F.coalesce("full_time_part_time_indicator", F.lit("")), CITY_TYPES, "full_time").alias("job_type"), keyword_map(c("career_level"), CITY_LEVELS, "mid").alias("experience_level"),
        salary_struct(c("salary_range_from").try_cast("double").cast("int"), c("salary_range_to").try_cast("double").cast("int"), nz.value_map(F.coalesce("salary_frequency", F.lit("annual")), PERIODS, "yearly")).alias("salary"),
        clue_skills(F.concat_ws(" ", "job_description", "preferred_skills", "minimum_qual_requirements", "additional_information")).alias("required_skills"),
        *[nz.split_terms(c(a), r"[\n;\r•]+").alias(b) for a, b in (("preferred_skills", "preferred_skills"), ("job_description", "responsibilities"), ("minimum_qual_requirements", "requirements"))],
        F.when(F.coalesce("residency_requirement", F.lit("")) != "", F.array(residency)).otherwise(F.array().cast("array<struct<name:string,description:string,category:string>>")).alias("benefits"),
        iso_time(F.coalesce("posting_date", "posting_updated")).alias("posted_date"), iso_time(c("post_until")).alias("application_deadline"),
        contains_any(F.lower(text), ("remote", "hybrid")).alias("remote_allowed"), F.contains(F.lower(text), F.lit("visa sponsorship")).alias("visa_sponsorship"),
        source.alias("source_url"), F.when(F.trim(F.coalesce("to_apply", F.lit(""))).rlike("^(https?://|www\\.)"), F.trim("to_apply")).otherwise(source).alias("apply_url"),
    )


def board_jobs(rows: DataFrame) -> DataFrame:
    """Jobs of a board's API: required skills are the stated and the suggested ones."""
    c = F.col
    none = F.array().cast("array<string>")
    parts = F.split(F.coalesce("locationAddress", F.lit("")), ", ")
    skills = F.array_sort(F.array_distinct(F.concat(F.coalesce("skillRequirements", none), F.coalesce("skills_suggest", none))))
    named = F.filter(F.coalesce("owner.benefits.benefits", none), lambda x: x.isNotNull() & (x != ""))
    return rows.select(
        c("_id").alias("job_id"), c("title"), F.coalesce("owner.companyName", F.lit("Unknown Company")).alias("company"), F.coalesce("descriptionBreakdown.oneSentenceJobSummary", F.lit("")).alias("description"),
        F.struct(parts[0].alias("city"), F.coalesce(F.get(parts, F.lit(1)), F.lit("Unknown")).alias("state"), F.lit("USA").alias("country"), c("locationCoordinates.lat").alias("latitude"), c("locationCoordinates.lon").alias("longitude")).alias("location"),
        nz.value_map(F.coalesce("employmentType", F.lit("full-time")), BOARD_TYPES, "full_time").alias("job_type"), nz.value_map(F.coalesce("seniority", F.lit("mid-level")), BOARD_LEVELS, "mid").alias("experience_level"),
        salary_struct(c("salaryRangeMinYearly"), c("salaryRangeMaxYearly"), F.lit("yearly")).alias("salary"), F.transform(named, lambda x: F.struct(x.alias("name"), keyword_map(x, BENEFITS, "other").alias("category"))).alias("benefits"),
        skills.alias("required_skills"), F.coalesce("skillRequirements", none).alias("requirements"), F.lower(F.coalesce("workModel", F.lit("onsite"))).isin("remote", "hybrid").alias("remote_allowed"), F.lit(False).alias("visa_sponsorship"),
        iso_time(c("createdAt")).alias("posted_date"), c("url").alias("source_url"), F.coalesce("applyUrl", "url").alias("apply_url"),
    )


def network_jobs(rows: DataFrame) -> DataFrame:
    """Jobs of a professional network: the id is the last part of the URN."""
    c = F.col
    return rows.select(
        F.element_at(F.split("entityUrn", ":"), -1).alias("job_id"), c("title"), c("description"), c("companyName").alias("company"), nz.location(c("location")).alias("location"),
        nz.value_map(F.coalesce("employmentType", F.lit("")), NETWORK_TYPES, "full_time").alias("job_type"), nz.value_map(F.coalesce("experienceLevel", F.lit("")), NETWORK_LEVELS, "mid").alias("experience_level"),
        F.when(c("salary").isNotNull(), F.struct(F.coalesce("salary.start", F.lit(0)).alias("min_salary"), F.coalesce("salary.end", F.lit(0)).alias("max_salary"), F.coalesce("salary.currency", F.lit("USD")).alias("currency"), F.lit("yearly").alias("period"))).alias("salary"),
        nz.dictionary_skills(c("description")).alias("required_skills"), F.contains(F.lower("description"), F.lit("remote")).alias("remote_allowed"), F.lit(False).alias("visa_sponsorship"), c("jobPostingUrl").alias("source_url"), F.coalesce("applyUrl", "jobPostingUrl").alias("apply_url"),
    )


def accepted(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs with an id and a title, and the rejects."""
    ok = (F.coalesce("job_id", F.lit("")) != "") & (F.trim(F.coalesce("title", F.lit(""))) != "")
    return jobs.where(ok), jobs.where(~ok)


def employer_jobs(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """Jobs of an employer's CSV, joined to the title dictionary (small: Spark broadcasts it by its
    size). Missing or repeated ids fail the job; three skill lists become one."""
    bad = rows.groupBy("job_id").agg(F.count("*").alias("n")).where(F.col("job_id").isNull() | (F.trim("job_id") == "") | (F.col("n") > 1)).limit(1).count()
    if bad:
        raise ValueError("missing or repeated job_id")
    skills = nz.unique_terms(F.concat(*[nz.split_terms(F.col(c), ";") for c in ("skills", "traditional_skills", "new_skills")]))
    joined = rows.join(titles.select(F.col("standard_job_title").alias("standard_job"), F.col("standard_category").alias("job_family")).dropDuplicates(["standard_job"]), "standard_job", "left")
    text = nz.sections(responsibilities=F.coalesce("job_responsibility", F.lit("")), requirements=F.coalesce("job_requirement", F.lit("")), details=F.coalesce("detailed", F.lit("")))
    return joined.select("job_id", F.col("job_title").alias("title"), "standard_job", "job_family", text.alias("description"), skills.alias("skills"), nz.date_field(F.col("publish_time")).alias("posted"), nz.content_hash(job_id=F.col("job_id"), text=text).alias("content_hash"))


def silver_jobs(rows: DataFrame) -> DataFrame:
    """One job per id from label rows: its most common family, its skills by votes, its first text."""
    family = rows.groupBy("job_id", "target_job_family").agg(F.count("*").alias("n")).groupBy("job_id").agg(F.max_by("target_job_family", F.struct("n", F.col("target_job_family"))).alias("job_family"))
    votes = rows.select("job_id", F.explode_outer("matched_skills").alias("s")).groupBy("job_id", "s").agg(F.count("*").alias("n"))
    skills = votes.groupBy("job_id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("s").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("s").alias("s"))))), lambda x: x["s"]).alias("skills"))
    text = rows.withColumn("_r", F.row_number().over(W.partitionBy("job_id").orderBy("resume_id"))).where("_r = 1").select("job_id", F.col("job_title").alias("title"), F.col("job_description").alias("description"), F.col("company_name").alias("company"), "location")
    return text.join(family, "job_id").join(skills, "job_id")


def label_pairs(rows: DataFrame, source: str) -> DataFrame:
    """Label rows in the pair contract."""
    return rows.select(F.concat_ws("::", "resume_id", "job_id").alias("pair_key"), F.col("resume_id").alias("candidate_id"), "job_id", "grade", F.lit(source).alias("label_source"))


def profiles(rows: DataFrame) -> DataFrame:
    """Profiles of a resume CSV; name, phone and e-mail columns are not carried over."""
    skill = "array<struct<name: string, level: string, category: string>>"
    empty = F.from_json(F.lit("[]"), skill)
    return rows.select(F.col("resume_id").alias("candidate_id"), F.col("profile_text").alias("summary"), nz.json_field(F.col("skills_normalized"), skill, empty).alias("skills"), "target_job_family", "preferred_location", F.struct("education", "degree", "major").alias("education"), nz.safe_int(F.col("years_experience")).alias("years_experience"))


"""Posting texts to sections, and sections to requirements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text as tx

# What makes a line a header.
HEADERS = (
    r"(requirements?|qualifications?|skills?|must have)",
    r"(responsibilities?|duties?|what you'll do)",
    r"(benefits?|perks?|compensation)",
    r"(location|where|office)",
    r"(salary|compensation|pay|wage)",
    r"(about us|company|who we are)",
    r"(experience|years?|level)",
    r"(education|degree|certification)",
)
HEADER = "(?i)" + "|".join(HEADERS)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sections(texts: DataFrame) -> DataFrame:
    """(job_id, section, content) of (job_id, text): a line with a header word names the section of
    the lines after it, those before the first are 'general'. Of sections of one name the last
    that has lines stays."""
    lines = texts.select("job_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line")).withColumn("line", strip(F.col("line"))).where("line != ''")
    head = F.col("line").rlike(HEADER)
    numbered = lines.withColumn("head", head).withColumn("n", F.sum(F.col("head").cast("int")).over(W.partitionBy("job_id").orderBy("at")))
    body = F.transform(F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("at", "line")))), lambda x: x["line"])
    parts = numbered.groupBy("job_id", "n").agg(F.coalesce(F.max(F.when(F.col("head"), F.lower("line"))), F.lit("general")).alias("section"), F.array_join(body, "\n").alias("content"))
    return parts.where("content != ''").groupBy("job_id", "section").agg(F.max_by("content", "n").alias("content"), F.max("n").alias("n"))


def requirements(found: DataFrame) -> DataFrame:
    """Per job: required and preferred skills (sorted, each once), how many texts tell of
    qualifications, responsibilities and benefits, and the last on location and salary. A section
    counts for the first of these that its name speaks of."""
    s = F.col("section")
    says = lambda *words: s.rlike("|".join(words))
    kind = F.when(says("requirement", "qualification"), "qualifications").when(says("responsibilit"), "responsibilities").when(says("benefit"), "benefits").when(says("location"), "location").when(says("salary", "compensation"), "salary")
    rows = found.withColumns({"kind": kind, "skills": tx.skills(F.col("content"))})
    q = F.col("kind") == "qualifications"
    some = lambda test: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(test, F.col("skills"))))))
    last = lambda k: F.max_by(F.when(F.col("kind") == k, F.col("content")), F.when(F.col("kind") == k, F.col("n")))
    return rows.groupBy("job_id").agg(
        some(q & F.contains(s, F.lit("required"))).alias("required_skills"), some(q & ~F.contains(s, F.lit("required"))).alias("preferred_skills"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("qualifications", "responsibilities", "benefits")], last("location").alias("location"), last("salary").alias("salary"),
    )

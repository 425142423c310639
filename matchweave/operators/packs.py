"""Texts to index and label, previews, sample packs and manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.normalize import unique_terms


def as_text(column: Column, kind: T.DataType) -> Column:
    """A nested value as one string, its parts joined by spaces."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.transform(column, lambda x: as_text(x, kind.elementType)), " ")
    if isinstance(kind, T.StructType):
        return F.concat_ws(" ", *[as_text(column[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, T.MapType):
        return F.array_join(F.array_sort(F.map_values(F.transform_values(column, lambda _, v: v.cast("string")))), " ")
    return F.coalesce(column.cast("string"), F.lit(""))


def row_text(df: DataFrame, *columns: str) -> Column:
    """The named columns that exist, in order, as one text; blank ones are left out."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    parts = [F.nullif(F.trim(as_text(F.col(c), kinds[c])), F.lit("")) for c in columns if c in kinds]
    return F.concat_ws(" ", *parts)


def query_text(family: Column, skills: Column, roles: Column, major: Column, years: Column) -> Column:
    """Target family, up to 30 skills, roles, major and years as a search text."""
    return F.concat_ws(" ", family, F.slice(unique_terms(skills), 1, 30), unique_terms(roles), major, F.when(years > 0, F.concat(years, F.lit("年经验"))))


def preview(text: Column, letters: int = 500) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, letters)


def candidate_ids(batches: DataFrame) -> DataFrame:
    """(query_id, job_id) of rows whose ids stand in one of three columns, each once."""
    none = F.array().cast("array<string>")
    there = [F.col(c) for c in ("job_ids", "candidate_ids", "ids") if c in batches.columns]
    return batches.select("query_id", F.explode(F.array_distinct(F.coalesce(*there, none))).alias("job_id"))


def sample_pack(people: DataFrame, jobs: DataFrame, labels: DataFrame, n_people: int = 5, n_jobs: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The first people, jobs of their labels (gold first) filled up with others, and the labels
    between them. Labels: candidate_id, job_id, label_source."""
    some = people.orderBy("candidate_id").limit(n_people)
    mine = labels.join(some.select("candidate_id"), "candidate_id", "left_semi")
    order = mine.groupBy("job_id").agg(F.min(F.when(F.col("label_source") == "gold", 0).otherwise(1)).alias("o"))
    chosen = jobs.join(order, "job_id", "left").orderBy(F.coalesce("o", F.lit(2)), "job_id").limit(n_jobs).drop("o")
    return some, chosen, mine.join(chosen.select("job_id"), "job_id", "left_semi")


def manifest(**tables: DataFrame) -> DataFrame:
    """(table, rows): how many rows each table has."""
    parts = None
    for name, df in tables.items():
        part = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def distribution(df: DataFrame, *columns: str) -> DataFrame:
    """(field, value, n): counts of the values of some columns."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    return long.groupBy("x.field", "x.value").agg(F.count("*").alias("n"))


def newest(df: DataFrame, key: str, stamp: str, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc(stamp), F.to_json(F.struct(*sorted(df.columns)))))).where(F.col("rank") <= k)


def compact_job(jobs: DataFrame) -> DataFrame:
    """Jobs trimmed to what a labeller reads: the first 500 characters of what they are about. Columns
    that are not there are taken as missing."""
    none, no_skills = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    some = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in jobs.columns], none, F.lit(""))
    lists = [F.when(F.size(n) > 0, F.col(n)) for n in ("skills", "required_skills") if n in jobs.columns]
    return jobs.select(
        "job_id", some("title", "standard_job").alias("title"), some("company", "company_name").alias("company"), some("job_family").alias("job_family"),
        F.coalesce(*lists, no_skills, F.array().cast("array<string>")).alias("skills"), F.substring(some("description", "requirements"), 1, 500).alias("description_preview"),
    )


def candidate_snapshot(candidates: DataFrame) -> DataFrame:
    """(candidate_id, snapshot): what a labeller sees of a candidate; 800 characters of the summary."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    parts = F.substring(F.coalesce("summary", F.lit("")), 1, 800).alias("summary"), F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), blank("target_job_family"), blank("preferred_location")
    return candidates.select("candidate_id", F.struct(*parts).alias("snapshot"))

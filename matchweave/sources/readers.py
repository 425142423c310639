"""Readers and writers of the job and profile formats. Schemas are given, never inferred."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import normalize as nz
from .shared import written

ENCODINGS = ("utf-8", "gb18030")
JOB_ALIASES = {
    "title": ("title", "job_title", "position", "role", "position_title", "Position Title", "job_name", "position_name", "job"),
    "company": ("company", "company_name", "Company", "employer", "organization", "employer_name", "hiring_company", "recruiter"),
    "location": ("location", "Location", "job_location", "city", "place"),
    "salary": ("salary", "Salary", "salary_range", "compensation", "pay"),
    "description": ("description", "job_description", "summary", "details", "qualifications", "Qualifications", "requirements", "job_summary", "overview", "responsibilities"),
    "skills": ("skills", "required_skills", "preferred_skills", "technologies", "tech_stack", "programming_languages", "languages", "tools", "frameworks", "technologies_required", "technical_skills", "competencies", "expertise"),
    "work_model": ("work_model", "Work Model", "work_type", "employment_type", "work_arrangement", "location_type", "remote", "work_location"),
    "visa": ("visa_sponsorship", "sponsor_visa", "h1b", "h1b_sponsored", "H1b Sponsored", "visa_support", "immigration_support"),
    "url": ("url", "source_url", "link", "job_url", "apply_url", "application_url", "Apply"),
}


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, line, quotes, utf8): the lines of files as they are in bytes, in any encoding that
    writes line ends and quotes as ASCII does; block and at give their order. Written, so that the
    order holds and files are read once; a large file is read by many tasks."""
    lines = spark.read.option("lineSep", "\n").text(path)
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    return written(lines.select(*place, F.col("value").cast("binary").alias("line"), quotes.cast("long").alias("quotes"), F.is_valid_utf8("value").alias("utf8")), "lines")


def csv_encodings(lines: DataFrame) -> dict[str, str]:
    """File -> encoding, by all bytes of each file: UTF-8 unless a line does not decode so."""
    files = lines.groupBy("file").agg(F.min("utf8").alias("utf8")).collect()  # a row per file
    return {r["file"]: ENCODINGS[0] if r["utf8"] else ENCODINGS[1] for r in files}


def csv_records(lines: DataFrame) -> DataFrame:
    """(file, block, at, record): lines joined where a quoted field goes over their ends.

    A line begins a record if the quotes before it are even in number. They are counted in blocks,
    the counts of a file's blocks are added up, and only lines of records that have several are
    brought together; so a file is not read in order, and no task needs it whole."""
    by_block, by_file = W.partitionBy("file", "block").orderBy("at"), W.partitionBy("file").orderBy("block")
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"))
    before = written(blocks.select("file", "block", (F.sum("q").over(by_file) - F.col("q")).alias("before")), "blocks")
    seen = F.sum("quotes").over(by_block) - F.col("quotes")
    told = lines.join(before, ["file", "block"]).withColumn("starts", (F.col("before") + seen) % 2 == 0)
    told = written(told.select("file", "block", "at", "line", "starts", (F.col("quotes") % 2 == 1).alias("odd")), "starts")
    place = F.struct("block", "at")
    # the last start of the blocks before
    lasts = told.where("starts").groupBy("file", "block").agg(F.max(place).alias("last"))
    ends = before.select("file", "block").join(lasts, ["file", "block"], "left")
    carried = written(ends.select("file", "block", F.last("last", ignorenulls=True).over(by_file.rowsBetween(W.unboundedPreceding, -1)).alias("carried")), "carried")
    alone = told.where("starts and not odd").select("file", "block", "at", F.col("line").alias("record"))
    # of the others: the start that they belong to
    open_ = told.where("not starts or odd").join(carried, ["file", "block"])
    own = F.last(F.when(F.col("starts"), place), ignorenulls=True).over(by_block)
    joined = open_.withColumn("key", F.coalesce(own, "carried")).groupBy("file", "key").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("all"))
    record = F.aggregate(F.slice("all", 2, F.size("all")), F.col("all")[0]["line"], lambda s, x: F.concat(s, F.lit(b"\n"), x["line"]))
    return alone.unionByName(joined.select("file", F.col("key.block").alias("block"), F.col("key.at").alias("at"), record.alias("record")))


def read_csv(spark: SparkSession, path: str, fields: bool = False) -> DataFrame:
    """All columns as text, with a header per file; quoted fields may span lines; a byte-order mark
    goes; empty fields are null, and empty lines no rows. Files are UTF-8 or, where they do not decode
    so, GB 18030; one that is in neither fails the job. Any file is read by as many tasks as it has
    blocks. With ``fields``, ``extra_fields`` tells how many more fields a row has than its header."""
    lines = raw_lines(spark, path)
    encodings = csv_encodings(lines)
    records = csv_records(lines)
    first = records.withColumn("_r", F.row_number().over(W.partitionBy("file").orderBy("block", "at"))).where("_r = 1")
    heads = {r["file"]: next(csv.reader(io.StringIO(bytes(r["record"]).decode(encodings[r["file"]]).lstrip("\ufeff"))), []) for r in first.select("file", "record").collect()}  # a row per file
    names = list(dict.fromkeys(n for f in sorted(heads, key=lambda f: (encodings[f] != ENCODINGS[0], f)) for n in heads[f]))
    if not names:
        return spark.createDataFrame([], "_empty string").drop("_empty")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, part in batch.groupby("file", sort=False):
                text = "\n".join(bytes(r).decode(encodings[file]).removesuffix("\r") for r in part["record"])
                rows = [dict(zip(heads[file], r)) for r in csv.reader(io.StringIO(text)) if r]
                made = pd.DataFrame([[r.get(n) or None for n in names] for r in rows], columns=names, dtype=object)
                if fields:
                    made["extra_fields"] = [len(r) - len(heads[file]) for r in csv.reader(io.StringIO(text)) if r]
                yield made

    body = records.join(first.select("file", "block", "at"), ["file", "block", "at"], "left_anti")
    return body.select("file", "record").mapInPandas(parse, ", ".join(f"`{n}` string" for n in names) + ", extra_fields int" * fields)


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """One object per line. ``strict`` fails on a bad line; else it is kept in _corrupt_record."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string")
    return reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects that span lines or stand back to back."""
    text = spark.read.text(path, wholetext=True)
    parts = F.split(F.regexp_replace("value", r"\}\s*\{", "}\u001e{"), "\u001e")
    return text.select(F.explode(parts).alias("j")).where(F.trim("j") != "").select(F.from_json("j", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list of objects, one object, or one object per line."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).first()
    lines = first is not None and first["value"].strip().startswith("{") and first["value"].strip().endswith("}")
    return spark.read.schema(schema).option("multiLine", not lines).json(path)


def read_resumes(spark: SparkSession, path: str) -> DataFrame:
    """(resume_id, text): a row per text file; Spark's readers skip files of no bytes."""
    return spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("resume_id"), F.col("value").alias("text"))


def flatten_rankings(batch: DataFrame) -> DataFrame:
    """Rows (query_id, results, candidates) of arrays of (query_id, job_id, score, rank) as flat
    rows; the parent's query_id counts where the child has none."""
    return batch.select(F.col("query_id").alias("_q"), F.inline_outer(F.coalesce("results", "candidates"))).withColumn("query_id", F.coalesce("query_id", "_q")).drop("_q").where("job_id is not null")


def jobs_from_csv(rows: DataFrame, remote: Column | None = None, level: Column | None = None) -> DataFrame:
    """Jobs of any CSV: columns by alias; rows without a title go. ``remote`` and ``level``, where
    not null, replace what the work model and the text say."""
    field = lambda k: nz.text_field(rows, *JOB_ALIASES[k])
    blank_to = lambda c, d: F.when(c == "", d).otherwise(c)
    title, description = field("title"), field("description")
    text = F.concat_ws(" ", title, blank_to(description, title))
    listed = F.concat_ws(",", *[F.col(f"`{c}`") for c in JOB_ALIASES["skills"] if c in rows.columns], F.lit(""))
    return rows.where(title != "").select(
        F.sha2(F.concat_ws("|", title, field("company"), field("url"), description), 256).alias("job_id"),
        title.alias("title"),
        blank_to(field("company"), "Unknown Company").alias("company"),
        nz.location(field("location")).alias("location"),
        nz.salary_bounds(field("salary")).alias("salary"),
        blank_to(description, title).alias("description"),
        nz.listed_skills(listed, description).alias("required_skills"),
        nz.job_type(text).alias("job_type"),
        F.coalesce(level if level is not None else F.lit(None), nz.experience_level(text)).alias("experience_level"),
        F.coalesce(remote if remote is not None else F.lit(None), F.contains(F.lower(field("work_model")), F.lit("remote"))).alias("remote_allowed"),
        nz.boolean_field(field("visa")).alias("visa_sponsorship"),
        F.nullif(field("url"), F.lit("nan")).alias("source_url"),
    )


def jobs_from_swe_csv(rows: DataFrame) -> DataFrame:
    """Jobs of the fixed nine-column CSV: hybrid counts as remote, new graduates as entry level."""
    model = F.lower(nz.text_field(rows, "Work Model"))
    remote = F.contains(model, F.lit("remote")) | F.contains(model, F.lit("hybrid"))
    level = F.when(nz.boolean_field(nz.text_field(rows, "Is New Grad")), "entry")
    return jobs_from_csv(rows, remote, level)


def merge_sources(*sources: DataFrame) -> DataFrame:
    """The union of sources, one row per lower-case title and company: the first source's."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("_s", F.lit(i)) for i, s in enumerate(sources)])
    w = W.partitionBy(F.lower(F.trim("title")), F.lower(F.trim("company"))).orderBy("_s", "job_id")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_s")


def with_search_text(jobs: DataFrame) -> DataFrame:
    """Adds skills_text and all_text, and the coordinates as 'lon,lat'."""
    skills = F.array_join("required_skills", " ")
    return jobs.withColumns({"skills_text": skills, "all_text": F.concat_ws(" ", "title", "company", "description", skills)})


def coordinates(text: Column) -> Column:
    """Struct of longitude and latitude from 'lon,lat'; null when it is malformed."""
    parts = F.split(text, ",")
    lon, lat = F.trim(F.get(parts, F.lit(0))).try_cast("double"), F.trim(F.get(parts, F.lit(1))).try_cast("double")
    return F.when((F.size(parts) == 2) & lon.isNotNull() & lat.isNotNull(), F.struct(lon.alias("lon"), lat.alias("lat")))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def csv_counts(rows: DataFrame) -> DataFrame:
    """(rows, without_title, jobs) of any job CSV, from one pass; with ``extra_fields``, how many rows are
    malformed as well, which are no jobs."""
    blank = nz.text_field(rows, *JOB_ALIASES["title"]) == ""
    if "extra_fields" not in rows.columns:
        return rows.agg(F.count("*").alias("rows"), F.count_if(blank).alias("without_title"), F.count_if(~blank).alias("jobs"))
    bad = F.col("extra_fields") > 0
    return rows.agg(F.count("*").alias("rows"), F.count_if(bad).alias("malformed"), F.count_if(~bad & blank).alias("without_title"), F.count_if(~bad & ~blank).alias("jobs"))


# What a job without a company or with a location that is no object gets.
NO_COMPANY, DEFAULT_PLACE = "未知公司", ("北京", "北京", "中国")


def load_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs of JSONL files whose fields go by other names: job_id or id, skills or required_skills,
    company or company_name; a location that is no object is replaced by a default. Blank lines are
    no jobs; a line that is no object gives one with defaults."""
    line = F.col("value")
    field = lambda name: F.get_json_object(line, f"$.{name}")
    some = lambda *names: F.coalesce(*[F.nullif(field(n), F.lit("")) for n in names])
    listed = lambda name: F.from_json(field(name), "array<string>")
    default = F.struct(*[F.lit(v).alias(n) for n, v in zip(("city", "state", "country"), DEFAULT_PLACE)])
    place = F.from_json(field("location"), "city string, state string, country string")
    return spark.read.text(path).where(F.trim("value") != "").select(
        F.coalesce(some("job_id", "id"), F.lit("")).alias("job_id"), F.coalesce(field("title"), F.lit("")).alias("title"), F.coalesce(field("description"), F.lit("")).alias("description"),
        F.coalesce(F.when(F.size(listed("skills")) > 0, listed("skills")), listed("required_skills"), F.array().cast("array<string>")).alias("skills"),
        F.coalesce(some("company"), field("company_name"), F.lit(NO_COMPANY)).alias("company"),
        F.when(field("location").isNull() | F.startswith(F.ltrim(field("location")), F.lit("{")), F.coalesce(F.when(field("location").isNotNull(), place), default)).otherwise(default).alias("location"),
        F.coalesce(field("job_family"), F.lit("")).alias("job_family"), F.coalesce(field("source"), F.lit("jobs.jsonl")).alias("source"),
    )


def write_jsonl(rows: DataFrame, path: str) -> None:
    """One compact object per line, in UTF-8; null fields are left out."""
    rows.write.json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of one row, or few, as indented JSON in one file."""
    report.coalesce(1).select(F.to_json(F.struct(*report.columns), {"pretty": "true"}).alias("value")).write.text(path)


def store(new: DataFrame, old: DataFrame | None, path: str, key: str = "job_id", stamp: str = "ingest_ts") -> None:
    """Upserts by key into a new folder: the row with the latest stamp stays, of equal stamps the one
    whose content comes last as JSON. Never in place."""
    rows = new if old is None else old.unionByName(new, allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(F.desc(stamp), F.desc(F.to_json(F.struct(*sorted(rows.columns)))))
    rows.where(F.col(key).isNotNull()).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.parquet(path)


def bulk_store(rows: DataFrame, path: str, order: str, key: str = "job_id", title: str = "title", stamp: str = "ingest_ts", first: int = 20) -> DataFrame:
    """Stores the rows that have a key and a title; (kind, n, line): how many were accepted and
    refused, and the first refusals by ``order``, each line once."""
    why = F.when(F.col(key).isNull(), "no id").when(F.col(title).isNull(), "no title")
    judged = rows.withColumn("kind", why)
    store(judged.where("kind is null").drop("kind"), None, path, key, stamp)
    counts = judged.groupBy(F.when(F.col("kind").isNull(), "accepted").otherwise("refused").alias("kind")).agg(F.count("*").alias("n"))
    refused = judged.where("kind is not null").select("kind", F.lit(1).cast("long").alias("n"), F.col(order).alias("line")).distinct().orderBy("line").limit(first)
    return counts.withColumn("line", F.lit(None).cast(rows.schema[order].dataType)).unionByName(refused)


def without(rows: DataFrame, gone: DataFrame, key: str = "job_id") -> DataFrame:
    """The rows whose key is not among those to delete."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def multi_get(rows: DataFrame, asked: DataFrame, key: str = "job_id") -> DataFrame:
    """Rows of the asked keys with the position (``pos``) they were asked at; unknown keys drop out."""
    return asked.select(key, "pos").join(rows, key)


def save_vectors(vectors: DataFrame, path: str) -> None:
    """One table of ids and vectors."""
    vectors.select("id", "vector").write.parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, vector array<float>").parquet(path)


def clear(df: DataFrame, path: str) -> None:
    """Overwrites a table with an empty one of the same columns."""
    df.limit(0).write.mode("overwrite").parquet(path)

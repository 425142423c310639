"""Field normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentinels, keyword cascades and skill words of the job formats that are read.
NO_SALARY = ("0", "none", "nan", "n/a", "na", "not specified")
TRUE_WORDS = ("true", "yes", "1", "y", "on")
SKILL_WORDS = (
    "python", "java", "javascript", "typescript", "react", "angular", "vue", "node.js", "express", "django", "flask", "spring",
    "sql", "postgresql", "mysql", "mongodb", "redis", "docker", "kubernetes", "aws", "azure", "gcp", "git", "github", "gitlab",
    "jenkins", "ci/cd", "agile", "scrum", "machine learning", "ai", "data science", "analytics", "tableau", "power bi", "excel",
    "r", "tensorflow", "pytorch", "pandas", "numpy", "scikit-learn", "html", "css", "bootstrap", "sass", "less", "webpack",
    "babel", "npm", "yarn", "linux", "unix", "bash", "shell", "rest api", "graphql", "microservices", "c++", "c#", ".net", "php",
    "ruby", "rails", "go", "rust", "swift", "kotlin", "android", "ios", "mobile", "web", "frontend", "backend", "full stack",
    "devops", "sre", "security", "cybersecurity", "blockchain", "cryptocurrency",
)
JOB_TYPES = (("internship", ("intern",)), ("contract", ("contract", "freelance", "consultant")), ("part_time", ("part-time", "part time", "parttime")))
LEVELS = (
    ("senior", ("senior", "lead", "principal", "staff", "architect", "expert")),
    ("mid", ("mid", "intermediate", "experienced", "level 2", "level ii")),
    ("executive", ("executive", "director", "vp", "vice president", "c-level", "head of")),
)
DATE_PATTERNS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy.MM.dd", "yyyyMMdd")


def text_field(df: DataFrame, *aliases: str) -> Column:
    """The first listed column that exists and is not null, trimmed; '' when there is none."""
    there = [F.col(f"`{a}`").cast("string") for a in aliases if a in df.columns]
    return F.trim(F.coalesce(*there, F.lit("")))


def first_text(*columns: Column) -> Column:
    """The first value that is not blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def location(text: Column) -> Column:
    """Struct of city, state and country; 'a, b' splits at the comma, else the last word is the state."""
    t = F.trim(F.coalesce(text, F.lit("")))
    parts = F.transform(F.split(t, ","), lambda x: F.trim(x))
    words = F.split(t, r"\s+")
    city = F.when(t == "", "Unknown").when(F.size(parts) >= 2, parts[0]).when(F.size(words) >= 2, F.array_join(F.slice(words, 1, F.size(words) - 1), " ")).otherwise(t)
    state = F.when(t == "", "Unknown").when(F.size(parts) >= 2, parts[1]).when(F.size(words) >= 2, F.element_at(words, -1)).otherwise("Unknown")
    return F.struct(city.alias("city"), state.alias("state"), F.when(F.size(parts) >= 3, parts[2]).otherwise("USA").alias("country"))


def salary_bounds(text: Column, keep_zero: bool = False) -> Column:
    """Struct of low and high: the first 'a-b', else the first number; null where there is none."""
    t = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[$,]", "")))
    low = F.regexp_extract(t, r"(\d+)\s*-\s*(\d+)", 1)
    high = F.regexp_extract(t, r"(\d+)\s*-\s*(\d+)", 2)
    one = F.regexp_extract(t, r"(\d+)", 1)
    a = F.nullif(F.when(low != "", low).otherwise(one), F.lit("")).try_cast("int")
    b = F.nullif(F.when(low != "", high).otherwise(one), F.lit("")).try_cast("int")
    least = 0 if keep_zero else 1
    known = ~t.isin(*NO_SALARY)
    return F.struct(F.when(known & (a >= least), a).alias("low"), F.when(known & (b >= least), b).alias("high"))


def number_field(*columns: Column) -> Column:
    """The first value that parses as a number once $ and , are gone, truncated."""
    return F.coalesce(*[F.regexp_replace(c, "[$,]", "").try_cast("double") for c in columns], F.lit(None).cast("double")).cast("int")


def boolean_field(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(*TRUE_WORDS), F.lit(False))


def dictionary_skills(text: Column, words: tuple[str, ...] = SKILL_WORDS) -> Column:
    """Sorted dictionary words that the lower-case text contains, inside other words too."""
    # a one-element array binds the text in lower case, so that it is not made anew for each word
    low = F.array(F.lower(F.coalesce(text, F.lit(""))))
    return F.array_sort(F.flatten(F.transform(low, lambda t: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(t, w)))))


def split_terms(text: Column, pattern: str = r"[,;|\n]") -> Column:
    """Trimmed non-blank parts."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: F.trim(x)), lambda x: x != "")


def listed_skills(listed: Column, description: Column) -> Column:
    """Listed terms (lower case, over one letter) and dictionary words, each once, sorted."""
    own = F.filter(F.transform(split_terms(listed), lambda x: F.lower(x)), lambda x: F.length(x) > 1)
    return F.array_sort(F.array_distinct(F.concat(own, dictionary_skills(description))))


def _cascade(text: Column, table: tuple, default: str) -> Column:
    out = None
    for value, words in table:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def job_type(text: Column) -> Column:
    return _cascade(F.lower(text), JOB_TYPES, "full_time")


def experience_level(text: Column) -> Column:
    return _cascade(F.lower(text), LEVELS, "entry")


def json_field(text: Column, schema: str, fallback: Column) -> Column:
    return F.coalesce(F.from_json(text, schema), fallback)


def unique_terms(terms: Column) -> Column:
    """Each term once whatever its case, in first order and first spelling; blanks go."""
    start = F.array().cast("array<string>")
    clean = F.filter(F.transform(terms, lambda x: F.trim(x)), lambda x: x != "")
    return F.aggregate(clean, start, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.array_append(acc, x)))


def date_field(text: Column) -> Column:
    """Date from epoch milliseconds or one of the known patterns; years before 1970 give null."""
    millis = text.try_cast("double")
    parsed = F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])
    found = F.when(millis >= 1e11, F.timestamp_millis(millis.cast("long"))).otherwise(parsed)
    return F.when(F.year(found) >= 1970, found.cast("date"))


def content_hash(**fields: Column) -> Column:
    """SHA-256 of the fields as JSON in alphabetical order, nulls included."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("double").cast("int"), F.lit(default))


def safe_float(text: Column, default: float = 0.0) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(default))


def sections(**parts: Column) -> Column:
    """Titled parts joined by blank lines; blank parts are left out."""
    made = [F.when(F.trim(c) != "", F.concat(F.lit(title.replace("_", " ").capitalize() + ":\n"), F.trim(c))) for title, c in parts.items()]
    return F.concat_ws("\n\n", *made)


def value_map(column: Column, table: dict[str, str], default: str) -> Column:
    """The table's value for the lower-case column, else the default."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, F.lower(F.trim(column))), F.lit(default))

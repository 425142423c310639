"""Data quality reports, label pools and label checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.shared import bounded, written


def missing(column: str) -> Column:
    return F.count_if(F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == ""))


def orphans(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_anti")


def report(**frames: DataFrame) -> DataFrame:
    """(section, metric, value) from one-row frames of long columns, by section."""
    parts = None
    for section, df in frames.items():
        pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in df.columns])
        part = df.select(F.lit(section).alias("section"), F.inline(pairs))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def first_of(rows: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


#: Items that a cell of the ring holds, about, for each one asked for.
CELL = 32


def _point(*parts: Column) -> Column:
    """A place on a ring of 2^60 places, from a digest."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")


def ring_pick(queries: DataFrame, items: DataFrame, taken: DataFrame | Callable[[DataFrame], DataFrame], k: int, seed: str = "7") -> DataFrame:
    """(query_id, doc_id, r): of each query's items the first ``k`` on a ring, from the query's own place
    on; all items and queries have hashed places, so a query's picks are as good as random and repeat.

    ``queries``: query_id, and family where items of its own family don't count; ``items``: doc_id, family;
    ``taken``: pairs (query_id, doc_id; written) that don't count, or what finds them among pairs. The ring is cut into cells of a few items.
    Queries look at their next cells, more each round, until they have ``k`` or have been around;
    only those that lack some go on, so no query meets all items but one that nearly all are taken of."""
    cells = max(1, items.count() // (CELL * max(1, k)))
    cell = lambda h: F.shiftright(F.shiftright(h, 30) * cells, 30)
    placed = items.select("doc_id", F.col("family").alias("other"), _point(F.lit(seed), F.col("doc_id").cast("string")).alias("h")).withColumn("cell", cell(F.col("h")))
    placed = written(placed, "ring")
    own = _point(F.lit(seed), F.lit("query"), F.col("query_id").cast("string")).alias("own")
    family = F.col("family") if "family" in queries.columns else F.lit(None).cast("string")
    open_ = written(queries.select("query_id", family.alias("family"), own).withColumn("home", cell(F.col("own"))), "open")
    begin, end, found = 0, 1, None
    while begin <= cells:
        # after the last cell, home again for what lies before the query's place
        look = open_.select("*", F.explode(F.sequence(F.lit(begin), F.lit(min(end, cells + 1) - 1))).alias("step")).withColumn("cell", (F.col("home") + F.col("step")) % cells)
        met = look.join(placed, "cell").where(F.when(F.col("step") == 0, F.col("h") >= F.col("own")).when(F.col("step") == cells, F.col("h") < F.col("own")).otherwise(True))
        met = met.where(F.col("family").isNull() | (F.col("family") != F.coalesce("other", F.lit(""))))
        met = met.select("query_id", "doc_id", "step", "h")
        if callable(taken):
            met = written(met, "looked")
            met = met.join(taken(met), ["query_id", "doc_id"], "left_anti")
        else:
            met = met.join(bounded(taken), ["query_id", "doc_id"], "left_anti")
        new = written(met, "met")
        found = new if found is None else found.union(new)
        begin, end = end, 4 * end
        full = found.groupBy("query_id").count().where(F.col("count") >= k)
        open_ = written(open_.join(full, "query_id", "left_anti"), "open")
        if open_.isEmpty():
            break
    order = F.row_number().over(W.partitionBy("query_id").orderBy("step", "h", "doc_id"))
    return found.withColumn("r", order).where(F.col("r") <= k).select("query_id", "doc_id", "r")


def label_pool(ranking: DataFrame, items: DataFrame, families: DataFrame, matched: DataFrame | Callable[[DataFrame], DataFrame] | None = None, seed: str = "7", top: int = 8, middle: int = 8, others: int = 4, low: int = 50, high: int = 200) -> DataFrame:
    """(query_id, doc_id, bucket, rank): what to label. Per query the ``top`` first of its ranking,
    ``middle`` from ranks ``low`` to ``high``, and ``others`` items of other families that did not match
    at all, picked on a ring; where there are too few of those, any items not chosen yet. The best
    ranked fill up to the total, and where they end, any items.

    ``items``: doc_id, family; ``families``: query_id, family; ``matched``: all pairs that match, or what
    finds them among pairs, where ``ranking`` ends at rank ``high``, which is as far as any bucket reads."""
    total = top + middle + others
    ranking = written(ranking.select("query_id", "doc_id", "rank"), "ranking")
    pairs = ranking if matched is None else matched if callable(matched) else written(matched, "matched")
    pairs = pairs if callable(pairs) else pairs.select("query_id", "doc_id")
    per = lambda rows: rows.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy("rank")))
    first = ranking.where(F.col("rank") <= top).select("query_id", "doc_id", "rank", F.lit("top").alias("bucket"))
    mid = per(ranking.where(F.col("rank").between(low, high))).where(F.col("r") <= middle).select("query_id", "doc_id", "rank", F.lit("middle").alias("bucket"))
    ranked = written(first.unionByName(mid), "ranked")
    none = F.lit(None).cast("int").alias("rank")

    foreign = written(ring_pick(families, items, pairs, others, seed), "foreign")
    enough = foreign.groupBy("query_id").count().where(F.col("count") >= others).select("query_id")
    short = families.select("query_id").join(enough, "query_id", "left_anti")
    anything = ring_pick(short, items, ranked.select("query_id", "doc_id"), others, seed)
    random = foreign.join(enough, "query_id", "left_semi").unionByName(anything).select("query_id", "doc_id", none, F.lit("other").alias("bucket"))
    chosen = written(ranked.unionByName(random.select("query_id", "doc_id", "rank", "bucket")), "chosen")

    room = families.select("query_id").join(chosen.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", (total - F.coalesce("n", F.lit(0))).alias("room"))
    rest = per(ranking.join(bounded(chosen.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_anti"))
    fill = rest.join(room, "query_id").where(F.col("r") <= F.col("room")).select("query_id", "doc_id", "rank", F.lit("fill").alias("bucket"))
    chosen = written(chosen.unionByName(fill), "chosen")

    lacks = families.select("query_id").join(chosen.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").select("query_id", (total - F.coalesce("n", F.lit(0))).alias("room")).where("room > 0")
    last = ring_pick(lacks.select("query_id"), items, chosen.select("query_id", "doc_id"), total, seed).join(lacks, "query_id").where(F.col("r") <= F.col("room"))
    return chosen.unionByName(last.select("query_id", "doc_id", none, F.lit("any").alias("bucket")))


def label_report(labels: DataFrame, issues: DataFrame) -> DataFrame:
    """(metric, value): records, pairs and queries labelled, labels by grade and source, the least,
    greatest and mean confidence (4 digits), and how many issues there are. One pass over the labels."""
    longs = labels.agg(
        F.count("*").alias("records"), F.countDistinct("query_id", "doc_id").alias("pairs"), F.countDistinct("query_id").alias("queries"),
        F.round(F.avg("confidence"), 4).alias("confidence_mean"), F.min("confidence").alias("confidence_min"), F.max("confidence").alias("confidence_max"),
    )
    rows = longs.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in longs.columns])))
    for name in ("grade", "source"):
        by = labels.where(F.col(name).isNotNull()).groupBy(F.concat(F.lit(f"{name}_"), name).alias("metric")).agg(F.count("*").cast("double").alias("value"))
        rows = rows.unionByName(by)
    return rows.unionByName(issues.agg(F.count("*").cast("double").alias("value")).select(F.lit("issues").alias("metric"), "value"))


def first_issues(issues: DataFrame, k: int = 500) -> DataFrame:
    """The first ``k`` issues by query, document and name."""
    return issues.orderBy("query_id", "doc_id", "issue").limit(k)


ISSUES = ("missing_field", "not_in_pool", "bad_grade", "bad_confidence", "low_confidence", "flag_not_boolean", "no_resume_evidence", "no_job_evidence", "zero_without_reason", "duplicate")


def label_issues(labels: DataFrame, pool: DataFrame) -> DataFrame:
    """(query_id, doc_id, issue): every rule that a label breaks.

    ``labels``: query_id, doc_id, grade, confidence, flag, resume_evidence, job_evidence, notes.
    A label without a pair id is checked no further."""
    known = pool.select("query_id", "doc_id").distinct().withColumn("known", F.lit(True))
    rows = labels.join(known, ["query_id", "doc_id"], "left").withColumn("times", F.count("*").over(W.partitionBy("query_id", "doc_id")))
    no_id = F.col("query_id").isNull() | F.col("doc_id").isNull()
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    tests = {
        "missing_field": F.col("grade").isNull() | F.col("confidence").isNull(),
        "not_in_pool": F.col("known").isNull(),
        "bad_grade": ~F.col("grade").between(0, 3),
        "bad_confidence": ~F.col("confidence").between(0, 1),
        "low_confidence": F.col("confidence").between(0, 1) & (F.col("confidence") < 0.55),
        "flag_not_boolean": ~F.coalesce(F.lower("flag"), F.lit("")).isin("true", "false"),
        "no_resume_evidence": (F.col("grade") >= 2) & blank(F.col("resume_evidence")),
        "no_job_evidence": (F.col("grade") >= 2) & blank(F.col("job_evidence")),
        "zero_without_reason": (F.col("grade") == 0) & blank(F.col("notes")),
        "duplicate": F.col("times") > 1,
    }
    found = F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])
    issues = F.when(no_id, F.array(F.lit("missing_pair_id"))).otherwise(F.filter(found, lambda x: x.isNotNull()))
    return rows.select("query_id", "doc_id", F.explode(issues).alias("issue"))

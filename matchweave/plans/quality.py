"""Registered quality, label, evaluation, lookup and ingest queries, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import normalize as nz
from ..operators import evaluation, graph, lexical, quality, search
from ..sources import graph_tables as g
from ..sources import readers
from ..sources.shared import folder, written
from ..sources.tables import table
from ..streaming import ingest
from .graph import SQL
from .lexical import SCORED, TOKENS, documents, questions


def _ranking(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return lexical.top_k(lexical.bm25(documents(spark, sf_dir), questions(spark, sf_dir)), k).select("query_id", "doc_id", "score", "rank")


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the BM25 ranking; a document's grade counts for the queries that find it."""
    ranking = _ranking(spark, sf_dir, 50)
    grade = (2 * F.col("quality") + 1 - F.col("toxic")).alias("grade")
    labels = ranking.select("query_id", "doc_id").join(table(spark, sf_dir, "labels").select("doc_id", grade), "doc_id")
    return evaluation.metrics(ranking, labels)


METRICS = f"""WITH {TOKENS}, {SCORED}, r AS (SELECT * FROM ranked WHERE rank <= 50),
l AS (SELECT query_id, doc_id, 2 * quality + 1 - toxic AS grade FROM r JOIN labels USING (doc_id)),
id AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS i FROM l),
b AS (SELECT query_id, count(*) FILTER (grade >= 2) AS pos, sum(CASE WHEN i <= 5 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS i5, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS i10 FROM id GROUP BY query_id),
g AS (SELECT query_id, rank, coalesce(grade, 0) AS grade FROM r LEFT JOIN l USING (query_id, doc_id)),
a AS (SELECT query_id, min(rank) FILTER (grade >= 2) AS f, sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS d5, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS d10, count(*) FILTER (grade >= 2 AND rank <= 5) AS h5, count(*) FILTER (grade >= 2 AND rank <= 10) AS h10 FROM g GROUP BY query_id)
SELECT query_id, round(coalesce(1.0 / f, 0.0), 6) AS mrr, round(CASE WHEN i5 > 0 THEN d5 / i5 ELSE 0.0 END, 6) AS ndcg_5, round(CASE WHEN i10 > 0 THEN d10 / i10 ELSE 0.0 END, 6) AS ndcg_10, round(CASE WHEN pos > 0 THEN h5 / pos ELSE 0.0 END, 6) AS recall_5, round(CASE WHEN pos > 0 THEN h10 / pos ELSE 0.0 END, 6) AS recall_10 FROM a JOIN b USING (query_id)"""


def ranking_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.averages(ranking_metrics(spark, sf_dir))


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    grade = 2 * F.col("quality") + 1 - F.col("toxic")
    return quality.report(
        documents=docs.agg(F.count("*").alias("rows"), F.countDistinct("doc_id").alias("unique_ids"), (F.count("*") - F.countDistinct("doc_id")).alias("duplicate_ids"), quality.missing("text").alias("missing_text"), quality.missing("source").alias("missing_source")),
        labels=labels.agg(F.count("*").alias("rows"), *[F.count_if(grade == k).alias(f"grade_{k}") for k in range(4)]),
        references=quality.orphans(labels, docs, "doc_id").agg(F.count("*").alias("orphan_labels")),
        unlabelled=quality.orphans(docs, labels, "doc_id").agg(F.count("*").alias("documents")),
    )


REPORT = """WITH d AS (SELECT count(*) AS rows, count(DISTINCT doc_id) AS u, count(*) FILTER (text IS NULL OR trim(text) = '') AS mt, count(*) FILTER (source IS NULL OR trim(source) = '') AS ms FROM documents),
l AS (SELECT 2 * quality + 1 - toxic AS grade FROM labels)
SELECT 'documents' AS section, unnest(['rows', 'unique_ids', 'duplicate_ids', 'missing_text', 'missing_source']) AS metric, unnest([rows, u, rows - u, mt, ms]) AS value FROM d
UNION ALL SELECT 'labels', 'rows', count(*) FROM l UNION ALL SELECT 'labels', 'grade_' || k, count(*) FILTER (grade = k) FROM l, range(4) r(k) GROUP BY k
UNION ALL SELECT 'references', 'orphan_labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'unlabelled', 'documents', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("family"))
    asked = questions(spark, sf_dir).select("query_id", F.lit("en").alias("family"))
    counts, weights = lexical.indexed(documents(spark, sf_dir), questions(spark, sf_dir))
    # which pairs match is asked of those that a query looks at, so not all matching pairs are written
    matched = lambda pairs: lexical.scores(counts, weights, within=pairs).select("query_id", "doc_id")
    return quality.label_pool(lexical.top_k(lexical.scores(counts, weights), 200), docs, asked, matched)


def label_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pool(spark, sf_dir).select("query_id", "doc_id", "bucket", "rank")


# An item's place on the ring after the query's own: those before it come last.
_RING = "row_number() OVER (PARTITION BY query_id ORDER BY d.h < q.h, d.h, doc_id)"
POOL = f"""{TOKENS}, {SCORED}, d AS (SELECT doc_id, lang, CAST('0x' || substr(md5('7|' || doc_id), 1, 15) AS BIGINT) AS h FROM documents),
q0 AS (SELECT item_id AS query_id, CAST('0x' || substr(md5('7|query|' || item_id), 1, 15) AS BIGINT) AS h FROM benchmark),
f1 AS (SELECT query_id, doc_id, 'top' AS bucket, rank FROM ranked WHERE rank <= 8),
f2 AS (SELECT query_id, doc_id, 'middle' AS bucket, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM ranked WHERE rank BETWEEN 50 AND 200) WHERE r <= 8),
fo AS (SELECT query_id, doc_id, {_RING} AS r FROM q0 q CROSS JOIN d ANTI JOIN ranked USING (query_id, doc_id) WHERE lang IS DISTINCT FROM 'en'),
fe AS (SELECT query_id FROM fo GROUP BY query_id HAVING count(*) >= 4),
fa AS (SELECT query_id, doc_id, {_RING} AS r FROM q0 q CROSS JOIN d ANTI JOIN (SELECT query_id, doc_id FROM f1 UNION ALL SELECT query_id, doc_id FROM f2) USING (query_id, doc_id) ANTI JOIN fe USING (query_id)),
f3 AS (SELECT query_id, doc_id, 'other' AS bucket, NULL AS rank FROM (SELECT * FROM fo SEMI JOIN fe USING (query_id) UNION ALL SELECT * FROM fa) WHERE r <= 4),
ch AS (SELECT * FROM f1 UNION ALL SELECT * FROM f2 UNION ALL SELECT * FROM f3), room AS (SELECT item_id AS query_id, 20 - count(doc_id) AS room FROM benchmark LEFT JOIN ch ON item_id = query_id GROUP BY item_id),
re AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM ranked ANTI JOIN ch USING (query_id, doc_id) WHERE rank <= 200),
c2 AS (SELECT query_id, doc_id, bucket, rank FROM ch UNION ALL SELECT query_id, doc_id, 'fill', rank FROM re JOIN room USING (query_id) WHERE r <= room),
la AS (SELECT item_id AS query_id, 20 - count(doc_id) AS room FROM benchmark LEFT JOIN c2 ON item_id = query_id GROUP BY item_id),
an AS (SELECT query_id, doc_id, {_RING} AS r FROM q0 q CROSS JOIN d ANTI JOIN c2 USING (query_id, doc_id)),
pool AS (SELECT * FROM c2 UNION ALL SELECT query_id, doc_id, 'any', NULL FROM an JOIN la USING (query_id) WHERE r <= room)"""


def pool_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    return pool.groupBy("bucket").agg(F.count("*").alias("items"), F.countDistinct("query_id").alias("queries"), F.min("rank").alias("best"), F.max("rank").alias("last"))


def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pool pairs with faults put in by id, and each rule that they break."""
    pool = written(_ranking(spark, sf_dir, 10).select("query_id", "doc_id", "rank"), "pool")
    d = F.col("doc_id")
    made = pool.select(
        F.when(d % 29 != 0, F.col("query_id")).alias("query_id"), F.when(d % 31 == 0, -d - 1).otherwise(d).alias("doc_id"), F.when(d % 23 != 0, (d % 5).cast("int")).alias("grade"), ((d % 13) / 10.0).alias("confidence"),
        F.when(d % 7 == 0, "maybe").otherwise("True").alias("flag"), F.when(d % 3 == 0, "").otherwise("seen").alias("resume_evidence"), F.when(d % 4 == 0, " ").otherwise("seen").alias("job_evidence"), F.when(d % 2 == 0, "why").alias("notes"),
    )
    both = made.unionAll(made.where("grade = 4"))
    return quality.label_issues(both, pool).groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("queries"))


VALIDATION = f"""WITH {TOKENS}, {SCORED}, p AS (SELECT query_id, doc_id FROM ranked WHERE rank <= 10),
m AS (SELECT CASE WHEN doc_id % 29 != 0 THEN query_id END AS query_id, CASE WHEN doc_id % 31 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 23 != 0 THEN doc_id % 5 END AS grade, (doc_id % 13) / 10.0 AS confidence,
 doc_id % 7 != 0 AS flag_ok, doc_id % 3 != 0 AS re, doc_id % 4 != 0 AS je, doc_id % 2 = 0 AS notes FROM p),
b AS (SELECT * FROM m UNION ALL SELECT * FROM m WHERE grade = 4), c AS (SELECT *, count(*) OVER (PARTITION BY query_id, doc_id) AS times FROM b),
k AS (SELECT c.*, p.doc_id IS NOT NULL AS known FROM c LEFT JOIN p ON c.query_id = p.query_id AND c.doc_id = p.doc_id),
i AS (SELECT query_id, unnest(CASE WHEN query_id IS NULL THEN ['missing_pair_id'] ELSE list_filter([CASE WHEN grade IS NULL THEN 'missing_field' END, CASE WHEN NOT known THEN 'not_in_pool' END, CASE WHEN grade NOT BETWEEN 0 AND 3 THEN 'bad_grade' END,
 CASE WHEN confidence > 1 THEN 'bad_confidence' END, CASE WHEN confidence < 0.55 THEN 'low_confidence' END, CASE WHEN NOT flag_ok THEN 'flag_not_boolean' END, CASE WHEN grade >= 2 AND NOT re THEN 'no_resume_evidence' END,
 CASE WHEN grade >= 2 AND NOT je THEN 'no_job_evidence' END, CASE WHEN grade = 0 AND NOT notes THEN 'zero_without_reason' END, CASE WHEN times > 1 THEN 'duplicate' END], lambda x: x IS NOT NULL) END) AS issue FROM k)
SELECT issue, count(*) AS n, count(DISTINCT query_id) AS queries FROM i GROUP BY issue"""


def dedupe_title_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("lang").alias("company"))
    return quality.first_of(docs, [F.lower(F.trim("title")), F.lower(F.trim("company"))], F.col("doc_id"))


def json_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as postings from JSON: parsed fields, kinds by table, hashed content."""
    e = table(spark, sf_dir, "events").withColumn("p", nz.json_field(F.col("props"), "k int, city string", F.struct(F.lit(0).alias("k"), F.lit(None).cast("string").alias("city"))))
    kind = nz.value_map(F.col("event_type"), {"signup": "entry", "purchase": "senior", "view": "mid"}, "mid")
    return e.select("event_id", F.col("p.k").alias("k"), F.coalesce("p.city", F.lit("Unknown")).alias("city"), kind.alias("level"), F.element_at(F.split(F.concat(F.lit("urn:li:job:"), "event_id"), ":"), -1).alias("job_id"), nz.content_hash(type=F.col("event_type"), id=F.col("event_id")).alias("hash"))


JSON = """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, 'Unknown' AS city, CASE event_type WHEN 'signup' THEN 'entry' WHEN 'purchase' THEN 'senior' ELSE 'mid' END AS level, CAST(event_id AS VARCHAR) AS job_id,
sha256('{"id":' || event_id || ',"type":"' || event_type || '"}') AS hash FROM events"""


def latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders upserted by a second load of every third one, with a higher price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("load"))
    again = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit(2).alias("load"))
    return graph.keep_latest(o.unionByName(again), ["o_orderkey"], F.desc("load"))


def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders asked for by id, in the order asked, less those deleted and those unknown."""
    asked = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_extendedprice").alias("p")).withColumn("pos", F.row_number().over(W.partitionBy(F.col("id") % 100).orderBy(F.desc("p"), "id")))
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return readers.multi_get(o, readers.without(asked, gone, "id"), "id").select("id", "pos", "o_totalprice")


def structured_filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 2 of the jobs of each place that pass type, salary and date filters."""
    j = search.structured(g.jobs(spark, sf_dir), low=50000, high=250000).where((F.col("job_type") != "P") & (F.col("posted_date") >= F.lit("1996-01-01").cast("timestamp_ntz")))
    return lexical.page(j, 2, 10, key="city", item="job_id", score="min_salary").select("city", "job_id", "min_salary", "rank", "total", "pages")


FILTER_PAGE = f"""WITH {SQL}, f AS (SELECT city, job_id, min_salary, row_number() OVER (PARTITION BY city ORDER BY min_salary DESC, job_id) AS rank, count(*) OVER (PARTITION BY city) AS total FROM jobs WHERE job_type != 'P' AND min_salary BETWEEN 50000 AND 250000 AND posted_date >= TIMESTAMP '1996-01-01')
SELECT *, CAST(ceil(total / 10.0) AS BIGINT) AS pages FROM f WHERE rank BETWEEN 11 AND 20"""


def label_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: its most common language and its languages by votes."""
    v = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), F.col("lang").alias("lang"))))
    return v.groupBy("source").agg(ordered.alias("o")).select("source", F.col("o")[0]["lang"].alias("family"), F.array_join(F.transform("o", lambda x: x["lang"]), "|").alias("languages"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events drained from a file stream: the last per user and kind."""
    path = folder(spark, "stream")
    stream = ingest.read_stream(spark, sf_dir, "events", files=16).select("event_id", "user_id", "event_type", "value", "ts")
    store = ingest.Store(spark, f"{path}/store", ["user_id", "event_type"], ["ts", "event_id"])
    ingest.upsert(stream, store, f"{path}/state")
    return store.current(stream.schema).select("user_id", "event_type", "event_id", "value")


QUERIES = {
    "ranking_metrics": (ranking_metrics, METRICS),
    "ranking_averages": (ranking_averages, f"WITH per AS ({METRICS}) SELECT count(*) AS queries, round(avg(mrr), 6) AS mrr, round(avg(ndcg_5), 6) AS ndcg_5, round(avg(ndcg_10), 6) AS ndcg_10, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10 FROM per"),
    "quality_report": (quality_report, REPORT),
    "label_pool": (label_pool, f"WITH {POOL} SELECT query_id, doc_id, bucket, rank FROM pool"),
    "pool_report": (pool_report, f"WITH {POOL} SELECT bucket, count(*) AS items, count(DISTINCT query_id) AS queries, min(rank) AS best, max(rank) AS last FROM pool GROUP BY bucket"),
    "label_validation": (label_validation, VALIDATION),
    "dedupe_title_company": (
        dedupe_title_company,
        "SELECT doc_id, split_part(text, chr(10), 1) AS title, lang AS company FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim(split_part(text, chr(10), 1))), lower(trim(lang)) ORDER BY doc_id) = 1",
    ),
    "json_normalize": (json_normalize, JSON),
    "latest_by_id": (latest_by_id, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS load FROM orders"),
    "multi_get": (
        multi_get,
        "WITH a AS (SELECT id, row_number() OVER (PARTITION BY id % 100 ORDER BY p DESC, id) AS pos FROM (SELECT l_orderkey AS id, max(l_extendedprice) AS p FROM lineitem GROUP BY l_orderkey)) SELECT id, pos, o_totalprice FROM a JOIN orders ON id = o_orderkey WHERE o_orderstatus != 'P'",
    ),
    "structured_filter_page": (structured_filter_page, FILTER_PAGE),
    "label_votes": (
        label_votes,
        "WITH v AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), o AS (SELECT source, list(lang ORDER BY n DESC, lang) AS l FROM v GROUP BY source) SELECT source, l[1] AS family, array_to_string(l, '|') AS languages FROM o",
    ),
    "stream_ingest": (stream_ingest, "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"),
}

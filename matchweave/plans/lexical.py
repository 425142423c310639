"""Registered lexical queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexical
from ..sources.tables import table

PATTERN = "[a-z0-9+#.]+|[\\x{4e00}-\\x{9fff}]"

TOKENS = f"""
toks AS (SELECT doc_id, regexp_extract_all(lower(text), '{PATTERN}') AS t FROM documents),
post AS (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM toks),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM post GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
stat AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{PATTERN}')) AS term FROM benchmark),
q AS (SELECT query_id, term, count(*) AS qf FROM qt GROUP BY ALL)"""

SCORED = """
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qf), 6) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), stat GROUP BY query_id, doc_id),
ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical.bm25(documents(spark, sf_dir), questions(spark, sf_dir))
    return lexical.top_k(scored, 10).select("query_id", "doc_id", "score", "rank")


def bm25_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical.bm25(documents(spark, sf_dir), questions(spark, sf_dir))
    return lexical.normalised(lexical.top_k(scored, 20)).select("query_id", "doc_id", "rank", "norm_score")


def bm25_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lexical.bm25(documents(spark, sf_dir), questions(spark, sf_dir))
    return lexical.page(scored, 2, 5).select("query_id", "doc_id", "rank", "total", "pages")


#: Fields of a document, as a posting has them, with their boosts, and those of a whole phrase.
BOOSTS = {"standard_job": 7.0, "title": 6.0, "job_family": 6.0, "skills": 5.0, "description": 1.0}
PHRASES = {"standard_job": 3.0, "title": 2.0, "job_family": 2.0, "skills": 1.5}


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: the first line is the job, the first two its title, source and language
    its family, what follows the first line its skills, and all of it the description."""
    d, text = table(spark, sf_dir, "documents"), F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n")
    return d.select(
        "doc_id", "source", "lang", lines[0].alias("standard_job"), F.array_join(F.slice(lines, 1, 2), " ").alias("title"), F.concat_ws(" ", "source", "lang").alias("job_family"),
        F.array_join(F.slice(lines, 2, F.greatest(F.lit(1), F.size(lines))), " ").alias("skills"), text.alias("description"),
    )


def bm25_multifield(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir)
    posted = lexical.postings(_fields(spark, sf_dir), list(BOOSTS), lexical.query_terms(asked))
    scored = lexical.multi_field(posted, BOOSTS, asked).withColumn("found", F.lit(True))
    phrase = lexical.phrases(posted, PHRASES, asked).select("query_id", "doc_id", "score", F.lit(False).alias("found"))
    # a phrase adds to what matches; alone it finds nothing
    total = scored.unionByName(phrase).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"), F.max("found").alias("found")).where("found")
    return lexical.top_k(total, 10).select("query_id", "doc_id", "score", "rank")


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold a whole question, how often, and what that adds to a score."""
    asked = questions(spark, sf_dir)
    posted = lexical.postings(_fields(spark, sf_dir), list(PHRASES), lexical.query_terms(asked))
    return lexical.phrases(posted, PHRASES, asked)


def bm25_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 200 of each question among the English documents of one source, with how many there
    are in all; the size asked for is beyond what a search returns."""
    asked = questions(spark, sf_dir)
    wanted = asked.select("query_id", F.concat(F.lit("src"), F.pmod("query_id", F.lit(20))).alias("source_type"), F.lit("In EN").alias("location"))
    fields = _fields(spark, sf_dir)
    posted = lexical.postings(fields, list(BOOSTS), lexical.query_terms(asked))
    place = F.arrays_overlap(lexical.tokens(F.col("lang")), lexical.tokens(F.col("location")))
    within = fields.select("doc_id", "source", "lang").join(wanted, F.col("source") == F.col("source_type")).where(place).select("query_id", "doc_id")
    scored = lexical.multi_field(posted, BOOSTS, asked, within=within)
    return lexical.page(scored, 1, lexical.clamped(1000)).select("query_id", "doc_id", "score", "rank", "total")


def _field_sql(name: str, text: str, boost: float, phrase: float | None) -> str:
    tokens = f"regexp_extract_all(lower({text}), '{PATTERN}')"
    held = "" if phrase is None else f""",
l_{name} AS (SELECT doc_id, t, ' ' || array_to_string(t, ' ') || ' ' AS l FROM t_{name}),
h_{name} AS (SELECT b.query_id, d.doc_id, d.t, b.t AS p, b.idf FROM l_{name} d JOIN (SELECT *, ' ' || array_to_string(t, ' ') || ' ' AS l FROM iq_{name} WHERE len(t) > 0) b ON contains(d.l, b.l)),
ph_{name} AS (SELECT query_id, doc_id, '{name}' AS field, CAST(times AS INTEGER) AS times, round({phrase} * idf * times / (times + 1.2 * (0.25 + 0.75 * dl / avgdl)), 6) AS score FROM
  (SELECT query_id, doc_id, idf, len(t) AS dl, len(list_filter(range(1, len(t) - len(p) + 2), lambda i: t[i:i + len(p) - 1] = p)) AS times FROM h_{name}), (SELECT avg(len(t)) AS avgdl FROM t_{name}) WHERE times > 0)"""
    asked = "" if phrase is None else f""",
iq_{name} AS (SELECT a.query_id, a.t, sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf FROM qa a JOIN (SELECT query_id, unnest(t) AS term FROM qa) x USING (query_id) JOIN d_{name} USING (term), (SELECT count(*) AS n FROM t_{name}) GROUP BY ALL)"""
    return f"""
t_{name} AS (SELECT doc_id, {tokens} AS t FROM fl),
f_{name} AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM t_{name}) GROUP BY ALL),
d_{name} AS (SELECT term, count(*) AS df FROM f_{name} GROUP BY term){asked}{held},
s_{name} AS (SELECT query_id, doc_id, {boost} * round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * qf), 6) AS score, count(*) AS matched
  FROM q JOIN f_{name} USING (term) JOIN d_{name} USING (term), (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM t_{name}) GROUP BY query_id, doc_id)"""


_FIELD_TEXTS = {"standard_job": "ln[1]", "title": "array_to_string(ln[1:2], ' ')", "job_family": "concat_ws(' ', source, lang)", "skills": "array_to_string(ln[2:], ' ')", "description": "x"}
FIELDS = f"""qt AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{PATTERN}')) AS term FROM benchmark),
qa AS (SELECT item_id AS query_id, regexp_extract_all(lower(text), '{PATTERN}') AS t FROM benchmark),
q AS (SELECT query_id, term, count(*) AS qf FROM qt GROUP BY ALL),
qs AS (SELECT query_id, count(*) AS terms FROM q GROUP BY query_id),
fl AS (SELECT doc_id, source, lang, coalesce(text, '') AS x, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents),
{",".join(_field_sql(n, t, BOOSTS[n], PHRASES.get(n)) for n, t in _FIELD_TEXTS.items())},
ph AS ({" UNION ALL ".join(f"SELECT * FROM ph_{n}" for n in PHRASES)}),
u AS ({" UNION ALL ".join(f"SELECT * FROM s_{n} WHERE score > 0" for n in BOOSTS)}),
m AS (SELECT query_id, doc_id, round(max(score) + 0.2 * (sum(score) - max(score)), 6) AS score FROM u JOIN qs USING (query_id) WHERE matched >= greatest(1, floor(0.2 * terms)) GROUP BY query_id, doc_id)"""

MULTIFIELD = f"""WITH {FIELDS},
tot AS (SELECT query_id, doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM m UNION ALL SELECT query_id, doc_id, ph.score FROM ph SEMI JOIN m USING (query_id, doc_id)) GROUP BY query_id, doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM tot) WHERE rank <= 10"""

FILTERED = f"""WITH {FIELDS}, wi AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON source = 'src' || item_id % 20 AND lang = 'en')
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, count(*) OVER (PARTITION BY query_id) AS total FROM m SEMI JOIN wi USING (query_id, doc_id) QUALIFY rank <= 200"""


def fuzzy_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    words = part.select(F.explode(F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")).alias("word")).distinct()
    # each word without its second letter, as a typist leaves one out
    typed = words.where(F.length("word") >= 3).select(F.concat(F.substring("word", 1, 1), F.expr("substring(word, 3)")).alias("term")).distinct()
    return lexical.fuzzy_vocabulary(typed, words)


FUZZY = """WITH w AS (SELECT DISTINCT unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS word FROM part),
t AS (SELECT DISTINCT substring(word, 1, 1) || substring(word, 3) AS term FROM w WHERE length(word) >= 3),
n AS (SELECT term, word, levenshtein(term, word) AS distance, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 5 THEN 1 ELSE 2 END AS allowed
  FROM t JOIN w ON substring(term, 1, 1) = substring(word, 1, 1))
SELECT term, word, distance FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY distance, word) AS r FROM n WHERE distance <= allowed) WHERE r <= 50"""


def more_like_this(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    chosen = table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 1").select("doc_id")
    return lexical.more_like_this(docs, chosen, 5).select("query_id", "doc_id", "score", "rank")


MORE_LIKE_THIS = f"""WITH {TOKENS},
ch AS (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 1),
w AS (SELECT doc_id AS query_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * ln(1 + (n - df + 0.5) / (df + 0.5)), 6) DESC, term) AS r
  FROM tf JOIN df USING (term), stat WHERE df >= 2 AND doc_id IN (SELECT doc_id FROM ch)),
mq AS (SELECT query_id, term, 1 AS qf FROM w WHERE r <= 12),
sc AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qf), 6) AS score
  FROM mq JOIN tf USING (term) JOIN df USING (term), stat GROUP BY query_id, doc_id)
SELECT * FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0 AND query_id != doc_id) WHERE rank <= 5"""

QUERIES = {
    "bm25_topk": (bm25_topk, f"WITH {TOKENS}, {SCORED} SELECT query_id, doc_id, score, rank FROM ranked WHERE rank <= 10"),
    "bm25_normalized": (
        bm25_normalized,
        f"""WITH {TOKENS}, {SCORED}, top AS (SELECT * FROM ranked WHERE rank <= 20)
SELECT query_id, doc_id, rank, CASE WHEN max(score) OVER w > min(score) OVER w THEN round((score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w), 6) ELSE 1.0 END AS norm_score
FROM top WINDOW w AS (PARTITION BY query_id)""",
    ),
    "bm25_page": (
        bm25_page,
        f"""WITH {TOKENS}, {SCORED}, t AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS total FROM ranked)
SELECT query_id, doc_id, rank, total, CAST(ceil(total / 5.0) AS BIGINT) AS pages FROM t WHERE rank BETWEEN 6 AND 10""",
    ),
    "bm25_multifield": (bm25_multifield, MULTIFIELD),
    "phrase_hits": (phrase_hits, f"WITH {FIELDS} SELECT query_id, doc_id, field, times, score FROM ph"),
    "bm25_filtered": (bm25_filtered, FILTERED),
    "fuzzy_vocab": (fuzzy_vocab, FUZZY),
    "more_like_this": (more_like_this, MORE_LIKE_THIS),
}

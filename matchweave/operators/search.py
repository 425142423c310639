"""Hybrid search: several retrievers, one merged list, filters, scores, pages and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scores as sc
from ..sources.shared import written
from . import candidates, lexical
from .vectors import cosine


def structured(jobs: DataFrame, place: str | None = None, low: int | None = None, high: int | None = None, job_type: str | None = None, level: str | None = None, remote: bool | None = None, visa: bool | None = None) -> DataFrame:
    """Jobs that pass the filters given; pay is tested on the lower bound."""
    tests: list[Column] = []
    if place is not None:
        tests.append((F.col("city") == place) | (F.col("state") == place))
    if low is not None:
        tests.append(F.col("min_salary") >= low)
    if high is not None:
        tests.append(F.col("min_salary") <= high)
    tests += [F.col(c) == v for c, v in (("job_type", job_type), ("level", level), ("remote", remote), ("sponsors", visa)) if v is not None]
    for t in tests:
        jobs = jobs.where(t)
    return jobs


def text_search(jobs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) over title (three times), description (twice) and all text."""
    fields = jobs.select(F.col("job_id").alias("doc_id"), "title", "description", F.concat_ws(" ", "title", "description", "skills").alias("all"))
    boosts = {"title": 3.0, "description": 2.0, "all": 1.0}
    posted = lexical.postings(fields, list(boosts), lexical.query_terms(queries))
    return lexical.top_k(lexical.multi_field(posted, boosts, queries, tie=0.0), k)


def fuzzy_text_search(jobs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank) of (job_id, title, description, skills: array, posted_date): query
    words as they stand in the jobs, or the words within one or two edits of them; the best of title
    (three times), description (twice) and all text, plus twice the skills' score, plus one for each
    skill that the query names exactly. Of equal scores the newest job comes first. Equal jobs are
    scored once, and only those of the best scores are looked up again."""
    by = ["title", "description", "skills"]
    jobs = jobs.select("job_id", "posted_date", *[F.coalesce(c, F.lit("")).alias(c) for c in by[:2]], F.coalesce("skills", F.array().cast("array<string>")).alias("skills"))
    said = written(candidates.fold(jobs, by, F.max("posted_date").alias("posted_date")), "fields").withColumn("skills_text", F.array_join("skills", " "))
    fields = said.select(F.col("job_id").alias("doc_id"), "copies", "title", "description", F.concat_ws(" ", "title", "description", "skills_text").alias("all"), F.col("skills_text").alias("skills"))
    words = fields.select(F.explode(F.array_distinct(lexical.tokens(F.col("all")))).alias("word")).distinct()
    terms = lexical.query_terms(queries)
    near = lexical.fuzzy_vocabulary(terms.select("term").distinct(), words)
    asked = terms.join(near, "term").groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("text"))
    asked = written(asked, "asked")
    posted = lexical.postings(fields, ["title", "description", "all", "skills"], lexical.query_terms(asked))
    best = lexical.multi_field(posted, {"title": 3.0, "description": 2.0, "all": 1.0}, asked, tie=0.0, share=0.0)
    skill = lexical.multi_field(posted, {"skills": 2.0}, asked, share=0.0)
    named = queries.select("query_id", F.explode(F.split(F.lower("text"), " ")).alias("skill")).distinct()
    exact = said.select(F.col("job_id").alias("doc_id"), F.explode("skills").alias("skill")).withColumn("skill", F.lower("skill")).join(named, "skill").groupBy("query_id", "doc_id").agg(F.countDistinct("skill").cast("double").alias("score"))
    total = best.unionByName(skill).unionByName(exact).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    # all of a score and date: which of them has the smallest number there is known once they are looked up
    dated = total.join(said.select(F.col("job_id").alias("doc_id"), "posted_date", *by), "doc_id")
    place = F.rank().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("posted_date")))
    best = written(dated.withColumn("place", place).where(F.col("place") <= k), "best")
    return candidates.unfold(best, jobs, by, k, F.desc("posted_date")).select("query_id", F.col("job_id").alias("doc_id"), "score", "rank")


def retrieve(lists: dict[str, DataFrame], cap: int = 400) -> DataFrame:
    """Ranked lists by source name, in order of precedence, merged to one list per query."""
    tagged = [df.select("query_id", "job_id", "rank", F.lit(name).alias("source"), F.lit(i).alias("o")) for i, (name, df) in enumerate(lists.items())]
    return candidates.merge(tagged, cap)


def rerank_by_similarity(merged: DataFrame, queries: DataFrame, jobs: DataFrame, boosted: str, boost: float = 1.5) -> DataFrame:
    """Cosine of query and job vectors, times ``boost`` for what the named source found."""
    pairs = merged.join(queries.select("query_id", F.col("embedding").alias("q")), "query_id").join(jobs.select("job_id", F.col("embedding").alias("e")), "job_id")
    score = cosine(F.col("q"), F.col("e")) * F.when(F.array_contains(F.split("sources", ","), boosted), boost).otherwise(1.0)
    return ranked(pairs.select("query_id", "job_id", "sources", F.round(score, 6).alias("score")))


def ranked(scored: DataFrame) -> DataFrame:
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "job_id")))


def ranked_whole(scored: DataFrame) -> DataFrame:
    """The same with few queries and many jobs each: a job's rank is the number of jobs with better scores
    and its place among those of its own, so a query's jobs spread over tasks by their score. ``scored`` is
    read twice and should be written."""
    same = scored.groupBy("query_id", "score").agg(F.count("*").alias("n"))
    better = same.select("query_id", "score", (F.sum("n").over(W.partitionBy("query_id").orderBy(F.desc("score"))) - F.col("n")).alias("better"))
    place = F.row_number().over(W.partitionBy("query_id", "score").orderBy("job_id"))
    return scored.join(better, ["query_id", "score"]).withColumn("rank", (F.col("better") + place).cast("int")).drop("better")


def with_fallback(found: DataFrame, plain: DataFrame, queries: DataFrame) -> DataFrame:
    """Results, and for queries without any, those of the plain search."""
    without = queries.select("query_id").join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.unionByName(plain.join(without, "query_id", "left_semi"))


def split_by_constraints(pairs: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Pairs that no rule is against, and the others with the first rule that is."""
    judged = pairs.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def follow_ups(rejected: DataFrame) -> DataFrame:
    """(query_id, prompts): what to ask a candidate, once each."""
    ask = F.create_map(*[F.lit(x) for kv in (("work authorisation", "Do you have work authorisation?"), ("no sponsorship", "Do you need sponsorship?"), ("certification", "Which certificates do you hold?"), ("degree", "What is your highest degree?"), ("years", "How many years have you worked?"), ("language", "Which languages do you speak?")) for x in kv])
    return rejected.groupBy("query_id").agg(F.array_sort(F.collect_set(F.element_at(ask, F.col("reason")))).alias("prompts"))


def path_reason(shared: Column, hops: Column, two_hop: Column) -> Column:
    """Why the graph found a job: a shared skill, else the path, else the related skills."""
    return F.coalesce(
        F.when(F.size(shared) > 0, F.concat(F.lit("requires "), shared[0])),
        F.when(hops > 0, F.concat(F.lit("reached in "), hops, F.lit(" steps"))),
        F.when(two_hop > 0, F.concat(two_hop, F.lit(" related skills"))),
    )


def factor_reasons(parts: dict[str, Column], need: Column, own: Column, place: Column, company: Column, **more: Column) -> Column:
    """A sentence for each factor of a reranking score, by factor; ``more``: what to say of others."""
    both, gap = F.array_sort(F.array_intersect(need, own)), F.array_sort(F.array_except(need, own))
    some = lambda a: F.when(F.size(a) > 0, F.array_join(F.slice(a, 1, 3), ", ")).otherwise("none")
    said = {
        "skill": F.concat(F.lit("shared: "), some(both), F.lit("; missing: "), some(gap)),
        "location": F.concat(F.lit("job in "), place),
        "company": F.concat(F.lit("at "), company),
        **more,
    }
    pairs = [x for name, c in parts.items() for x in (F.lit(name), F.concat_ws("; ", F.format_number(c, 2), said.get(name, F.lit(None).cast("string"))))]
    return F.create_map(*pairs)


def static_features(skills: DataFrame, related: DataFrame) -> DataFrame:
    """(job_id, required, preferred, near, near2) of jobs' skills (job_id, skill, required: boolean): how
    many a job requires and prefers, and how many skills lie one edge and up to two edges away from
    what it requires. Skills reach others once each, not once a job."""
    from .graph import reached, symmetric

    counts = skills.groupBy("job_id").agg(F.count_if("required").alias("required"), F.count_if(~F.col("required")).alias("preferred"))
    need = skills.where("required").select("job_id", "skill")
    names = need.select(F.col("skill").alias("query_id"), "skill").distinct()
    one = symmetric(related).select(F.col("src").alias("skill"), F.col("dst").alias("other")).distinct()
    two = reached(names, related).select(F.col("query_id").alias("skill"), F.col("skill").alias("other"))
    away = lambda edges, name: need.join(edges, "skill").groupBy("job_id").agg(F.countDistinct("other").alias(name))
    return counts.join(away(one, "near"), "job_id", "left").join(away(two, "near2"), "job_id", "left").fillna(0, ["near", "near2"])


def contents(skills: DataFrame, related: DataFrame) -> DataFrame:
    """(job_id, content): a digest of what a job's static features depend on: its own skills, and the
    related edges, which are summed up in one number."""
    both = F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst"))
    graph = related.select(both.alias("h")).distinct().agg(F.coalesce(F.bit_xor("h"), F.lit(0)).alias("g"), F.count("*").alias("n"))
    own = skills.groupBy("job_id").agg(F.array_sort(F.collect_set(F.concat_ws("|", "skill", F.col("required").cast("string")))).alias("s"))
    return own.crossJoin(F.broadcast(graph)).select("job_id", F.md5(F.concat_ws("\n", F.col("g").cast("string"), F.col("n").cast("string"), "s")).alias("content"))  # one row


def refreshed_features(known: DataFrame | None, skills: DataFrame, related: DataFrame) -> DataFrame:
    """Static features with their content, of all jobs: those of ``known`` whose content is the same stay
    as they are, others are worked out, and jobs that are no more go."""
    now = written(contents(skills, related), "contents")
    if known is None:
        return static_features(skills, related).join(now, "job_id")
    kept = known.join(now, ["job_id", "content"], "left_semi")
    new = written(now.join(known, ["job_id", "content"], "left_anti"), "changed")
    fresh = static_features(skills.join(new, "job_id", "left_semi"), related).join(new, "job_id")
    return kept.unionByName(fresh)


def hybrid(lists: dict[str, DataFrame], queries: DataFrame, jobs: DataFrame, boosted: str, number: int = 1, size: int = 10, cap: int = 400) -> DataFrame:
    """One page per query of the merged, reranked candidates."""
    best = rerank_by_similarity(retrieve(lists, cap), queries, jobs, boosted)
    return best.where(F.col("rank").between((number - 1) * size + 1, number * size))


def reranked(pairs: DataFrame, parts: dict[str, Column], weights: dict[str, float] | None = None) -> DataFrame:
    """Pairs with each factor once, their weighted score and rank; weights must add up to 1."""
    weights = weights or sc.RERANK_WEIGHTS
    one = pairs.select("*", *[p.alias(f"f_{n}") for n, p in parts.items()])
    return ranked(one.withColumn("score", F.round(sc.weighted({n: F.col(f"f_{n}") for n in weights}, weights), 6)))

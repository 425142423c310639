"""Pair scores as column expressions. Missing information gives the neutral 0.5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH_WEIGHTS = {"skill": 0.35, "semantic": 0.30, "location": 0.15, "salary": 0.12, "visa": 0.08}
FIT_WEIGHTS = {"skill": 0.4, "experience": 0.3, "location": 0.15, "salary": 0.1, "visa": 0.05}
RERANK_WEIGHTS = {"skill": 0.35, "experience": 0.25, "location": 0.15, "salary": 0.10, "semantic": 0.10, "company": 0.05}
KEYWORD_WEIGHTS = {"title": 0.30, "skill": 0.25, "location": 0.20, "salary": 0.15, "other": 0.10}
FUSION_WEIGHTS = {"bm25": 0.15, "semantic": 0.25, "coverage": 0.30, "family": 0.15, "graph": 0.15}


def check_weights(weights: dict[str, float]) -> dict[str, float]:
    if abs(sum(weights.values()) - 1) > 0.01:
        raise ValueError(f"weights add up to {sum(weights.values())}")
    return weights


def weighted(scores: dict[str, Column], weights: dict[str, float]) -> Column:
    check_weights(weights)
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * scores[name]
    return total


def skill_share(need: Column, own: Column) -> Column:
    """Share of the needed skills that are there; 0.5 when none is needed."""
    return F.when(F.size(need) > 0, F.size(F.array_intersect(need, own)) / F.size(need)).otherwise(0.5)


def location_match(city: Column, state: Column, place: Column) -> Column:
    job, mine = F.lower(F.concat(city, F.lit(", "), state)), F.lower(place)
    return F.when(mine.isNull() | job.isNull(), 0.5).when(F.contains(job, mine) | F.contains(mine, job), 1.0).when(F.contains(mine, F.lower(state)), 0.8).otherwise(0.3)


def salary_match(low: Column, high: Column, wanted: Column) -> Column:
    top = F.coalesce(high, low)
    return F.when(wanted.isNull() | low.isNull(), 0.5).when(wanted.between(low, top), 1.0).when(wanted < low, 0.3).otherwise(0.7)


def visa_match(needs: Column, sponsors: Column) -> Column:
    return F.when(needs.isNull(), 0.5).when(~needs, 0.8).when(sponsors, 1.0).otherwise(0.0)


def years_for(level: Column) -> Column:
    return F.when(level == "entry", 0).when(level == "senior", 5).otherwise(2)


def experience_match(level: Column, years: Column) -> Column:
    need = years_for(level)
    return F.when(years >= need, 1.0).when(years > 0, years / F.greatest(need, F.lit(1))).otherwise(0.0)


def fit(score: Column) -> Column:
    return F.when(score >= 0.8, "excellent").when(score >= 0.6, "good").when(score >= 0.4, "fair").otherwise("poor")


def fuzzy_skills(need: Column, own: Column) -> Column:
    """Per needed skill the first own skill that is equal, inside it, around it, or has a word in
    it; null where there is none."""

    def found(job: Column) -> Column:
        close = lambda mine: (mine == job) | F.contains(job, mine) | F.contains(mine, job) | F.exists(F.split(mine, r"\s+"), lambda w: F.contains(job, w))
        return F.get(F.filter(own, close), F.lit(0))

    return F.transform(need, found)


def skill_words(own: Column) -> Column:
    """The different words of own skills."""
    return F.array_distinct(F.flatten(F.transform(own, lambda x: F.split(x, r"\s+"))))


def fuzzy_missing(need: Column, own: Column, words: Column) -> Column:
    """The needed skills for which ``fuzzy_skills`` finds none; ``words``: ``skill_words`` of the own ones. A
    skill inside a needed one has its words there too, so words and skills around it are enough."""
    return F.filter(need, lambda job: ~(F.exists(words, lambda w: F.contains(job, w)) | F.exists(own, lambda mine: F.contains(mine, job))))


def skill_factor(need: Column, own: Column) -> Column:
    """Share of needed skills, a bonus for others (0.2 at most), less for missing ones (0.3 at most)."""
    bonus = F.least(0.05 * F.size(F.array_except(own, need)), F.lit(0.2))
    malus = F.least(0.1 * F.size(F.array_except(need, own)), F.lit(0.3))
    raw = F.size(F.array_intersect(need, own)) / F.size(need) + bonus - malus
    return F.when((F.size(need) == 0) | (F.size(own) == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def level_rank(level: Column) -> Column:
    return F.when(level == "entry", 1).when(level == "senior", 3).when(level == "executive", 4).otherwise(2)


def candidate_rank(entries: Column, senior: Column) -> Column:
    return F.when(senior | (entries >= 5), 3).when(entries >= 2, 2).otherwise(1)


def experience_factor(level: Column, candidate: Column) -> Column:
    gap = F.abs(level_rank(level) - candidate)
    return F.when(gap == 0, 1.0).when(gap == 1, 0.8).when(gap == 2, 0.5).otherwise(0.2)


def location_factor(city: Column, state: Column, remote: Column, wanted: Column) -> Column:
    """``wanted``: array of places; exact 1, same state 0.7, remote 0.8."""
    mine = F.transform(wanted, lambda x: F.lower(x))
    states = F.transform(mine, lambda x: F.trim(F.substring_index(x, ",", -1)))
    job = F.lower(F.concat(city, F.lit(", "), state))
    return (
        F.when(wanted.isNull() | (F.size(wanted) == 0), 0.5)
        .when(F.array_contains(mine, job), 1.0)
        .when(F.array_contains(states, F.lower(state)), 0.7)
        .when(remote & F.exists(mine, lambda x: F.contains(x, F.lit("remote"))), 0.8)
        .otherwise(0.3)
    )


def salary_factor(low: Column, high: Column, wanted: Column) -> Column:
    """Anything under the range counts as near it, as in the rules that this follows."""
    top = F.coalesce(high, low * 1.2)
    return F.when(wanted.isNull() | low.isNull(), 0.5).when(wanted.between(low, top), 1.0).when(wanted <= top * 1.1, 0.8).otherwise(0.6)


def company_factor(company: Column, past: Column) -> Column:
    words = F.split(F.lower(company), r"\s+")
    return F.when(F.exists(past, lambda p: F.arrays_overlap(words, F.split(F.lower(p), r"\s+"))), 0.8).otherwise(0.5)


def title_keyword(title: Column, asked: Column) -> Column:
    t = F.lower(title)
    whole = F.exists(asked, lambda a: F.contains(t, F.lower(a)))
    part = F.exists(asked, lambda a: F.exists(F.split(F.lower(a), r"\s+"), lambda w: (F.length(w) > 3) & F.contains(t, w)))
    return F.when(whole, 1.0).when(part, 0.7).otherwise(0.0)


def skill_keyword(need: Column, asked: Column) -> Column:
    hits = F.size(F.filter(asked, lambda a: F.exists(need, lambda n: F.contains(F.lower(n), F.lower(a)))))
    return F.when(F.size(asked) > 0, F.least(hits / F.size(asked), F.lit(1.0))).otherwise(0.0)


def salary_keyword(low: Column, high: Column, asked_low: Column, asked_high: Column) -> Column:
    """Overlap as a share of what is asked, else nearness. A point inside the range scores 0."""
    span = F.when(asked_high > asked_low, asked_high - asked_low).otherwise(1)
    overlap = F.least((F.least(asked_high, high) - F.greatest(asked_low, low)) / span, F.lit(1.0))
    above, below = F.greatest(F.lit(0.0), 1 - (asked_low - high) / asked_low), F.greatest(F.lit(0.0), 1 - (low - asked_high) / low)
    return F.when(asked_low.isNull() | low.isNull(), 0.0).when((asked_high >= low) & (asked_low <= high), overlap).when(asked_low > high, above).otherwise(below)


def top_parts(scores: dict[str, Column], weights: dict[str, float], k: int = 3) -> Column:
    """The k parts that add most: structs of name, score, weight, contribution and percent."""
    parts = [F.struct(F.lit(n).alias("name"), scores[n].alias("score"), F.lit(w).alias("weight"), F.round(scores[n] * w, 6).alias("contribution"), F.floor(scores[n] * 100).cast("int").alias("percent")) for n, w in weights.items()]
    by_value = lambda a, b: F.when(a["contribution"] > b["contribution"], -1).when(a["contribution"] < b["contribution"], 1).when(a["name"] < b["name"], -1).otherwise(1)
    return F.slice(F.array_sort(F.array(*parts), by_value), 1, k)


def verdict(final: Column) -> Column:
    return F.when(final >= 0.75, "very good match").when(final >= 0.55, "good match").when(final >= 0.35, "partial match").otherwise("weak match")


def fusion_text(scores: dict[str, Column], final: Column, missing: Column) -> Column:
    """Verdict, strong and weak factors, missing skills and advice in one line."""
    names = lambda test: F.array_join(F.filter(F.array(*[F.when(test(c), F.lit(n)) for n, c in scores.items()]), lambda x: x.isNotNull()), ", ")
    strong, weak, gaps = names(lambda c: c >= 0.7), names(lambda c: c < 0.4), F.array_join(missing, ", ")
    best = top_parts(scores, FUSION_WEIGHTS, 1)[0]["name"]
    advice = F.when(F.size(missing) > 0, F.concat(F.lit("learn "), gaps)).when(final < 0.5, F.concat(F.lit("broaden "), best)).otherwise("apply")
    blank = lambda c: F.when(c == "", "none").otherwise(c)
    return F.concat(verdict(final), F.lit("; strong: "), blank(strong), F.lit("; weak: "), blank(weak), F.lit("; missing: "), blank(gaps), F.lit("; advice: "), advice)


def constraint_reason(c: dict[str, Column], candidate: dict[str, Column]) -> Column:
    """Why a posting rules a candidate out, or null; the first rule that is broken counts.

    ``candidate``: needs_visa (boolean), certifications and languages (arrays), degree (0..4, -1
    for none) and years."""
    level = F.when(c["min_degree"] == "associate", 1).when(c["min_degree"] == "bachelor", 2).when(c["min_degree"] == "master", 3).when(c["min_degree"] == "doctorate", 4)
    needs = F.coalesce(candidate["needs_visa"], F.lit(False))
    return (
        F.when(c["requires_work_authorisation"] & c["no_sponsorship"] & needs, "work authorisation")
        .when(c["no_sponsorship"] & needs, "no sponsorship")
        .when(F.size(F.array_except(c["certifications"], candidate["certifications"])) > 0, "certification")
        .when(level > candidate["degree"], "degree")
        .when(c["min_years"] > candidate["years"], "years")
        .when(F.size(F.array_except(c["languages"], candidate["languages"])) > 0, "language")
    )


def lexical_features(text_score: Column, query: Column, title: Column, need: Column, asked: Column, city: Column, state: Column) -> dict[str, Column]:
    t, q = F.lower(title), F.lower(F.coalesce(query, F.lit("")))
    return {
        "text_score": F.coalesce(text_score, F.lit(0.0)),
        "title_hit": F.contains(t, q).cast("int"),
        "skill_overlap": F.when(F.size(asked) > 0, F.size(F.array_intersect(need, asked)) / F.size(asked)).otherwise(0.0),
        "place_named": (F.contains(q, F.lower(city)) | F.contains(q, F.lower(state))).cast("int"),
    }


def keyword_mix(keyword: Column, original: Column, share: float = 0.6) -> Column:
    """Keyword and original score in one: 60 to 40."""
    return share * keyword + (1 - share) * original


def degree_value(degrees: Column) -> Column:
    """The highest degree named: 0 for high school to 4 for a doctorate, -1 for none."""
    level = lambda d: F.when(F.contains(d, F.lit("high_school")), 0).when(F.contains(d, F.lit("associate")), 1).when(F.contains(d, F.lit("bachelor")), 2).when(F.contains(d, F.lit("master")), 3).when(F.contains(d, F.lit("doctorate")), 4).otherwise(-1)
    return F.coalesce(F.array_max(F.transform(degrees, lambda d: level(F.lower(d)))), F.lit(-1))


def worked_years(entries: Column, skill_years: Column, now: Column) -> Column:
    """Years over entries (start, end): days over 365.25, an open one up to ``now``, none under 0; where
    that is 0, the years of the skills."""
    days = lambda e: F.when(e["start"].isNull(), 0).otherwise(F.greatest(F.lit(0), F.date_diff(F.coalesce(e["end"], now), e["start"])))
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + days(e) / 365.25)
    listed = F.aggregate(skill_years, F.lit(0.0), lambda s, y: s + F.coalesce(y, F.lit(0)).cast("double"))
    return F.when(F.coalesce(total, F.lit(0.0)) > 0, total).otherwise(F.coalesce(listed, F.lit(0.0)))


def attributions(features: dict[str, Column], k: int = 3) -> Column:
    """The k features of largest size as 'name=+0.00' (half to even), joined by a comma."""
    parts = F.array(*[F.struct(F.lit(n).alias("n"), c.cast("double").alias("v")) for n, c in features.items()])
    order = lambda a, b: F.when(F.abs(a["v"]) > F.abs(b["v"]), -1).when(F.abs(a["v"]) < F.abs(b["v"]), 1).when(a["n"] < b["n"], -1).otherwise(1)
    return F.array_join(F.transform(F.slice(F.array_sort(parts, order), 1, k), lambda x: F.format_string("%s=%+.2f", x["n"], F.bround(x["v"], 2))), ", ")

"""Exact n-gram Jaccard self-join by a size-aware heavy-light split, and its components.

Two sets of sizes s <= t reach the threshold J exactly if they share c(s, t) = ceil((s + t) *
J / (1 + J)) shingles. Light sets (size up to a boundary) enumerate their subsets of the sizes
c that their partners ask for: equal subsets meet. Heavy sets, and those light ones that a
heavy set can match, put their rarest shingles (a prefix of n - ceil(J * n) + 1) into inverted
lists: linked sets meet in at least one. The boundary is the size at which the rows that
enumeration writes stop being cheaper than lists, from the counts of small sizes.

Rare means: by a sketch of fixed size that counts all shingles of all documents. It only
orders the shingles, so its errors cost time, never links.

Equal sets are one class from the start. Lists are then resolved in two passes. First each
member meets a few hubs of its list (per size class): the members that hold the fewest rarer
shingles, so the ones nearest to what the list shares. Those that meet a hub in many lists are
compared with it, links are closed to components, and lists whose members are all in one
component are done. Then all members of one list that are still in different components meet,
if the shingle stands early enough in both: sets of sizes s and t that share c(s, t) shingles
share one that is among the first s - c + 1 of the one and the first t - c + 1 of the other.
Of these pairs, the lists they share in all bound what they can share: past its prefix the set
whose prefix ends first adds n - p shingles at most. Those that can reach the threshold are
compared.
Every comparison counts the shared shingles of the two full sets. So a group of near copies
costs a few comparisons per copy, and no link between different texts is lost: a pair that is
never compared is connected already, or cannot reach the threshold.

Edge cases: a document without words (null, empty) has no shingles and links with nothing; one
with fewer words than a shingle has its whole sequence as its only shingle; a row without doc_id
links with nothing and has no component; doc_id must tell texts apart (of different texts under
one id, the smallest text and the smallest class stand for it), and a repeated row is returned as
often as it occurs; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, mix, repeated_keys, rolling, word_hashes
from .components import components

WORDS, NUM, DEN = 5, 75, 100
SKETCH_BITS = 22
SKETCH_PARTS = 32
#: Rows of an inverted list cost about so many rows of enumerated subsets (their sets are fetched).
LIST_COST = 8
LARGEST_BOUNDARY = 9
#: Hubs of a list and size class.
HUBS = 6
#: Ids of compared documents fall into so many buckets, which bound what is broadcast.
ID_BUCKETS = 1 << 19
#: Sets that a task remembers in order to see equal ones.
SEEN = 200_000

_SHINGLE, _WHOLE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    if len(h) < words:
        return rolling(h, len(h), _WHOLE + 2 * len(h))
    s = np.sort(rolling(h, words, _SHINGLE))
    return s[np.append(True, s[1:] != s[:-1])]


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    h = s ^ (s >> np.uint64(29))
    h *= np.uint64(_SHINGLE)
    one = h.sum(dtype=np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(_WHOLE)
    h ^= h >> np.uint64(29)
    return int(one.view(np.int64)), int(h.sum(dtype=np.uint64).view(np.int64))


def shared(s: int, t: int, num: int = NUM, den: int = DEN) -> int:
    """Least number of shared shingles that links sets of these sizes."""
    return -(-num * (s + t) // (num + den))


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def least_lists(n: Column, m: Column, boundary: int, num: int = NUM, den: int = DEN) -> Column:
    """Least number of lists that linked sets of sizes ``n`` and ``m`` share."""
    needed = F.ceil(num * (n + m) / (num + den) - 1e-9)
    some = F.least(needed - F.ceil(num * n / den - 1e-9) + 1, needed - F.ceil(num * m / den - 1e-9) + 1)
    return F.when(F.least(n, m) <= boundary, F.lit(1)).otherwise(F.greatest(F.lit(1), some))


def subset_sizes(n: int, boundary: int, num: int = NUM, den: int = DEN) -> list[int]:
    """Subset sizes that a light set of ``n`` enumerates: one for each size of a light partner."""
    return sorted({shared(min(n, t), max(n, t), num, den) for t in range(1, boundary + 1) if den * min(n, t) >= num * max(n, t)})


def choose_boundary(counts: dict[int, int], num: int = NUM, den: int = DEN) -> int:
    """The boundary of light sets at which subsets and lists together cost least."""

    def cost(boundary: int) -> int:
        light = sum(n * sum(math.comb(size, c) for c in subset_sizes(size, boundary, num, den)) for size, n in counts.items() if 0 < size <= boundary)
        lists = sum(n * prefix_length(size, num, den) for size, n in counts.items() if den * size >= num * (boundary + 1))
        return light + LIST_COST * lists

    return min(range(LARGEST_BOUNDARY + 1), key=cost)


def _as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _survey(docs: DataFrame, kind: str, words: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, f1, f2, own) of every row, and the sketch's level of each bucket (0: rare).

    ``own``: the first document of the row's task that has an equal set, perhaps itself."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        seen: dict = {}
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                s = shingles(text, words)
                np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).view(np.int64), 1)
                mark = (len(s), *fingerprint(s))
                own = doc
                if doc is not None:  # a row without an id stands for no other
                    own = seen.get(mark, doc)
                    if own is doc and len(seen) < SEEN:
                        seen[mark] = doc
                rows.append((doc, *mark, own, -1, None))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "f1", "f2", "own", "part", "counts"])
        for part, some in enumerate(np.split(counts, SKETCH_PARTS)):
            yield pd.DataFrame({"doc_id": [None], "n": [0], "f1": [0], "f2": [0], "own": [None], "part": [part], "counts": [np.minimum(some, 255).astype("<u1").tobytes()]}).astype({"doc_id": object, "own": object})

    size, kind_of = (1 << SKETCH_BITS) // SKETCH_PARTS, {1: "<u1", 4: "<u4"}  # of tasks, of sums

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, kind_of[len(c) // size]).astype(np.int64) for c in parts["counts"])
        return pd.DataFrame({"part": parts["part"].iloc[:1], "counts": [np.minimum(total, 2**32 - 1).astype("<u4").tobytes()]})

    # ids travel as strings: a batch with nulls would make them floats
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    scanned = cut(named.mapInPandas(scan, "doc_id string, n long, f1 long, f2 long, own string, part int, counts binary"), "survey")
    rows_of = scanned.where("part < 0").select(F.col("doc_id").cast(kind).alias("doc_id"), "n", "f1", "f2", F.col("own").cast(kind).alias("own"))
    sketches = scanned.where("part >= 0").select("part", "counts")
    # summed in two steps, so that no task reads the sketches of all tasks
    some = sketches.withColumn("s", F.floor(F.rand(1) * 16)).groupBy("part", "s").applyInPandas(add, "part int, counts binary")
    rows = some.groupBy("part").applyInPandas(add, "part int, counts binary").orderBy("part").collect()
    if not rows:
        return rows_of, np.zeros(1 << SKETCH_BITS, np.uint8)
    counts = np.concatenate([np.frombuffer(r["counts"], "<u4") for r in rows]).astype(np.float32)
    usual = float(np.median(counts))
    counts -= usual
    counts /= 2.5 * math.sqrt(usual + 1)
    level = np.clip(counts, 0, 255, out=counts).astype(np.uint8)
    return rows_of, level


def _classes(survey: DataFrame) -> DataFrame:
    """(doc_id, n, rep): of equal sets the smallest id is the class. A set that a third of all
    documents hold is joined once a task, not once a document."""
    equal = survey.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("rep"))
    heads = survey.where("n > 0 and own = doc_id").select("own", "f1", "f2", "n").dropDuplicates(["own", "f1", "f2", "n"])
    named = cut(heads.join(equal, ["f1", "f2", "n"]).select("own", "f1", "f2", "n", "rep"), "heads")
    return survey.join(named, ["own", "f1", "f2", "n"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))


def _keys(s: np.ndarray, level: np.ndarray, boundary: int, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(keys, places) of a set: its subsets, all at place 0, and its rarest shingles in order."""
    n, out = len(s), []
    if 0 < n <= boundary:
        for c in subset_sizes(n, boundary, num, den):
            keys = np.array([mix(np.array([sum(int(x) for x in part) % 2**64], np.uint64) ^ np.uint64(_WHOLE + c))[0] for part in combinations(s, c)], np.uint64)
            out.append((keys, np.zeros(len(keys), np.int32)))
    if n and den * n >= num * (boundary + 1):
        k = prefix_length(n, num, den)
        rank = level[(s >> np.uint64(64 - SKETCH_BITS)).view(np.int64)].astype(np.uint64)
        order = (rank << np.uint64(56)) | (mix(s ^ np.uint64(_SHINGLE)) >> np.uint64(8))
        first = np.argpartition(order, k - 1)[:k] if k < n else np.arange(n)
        out.append((s[first[np.argsort(order[first])]], np.arange(len(first), dtype=np.int32)))
    return out


def _postings(docs: DataFrame, kind: str, words: int, level: np.ndarray, boundary: int, num: int, den: int) -> DataFrame:
    """(key, doc_id, place) of every enumerated subset and list entry; of equal sets in a task, one."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                keys, owners, places = [], [], []
                for doc, text in zip(part["doc_id"], part["text"]):
                    s = shingles(text, words)
                    mark = (len(s), *fingerprint(s))
                    if not len(s) or mark in seen:
                        continue
                    if len(seen) < SEEN:
                        seen.add(mark)
                    for k, place in _keys(s, level, boundary, num, den):
                        keys.append(k)
                        owners.append(np.full(len(k), doc))
                        places.append(place)
                if keys:
                    yield pd.DataFrame({"key": _as_long(np.concatenate(keys)), "doc_id": np.concatenate(owners), "place": np.concatenate(places)})

    return docs.mapInPandas(scan, f"key long, doc_id {kind}, place int")


def _sets(docs: DataFrame, pairs: DataFrame, kind: str, words: int) -> DataFrame:
    """(doc_id, s): the shingles of the documents of the pairs (u, v)."""
    ids = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                yield pd.DataFrame({"doc_id": part["doc_id"], "s": [shingles(t, words).tobytes() for t in part["text"]]})

    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(ID_BUCKETS)).alias("bucket")
    # at most ID_BUCKETS rows: thins the texts before they are shuffled to the exact join
    near = docs.withColumn("bucket", bucket).join(F.broadcast(ids.select(bucket).distinct()), "bucket", "left_semi").drop("bucket")
    wanted = near.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return cut(wanted.select("doc_id", "text").mapInPandas(scan, f"doc_id {kind}, s binary"), "sets")


def _linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose full sets reach the threshold."""

    @F.pandas_udf("boolean")
    def reach(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(den * both >= num * (len(x) + len(y) - both))
        return pd.Series(out, dtype=bool)

    sides = pairs.join(sets.withColumnsRenamed({"doc_id": "u", "s": "su"}), "u").join(sets.withColumnsRenamed({"doc_id": "v", "s": "sv"}), "v")
    return cut(sides.where(reach("su", "sv")).select("u", "v"), "links")


def join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """Per document: doc_id, n_shingles and component_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text")
    survey, level = _survey(docs, kind, words)
    docs = docs.where("doc_id is not null")
    boundary = choose_boundary({r["n"]: r["count"] for r in survey.where(F.col("n").between(1, 2 * LARGEST_BOUNDARY)).groupBy("n").count().collect()}, num, den)

    classes = cut(_classes(survey), "classes")

    posted = _postings(docs, kind, words, level, boundary, num, den)
    repeated = cut(posted.repartition("key").sortWithinPartitions("key").mapInPandas(repeated_keys, posted.schema), "lists")
    # size classes: sets that can link are in the same class or in neighbouring ones
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9)
    member = repeated.join(classes.groupBy("doc_id").agg(F.min(F.struct("rep", "n")).alias("c")).select("doc_id", "c.rep", "c.n"), "doc_id").groupBy("key", F.col("rep").alias("u"), "n", step.cast("int").alias("size")).agg(F.min("place").alias("p"))
    lists = cut(member, "members")

    fits = (den * F.col("n") >= num * F.col("m")) & (den * F.col("m") >= num * F.col("n"))
    needed = F.ceil(num * (F.col("n") + F.col("m")) / (num + den) - 1e-9)
    early = (F.col("p") <= F.col("n") - needed) & (F.col("q") <= F.col("m") - needed)
    least = least_lists(F.col("n"), F.col("m"), boundary, num, den)
    left, right = F.struct(F.col("u").alias("i"), F.col("n").alias("k")), F.struct(F.col("v").alias("i"), F.col("m").alias("k"))

    def met(rows: DataFrame) -> DataFrame:
        """(u, v, n, m, lists): the different pairs of the rows and how many lists they meet in."""
        pair = rows.select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        return pair.groupBy(F.col("a.i").alias("u"), F.col("b.i").alias("v"), F.col("a.k").alias("n"), F.col("b.k").alias("m")).agg(F.count("*").alias("lists"))

    def partners(rows: DataFrame, *more: str) -> DataFrame:
        """Rows as (key, size, own, v, m, q), where ``size`` is each class that may meet them."""
        return rows.select("key", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), F.col("size").alias("own"), F.col("u").alias("v"), F.col("n").alias("m"), F.col("p").alias("q"), *more)

    meet = [F.col("l.key") == F.col("h.key"), F.col("l.size") == F.col("h.size"), fits]
    first = F.row_number().over(W.partitionBy("key", "size").orderBy("p", F.xxhash64("u"), "u"))
    hubs = lists.withColumn("r", first).where(F.col("r") <= HUBS)
    # a guess of what is worth comparing; the second pass loses nothing by it
    likely = met(lists.alias("l").join(partners(hubs).alias("h"), [*meet, F.col("u") != F.col("v")])).where(2 * F.col("lists") > least)
    likely = cut(likely.select("u", "v"), "hub-pairs")
    links = _linked(likely, _sets(docs, likely, kind, words), num, den)
    joined = cut(components(links), "joined")

    known = lists.join(joined, F.col("u") == F.col("node"), "left").withColumn("c", F.coalesce("component", "u"))
    mixed = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    open_ = known.join(mixed, "key", "left_semi").select("key", "u", "n", "size", "p", "c")
    open_ = cut(open_, "open")
    # each pair once: from the larger id of one size class, or from the class above
    once = (F.col("h.own") != F.col("l.size")) | (F.col("u") > F.col("v"))
    other = partners(open_, "c").withColumnRenamed("c", "d")
    rest = met(open_.alias("l").join(other.alias("h"), [*meet, F.col("c") != F.col("d"), once, early])).withColumnRenamed("lists", "early")
    rest = cut(rest.join(likely, ["u", "v"], "left_anti"), "open-pairs")
    # how many lists they share in all bounds what they can share; a document has few of them
    held = open_.groupBy("u").agg(F.collect_list("key").alias("ku"))
    rest = rest.join(held, "u").join(held.withColumnsRenamed({"u": "v", "ku": "kv"}), "v").where(F.size(F.array_intersect("ku", "kv")) >= least)
    rest = cut(rest.select("u", "v"), "close-pairs")
    final = cut(components(links.union(_linked(rest, _sets(docs, rest, kind, words), num, den))), "components")
    return classes.join(final, F.col("rep") == F.col("node"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones, the one with the smallest id, with all its
    columns; documents that link with nothing stay."""
    groups = join(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(groups, "doc_id", "left_anti").select(*docs.columns)

"""Scores of texts by prediction by partial matching, beside a plain word model.

The model is a trie of byte contexts of up to ``ORDER`` bytes: each node holds the bytes that
followed its context in the training texts and how often. A byte is predicted at the longest
known context; with the escape estimate of method C (kinds / (total + kinds)) it is left for the
next shorter one, where bytes that a longer context has seen are excluded, and in the end for
all bytes alike. A text's score adds the log10 probabilities of its UTF-8 bytes and of an end
mark; before its first byte stand start marks. Both marks are bytes that UTF-8 does not use.

Every training text counts. The trie is a table (``fit``), summed from the byte runs of blocks of
texts. It is never held whole: a block asks for the probability of each of its distinct runs,
which is worked out once per distinct run by joins down the trie, and adds up what it gets back.
Blocks have about ``BLOCK_BYTES`` of text, whatever the size of the corpus, and a text is never
cut. A node has 256 bytes at most, and so has a join that many rows of a key at most.

The word model is add-one smoothing over words in lower case (A-Z) and one end token per text.

Edge cases: a null text is empty (only the end mark and the end token); a row without doc_id is
held out; repeated rows each give a row; without training texts every byte has probability
1/256; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

#: Bytes of the longest context.
ORDER = 4
BLOCK_BYTES = 32 << 20
#: Bytes that are taken apart at once.
PIECE_BYTES = 1 << 20
#: The end token of the word model: no word is empty.
END_TOKEN = b""

_START, _END = b"\xff", b"\xfe"
_BYTES = 256


def runs(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The byte runs of the texts (context, then the byte it predicts, as one integer) and where
    each text's begin; a text has one run per byte and one for its end."""
    data = np.frombuffer(b"".join(_START * order + t + _END for t in texts), np.uint8).astype(np.int64)
    n = len(data) - order
    key = np.zeros(max(n, 0), np.int64)
    for i in range(order + 1):
        key = (key << 8) | data[i : i + n]
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    # runs that end in a start mark predict nothing
    ends = np.cumsum(lengths + order) - order
    inside = np.ones(len(key), bool)
    for i in range(order):
        inside[ends[:-1] + i] = False
    return key[inside], np.cumsum(lengths) - lengths


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``PIECE_BYTES`` each."""
    first = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= PIECE_BYTES:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.add.reduceat(n, first)


def survey(docs: DataFrame, learn: Column, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The blocks as one written table of three kinds of rows: 0 a text of a block (doc_id as a
    string), 1 a byte run of a block and how often it occurs in its training texts, 2 a word of a
    block, likewise."""
    schema = "kind int, block long, doc_id string, learn boolean, text binary, run long, word binary, n long"
    target = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.string()), ("learn", pa.bool_()), ("text", pa.binary()), ("run", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def rows(count: int, **columns) -> pa.RecordBatch:
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in target]
        return pa.RecordBatch.from_arrays(arrays, schema=target)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        found: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter = Counter()

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal found
            keys, n = _merge(found)
            for at in range(0, len(keys), 100_000):
                some = keys[at : at + 100_000]
                yield rows(len(some), kind=np.ones(len(some), np.int32), block=np.full(len(some), block), run=some, n=n[at : at + 100_000])
            listed = list(words.items())
            for at in range(0, len(listed), 20_000):
                some = listed[at : at + 20_000]
                yield rows(len(some), kind=np.full(len(some), 2, np.int32), block=np.full(len(some), block), word=[w for w, _ in some], n=[k for _, k in some])
            found = []
            words.clear()

        for batch in batches:
            texts, taught = batch.column("text").to_pylist(), np.array(batch.column("learn").to_pylist(), bool)
            for a, b in _pieces([*map(len, texts)]):
                some = texts[a:b]
                yield rows(b - a, kind=np.zeros(b - a, np.int32), block=np.full(b - a, block), doc_id=batch.column("doc_id")[a:b], learn=taught[a:b], text=some)
                for flag in (True, False):
                    own = [t for t, k in zip(some, taught[a:b]) if k == flag]
                    if not own:
                        continue
                    keys, n = np.unique(runs(own, order)[0], return_counts=True)
                    found.append((keys, n * flag))
                    if flag:
                        for t in own:
                            words.update(t.lower().split())
                    else:
                        words.update(dict.fromkeys({w for t in own for w in t.lower().split()}, 0))
                    words[END_TOKEN] += len(own) * flag
                if len(found) >= 64:
                    found = [_merge(found)]
                size += sum(map(len, some))
                if size >= block_bytes:
                    yield from close()
                    block, size = block + 1, 0
        yield from close()

    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))
    return cut(source.mapInArrow(scan, schema), "blocks", compression="zstd")


def _suffix(run: Column, size: int) -> Column:
    return run.bitwiseAND(F.lit((1 << 8 * size) - 1))


def trie(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(depth, context, total, kinds, next, masked) of distinct runs (run, n): a node per context that
    occurs, with the counts of the bytes that follow it. ``masked`` is how often those bytes follow
    the context that is one byte shorter, which is what excluding them takes away there."""
    levels = F.array(*[F.struct(F.lit(k).alias("depth"), _suffix(F.col("run"), k + 1).alias("run")) for k in range(order + 1)])
    edges = counted.where("n > 0").select("n", F.inline(levels)).groupBy("depth", "run").agg(F.sum("n").alias("n"))
    byte = F.col("run").bitwiseAND(F.lit(255)).cast("int")
    nodes = edges.groupBy("depth", F.shiftright("run", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count("*").alias("kinds"), F.map_from_entries(F.collect_list(F.struct(byte.alias("byte"), "n"))).alias("next")
    )
    nodes = cut(nodes, "nodes")
    shorter = F.lit(None).cast("long")
    for k in range(1, order + 1):
        shorter = F.when(F.col("depth") == k, _suffix(F.col("context"), k - 1)).otherwise(shorter)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("context").alias("shorter"), F.col("next").alias("all"))
    taken = F.aggregate(F.map_keys("next"), F.lit(0).cast("long"), lambda s, b: s + F.element_at("all", b))
    masked = nodes.withColumn("shorter", shorter).join(above, ["depth", "shorter"], "left").select("depth", "context", "total", "kinds", "next", F.coalesce(taken, F.lit(0).cast("long")).alias("masked"))
    return cut(masked, "trie")


def probabilities(asked: DataFrame, nodes: DataFrame, order: int = ORDER) -> DataFrame:
    """(run, p): log10 probability of the last byte of each distinct run after the bytes before it."""
    byte = F.col("run").bitwiseAND(F.lit(255)).cast("int")
    zero = F.lit(0).cast("long")
    state = asked.select("run", F.lit(0.0).alias("p"), zero.alias("taken"), zero.alias("gone"))
    known = []
    for depth in range(order, -1, -1):
        node = nodes.where(F.col("depth") == depth).select("context", "total", "kinds", "next", "masked")
        met = state.withColumn("context", F.shiftright(_suffix(F.col("run"), depth + 1), 8)).join(node, "context", "left")
        met = met.withColumn("n", F.element_at("next", byte)).withColumns({"left": F.col("total") - F.col("taken"), "kinds_left": F.col("kinds") - F.col("gone")})
        hit, miss = F.col("n").isNotNull(), F.col("n").isNull()
        both = F.col("left") + F.col("kinds_left")
        known.append(met.where(hit).select("run", (F.col("p") + F.log10(F.col("n") / both)).alias("p")))
        escape = F.when(F.col("kinds_left") > 0, F.log10(F.col("kinds_left") / both)).otherwise(0.0)
        # a context that never occurs says nothing and excludes nothing
        state = met.where(miss).select("run", (F.col("p") + escape).alias("p"), F.coalesce("masked", "taken").alias("taken"), F.coalesce("kinds", "gone").alias("gone"))
        if depth == order:  # most runs are known here; the others go on alone
            level = cut(met.select("run", hit.alias("hit"), F.when(hit, F.col("p") + F.log10(F.col("n") / both)).otherwise(F.col("p") + escape).alias("p"), F.coalesce("masked", "taken").alias("taken"), F.coalesce("kinds", "gone").alias("gone")), "longest")
            known = [level.where("hit").select("run", "p")]
            state = level.where("not hit").drop("hit")
    known.append(state.select("run", (F.col("p") - F.log10(F.lit(_BYTES) - F.col("gone"))).alias("p")))
    out = known[0]
    for k in known[1:]:
        out = out.union(k)
    return out


def fit(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """The trie of all texts of ``docs``."""
    blocks = survey(docs, F.lit(True), order)
    return trie(_counted(blocks), order)


def _counted(blocks: DataFrame) -> DataFrame:
    return cut(blocks.where("kind = 1").groupBy("run").agg(F.sum("n").alias("n")), "runs")


def held_out(doc_id: str = "doc_id", folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(True))


def score(docs: DataFrame, nodes: DataFrame | None = None, order: int = ORDER, learn: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    ``learn`` marks the training rows (else: those that ``held_out`` leaves); with ``nodes``, a trie
    from ``fit``, only the word model learns from them."""
    kind = docs.schema["doc_id"].dataType
    blocks = survey(docs, ~held_out() if learn is None else learn, order, block_bytes)
    counted = _counted(blocks)
    known = cut(probabilities(counted.select("run"), nodes if nodes is not None else trie(counted, order), order), "probabilities")
    asked = blocks.where("kind = 1").select("block", "run").join(known, "run")

    # a word's counts in all blocks meet once; the first block that has it counts it as a distinct one
    same = W.partitionBy("word")
    words = blocks.where("kind = 2").select("block", "word", "n")
    named = words.withColumns({"c": F.sum("n").over(same), "first": F.min("block").over(same)}).select("block", "word", "c", (F.col("first") == F.col("block")).alias("own"))

    def add(texts: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        is_run = model["word"].isna().to_numpy()
        keys, p = model["run"].to_numpy()[is_run], model["p"].to_numpy()[is_run]
        keys, first = np.unique(keys, return_index=True)
        p = p[first]
        word, c = model["word"][~is_run], model["c"].to_numpy()[~is_run]
        place = {w: i for i, w in enumerate(word)}
        logs = np.log10(c + 1)
        out = []
        raw = texts["text"].tolist()
        for a, b in _pieces([*map(len, raw)]):
            key, starts = runs(raw[a:b], order)
            sums = np.add.reduceat(p[np.searchsorted(keys, key)], starts)
            for t, s in zip(raw[a:b], sums.tolist()):
                own = t.lower().split()
                at = np.fromiter(map(place.__getitem__, (*own, END_TOKEN)), np.int64, len(own) + 1)
                out.append((len(at), int((c[at] > 0).sum()), math.fsum(logs[at].tolist()), s))
        made = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score"])
        made["distinct"] = 0
        made.loc[0, "distinct"] = int((model["own"].to_numpy()[~is_run] & (c > 0)).sum())
        return pd.concat([texts[["doc_id", "learn"]].reset_index(drop=True), made], axis=1)

    none, nothing, no = F.lit(-1).cast("long"), F.lit(None).cast("binary"), F.lit(False)
    fetched = asked.select("block", "run", nothing.alias("word"), "p", F.lit(0).cast("long").alias("c"), no.alias("own")).union(named.select("block", none, "word", F.lit(0.0), "c", "own"))
    texts = blocks.where("kind = 0").select(F.col("block").alias("at"), "doc_id", "learn", "text")
    scored = cut(texts.groupBy("at").cogroup(fetched.groupBy("block")).applyInPandas(add, "doc_id string, learn boolean, n_tokens long, n_known long, base_score double, score double, distinct long"), "scores")
    n = blocks.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    smoothed = math.log10(n + (scored.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]) + 1)
    return scored.select(
        F.col("doc_id").cast(kind).alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") - F.col("n_tokens") * smoothed).alias("base_score"), "score",
    )

"""Best-fit packing of token sequences by large-item matching.

Pieces longer than a third of the capacity fit at most twice into a sequence, so they are
paired greedily: each, from the longest down, takes the longest partner that still fits.
The smaller ones then go, from the longest down, into the tightest gap left.

Where a piece goes depends on its length only, and lengths are whole numbers up to the
capacity. So the plan is made from the counts per length (a table of at most ``capacity``
rows, whatever the corpus) and says: the i-th piece of length l goes to this sequence at this
offset. Pieces get their i by a window over salted groups of a length, so no length, however
common, meets in one task; the number of groups follows the number of pieces.

Edge cases: a null text is empty and becomes one piece (the end id); repeated rows are packed
as often as they occur; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

CAPACITY = 2048
END_ID = 0
#: Pieces of one length in one ranking group, about, and groups of all lengths, about, beyond which they grow.
RANKED, RANKINGS = 200, 1_000_000
CACHE_LIMIT = 150_000

_NOT_LATIN1 = re.compile("[^\x00-\xff]")
#: Byte that stands for the end of a word; UTF-8 has no such byte.
_WORD_END = b"\xff"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable Latin-1 characters
    stand for themselves, the other bytes for the characters from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Library(dict):
    """Space-free stretch of any text -> its ids; the tokenizer never looks across white space."""

    def __init__(self, path: str):
        self.path = path
        self[""] = b""

    @cached_property
    def tokenizer(self):
        """Read when it is first asked: most workers never see text that needs it."""
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(self.path)
        tokenizer.encode_special_tokens = True
        return tokenizer

    def ids(self, stretch: str) -> bytes:
        return np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, stretch: str) -> bytes:
        ids = self.ids(stretch)
        if len(self) < CACHE_LIMIT and len(stretch) < 64:
            self[stretch] = ids
        return ids


class _Latin1(_Library):
    """The same for lower-case Latin-1 stretches, which need no normalising: they are split by
    the file's own pattern and its merges run as byte ranks, with the word end as a byte."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()

        def raw(token: str) -> bytes:
            word = token.removesuffix("</w>")
            return bytes(letters[c] for c in word) + _WORD_END * (word != token)

        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.find = regex.compile(pattern).findall
        self.merge = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def ids(self, stretch: str) -> bytes:
        out: list[int] = []
        for piece in [stretch] if stretch.isalpha() else self.find(stretch):
            out += self.merge(piece.encode() + _WORD_END)
        return np.array(out, "<u4").tobytes()


@lru_cache(maxsize=2)
def _caches(path: str) -> tuple[_Latin1, _Library]:
    return _Latin1(path), _Library(path)


def token_ids(text: str, path: str) -> bytes:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    latin1, library = _caches(path)
    cache = library if _NOT_LATIN1.search(text) else latin1
    if cache is latin1:
        text = text.lower()  # one character to one, whatever its neighbours
    return b"".join(map(cache.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""
    end = np.array([end_id], "<u4").tobytes()

    def tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                ids = token_ids(text, tokenizer_path) + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    # ids travel as strings: a batch with nulls would make them floats
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = source.mapInPandas(tokenise, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number of pieces, first sequence, offset): the pieces of a
    length with ranks first, first + 1, ... go to consecutive sequences at one offset."""
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> [(first sequence, sequences)]
    sequences = 0

    def put(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, used[length], n, first, offset))
        used[length] += n
        left[length] -= n

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for a in large:
        while left[a]:
            b = next((x for x in large if x <= min(a, capacity - a) and left[x] and (x != a or left[a] > 1)), None)
            n = left[a] if b is None else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, sequences, 0)
            if b is not None:
                put(b, n, sequences, a)
            if gap := capacity - a - (b or 0):
                gaps[gap].append((sequences, n))
            sequences += n
    for s in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[s]:
            gap = min((g for g, bins in gaps.items() if bins and g >= s), default=None)
            if gap is None:
                n = max(1, left[s] // (capacity // s))
                gaps[capacity].append((sequences, n))
                sequences += n
                continue
            first, n = gaps[gap].pop()
            if n > left[s]:
                gaps[gap].append((first + left[s], n - left[s]))
                n = left[s]
            put(s, n, first, capacity - gap)
            if gap > s:
                gaps[gap - s].append((first, n))
    return runs


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length (1 to capacity)."""
    spark = parts.sparkSession
    # rows get a number of their own, so that those without an id, or of one id, spread as well
    parts = cut(parts.withColumn("row", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    # their number depends on the capacity: 32,213 for 10^5 pieces, 31,413 for 10^8
    runs = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 5)
    # a length has as many groups as its pieces ask for, so all together are few more than lengths and RANKINGS
    each = max(RANKED, sum(counts.values()) // RANKINGS)
    groups = spark.createDataFrame([(k, max(1, -(-n // each))) for k, n in counts.items()], "length long, salts long")
    parts = parts.join(F.broadcast(groups), "length").withColumn("salt", F.pmod(F.xxhash64("row"), F.col("salts"))).drop("salts")
    sizes = cut(parts.groupBy("length", "salt").agg(F.count("*").alias("n")), "piece-lengths")
    before = sizes.select("length", "salt", (F.sum("n").over(W.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    ranked = parts.withColumn("rank", F.row_number().over(W.partitionBy("length", "salt").orderBy("row")) - 1)
    ranked = ranked.join(before, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = lambda n, lo: (n << 44) | lo
        at = np.searchsorted(key(runs[:, 0], runs[:, 1]), key(length.to_numpy(np.int64), rank.to_numpy(np.int64)), "right") - 1
        return pd.DataFrame({"sequence_id": runs[at, 3] + rank.to_numpy() - runs[at, 1], "offset": runs[at, 4]})

    placed = ranked.withColumn("place", place(F.col("length").cast("long"), F.col("rank").cast("long")))
    return placed.withColumns({"sequence_id": F.col("place.sequence_id"), "offset": F.col("place.offset")}).drop("salt", "before", "rank", "place", "row")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    packed = pack(pieces(docs, tokenizer_path, capacity), capacity)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

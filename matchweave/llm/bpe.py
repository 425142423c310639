"""Byte-level BPE encoding and decoding.

A long text is cut into overlapping chunks. Each chunk is split into pre-tokens from wherever
it happens to start, so its first boundaries may be wrong; the pre-token pattern only looks
ahead, so from the first boundary that two neighbouring chunks share they agree for good.
That boundary is the seam: each chunk keeps the pre-tokens between its two seams. Only then are
those merged by rank, chunk by chunk, and the ids are joined in chunk order. Decoding
concatenates the bytes of the ids.

Every chunk window is stretched until its overlap holds a place that no pre-token crosses:
where a letter or a digit meets another kind of character, or a visible character meets a space.
So a shared boundary always exists, in scripts without spaces as well. (The pattern's pieces must
not mix letters and digits, nor go on after either with something else.)

Edge cases: null text is empty text and gives no ids; repeated rows and rows without an id each
give a row; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
#: Pre-tokens whose ids a worker remembers.
CACHE_LIMIT = 60_000
#: Texts encoded at a time.
ROWS = 500

#: Two characters between which no pre-token goes on, wherever reading starts.
_SURE_BOUNDARY = r"\p{L}[^\s\p{L}]|\p{N}[^\s\p{N}]|[^\s\p{L}\p{N}]\p{N}|\S[ \t\n]"


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Pieces(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        self.merge = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.merge(piece.encode()), "<u4").tobytes()
        if len(self) < CACHE_LIMIT and len(piece) < 64:
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def _pieces_of(path: str) -> list[bytes]:
    """The bytes of each id."""
    with open(path, "rb") as f:
        known = [(int(b), base64.b64decode(a)) for a, b in map(bytes.split, f)]
    out = [b""] * (max(known)[0] + 1)
    for rank, piece in known:
        out[rank] = piece
    return out


def decode_bytes(ids: bytes, path: str) -> bytes:
    """The bytes of little-endian unsigned 32-bit ids, concatenated."""
    return b"".join(map(_pieces_of(path).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _digests(ids: list[bytes], path: str) -> dict:
    """How many ids there are, and the digests of the ids and of what they decode to."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return {"n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [*map(sha, ids)], "decoded_sha256": [sha(decode_bytes(x, path)) for x in ids]}


@lru_cache(maxsize=1)
def _sure():
    import regex

    return regex.compile(_SURE_BOUNDARY)


@lru_cache(maxsize=2)
def _tools(path: str, pattern: str):
    import regex

    return regex.compile(pattern), _Pieces(path, pattern)


def windows(text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[tuple[int, int, int]]:
    """(start, end, end of the window before) of each overlapping chunk of ``text``."""
    out, start, before = [], 0, 0
    while True:
        cut = max(start + chunk, before)
        sure = _sure().search(text, cut) if cut < len(text) else None
        if sure is None:
            out.append((start, len(text), before))
            return out
        end = min(len(text), max(cut + overlap, sure.end() + 1))
        out.append((start, end, before))
        start, before = cut, end


def pretoken_bounds(window: str, last: bool, path: str, pattern: str) -> np.ndarray:
    """Where the pre-tokens of a window begin and end. The one that touches the window's end may be
    cut by it and is left out, unless the document ends there."""
    parts = _tools(path, pattern)[0].findall(window)
    if parts and not last:
        parts.pop()
    return np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]).astype("<i4")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS, digest: bool = False) -> DataFrame:
    """(id, ids): each document's ids as little-endian unsigned 32-bit integers in a binary; with
    ``digest``, what ``round_trip`` returns of them, decoded where they are made.

    Texts of one chunk are encoded where they are read. The chunks of longer texts are spread
    over the cluster, once to be split into pre-tokens and once to be merged; only the places of
    boundaries near seams, and in the end the ids, come together per document."""
    kind = docs.schema[id_col].dataType
    # ids travel as strings: a batch with nulls would make them floats
    docs = docs.select(F.col(id_col).cast("string").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids binary"
    of = (lambda ids: _digests(ids, ranks_path)) if digest else (lambda ids: {"ids": ids})

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find, pieces = _tools(ranks_path, pattern)
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                some = batch.iloc[at : at + ROWS]
                yield pd.DataFrame({"doc": some["doc"].to_numpy()} | of([b"".join(map(pieces.__getitem__, find.findall(t))) for t in some["text"]]))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uid, text in zip(batch["uid"], batch["text"]):
                spans = windows(text, chunk, overlap)
                yield pd.DataFrame([(uid, k, len(spans), s, p, text[s:e]) for k, (s, e, p) in enumerate(spans)], columns=["uid", "chunk", "chunks", "start", "before", "window"])

    def pretokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples():
                bounds = pretoken_bounds(r.window, r.chunk == r.chunks - 1, ranks_path, pattern)
                place = bounds.astype(np.int64) + r.start
                # only boundaries that a neighbour's window reaches can become seams
                rows.append((r.uid, r.chunk, r.chunks, r.start, r.window, bounds.tobytes(), place[place <= r.before], place[place >= r.start + chunk]))
            yield pd.DataFrame(rows, columns=["uid", "chunk", "chunks", "start", "window", "bounds", "head", "tail"])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = _tools(ranks_path, pattern)[1]
        for batch in batches:
            ids = []
            for r in batch.itertuples():
                if r.to < 0 and r.chunk < r.chunks - 1:
                    raise ValueError("two chunks share no boundary: the pattern's pieces mix kinds of characters")
                bounds = np.frombuffer(r.bounds, "<i4")
                mine = bounds[(bounds >= r.from_ - r.start) & (bounds <= (r.to - r.start if r.to >= 0 else bounds[-1]))].tolist()
                ids.append(b"".join([pieces[r.window[a:b]] for a, b in zip(mine, mine[1:])]))
            yield pd.DataFrame({"uid": batch["uid"], "chunk": batch["chunk"], "ids": ids})

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"uid": rows["uid"].iloc[:1].to_numpy()} | of([b"".join(rows.sort_values("chunk")["ids"])]))

    one = docs.where(F.length("text") <= chunk).mapInPandas(short, f"doc string, {made}")
    # rows get a number of their own; it is written, so that a lost executor can't change it
    long = cut(docs.where(F.length("text") > chunk).withColumn("uid", F.monotonically_increasing_id()), "long-texts")
    spread = long.select("uid", "text").mapInPandas(split, "uid long, chunk int, chunks int, start long, before long, window string").repartition(F.col("uid"), F.col("chunk"))
    read = cut(spread.mapInPandas(pretokenise, "uid long, chunk int, chunks int, start long, window string, bounds binary, head array<long>, tail array<long>"), "pre-tokens")
    order = W.partitionBy("uid").orderBy("chunk")
    seam = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    seams = read.select("uid", "chunk", seam.alias("to")).select("uid", "chunk", F.coalesce("to", F.lit(-1)).alias("to"), F.coalesce(F.lag("to").over(order), F.lit(0)).alias("from_"))
    coded = read.select("uid", "chunk", "chunks", "start", "window", "bounds").join(seams, ["uid", "chunk"]).mapInPandas(merge, "uid long, chunk int, ids binary")
    joined = coded.groupBy("uid").applyInPandas(join, f"uid long, {made}")
    return one.unionByName(long.select("uid", "doc").join(joined, "uid").drop("uid")).withColumn("doc", F.col("doc").cast(kind)).withColumnRenamed("doc", id_col)


def decode(ids: Column, ranks_path: str) -> Column:
    """The raw bytes of a binary of little-endian unsigned 32-bit ids, concatenated."""

    @F.pandas_udf("binary")
    def to_bytes(batch: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else decode_bytes(x, ranks_path) for x in batch], dtype=object)

    return to_bytes(ids)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the digests of its ids and of what they decode to."""
    return encode(docs, ranks_path, pattern, digest=True)

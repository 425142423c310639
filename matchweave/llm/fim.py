"""Fill-in-middle transformation of texts, cut at token boundaries.

A token is a word with the white space before it, or white space at the end of the text. Each
code point of a text has one of four character classes: inside a word, last of a word, white
space, white space that ends the text. The classes of a batch of texts form one wavelet matrix
(a bit vector per level, with counts per 64 bits). The number of tokens up to a place is the sum
of two of its ranks: of last letters, and of the white space at the end. So two rank queries per
text give its tokens, and a bisection on ranks finds each cut; nothing is split into tokens.

A text is cut into prefix, middle and suffix and written as it is (plain), as
``<P>prefix<S>suffix<M>middle`` (psm) or as ``<S>suffix<P>prefix<M>middle`` (spm). Cuts and form
come from a digest of the document's id, so that a run repeats.

Edge cases: a null or empty text, and one that holds a mark, is plain; a row without doc_id is cut
by the digest of an empty id; prefix, middle or suffix may be empty; repeated rows each give a
row; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Shares of texts that stay plain, and of the others that put the suffix first, in percent.
PLAIN, SUFFIX_FIRST = 50, 80
#: Code points of texts that share a wavelet matrix.
BATCH_CHARS = 1 << 21

INSIDE, LAST, SPACE, SPACE_AT_END = range(4)


class WaveletMatrix:
    """Rank queries over a sequence of small integers."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.size, self.bits = len(codes), bits
        self.words, self.before, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (codes >> level) & 1
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(self.size // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(self.size - int(self.before[-1][-1]))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << low) - np.uint64(1)))

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How often ``code`` occurs before each place."""
        low, high = np.zeros_like(at), at
        for level in range(self.bits):
            if code >> (self.bits - 1 - level) & 1:
                low, high = self.zeros[level] + self._ones(level, low), self.zeros[level] + self._ones(level, high)
            else:
                low, high = low - self._ones(level, low), high - self._ones(level, high)
        return high - low


def classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The character class of every code point of the texts, and where each text begins (and the last ends)."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([*map(len, texts)], dtype=np.int64)])
    space = (points == 0x20) | ((points >= 9) & (points <= 13))
    follows = np.append(space[1:], True)
    ends = np.zeros(len(points) + 1, bool)
    ends[starts[1:]] = True  # one past the last code point of a text
    final = ends[1:]
    code = np.where(space, np.where(final, SPACE_AT_END, SPACE), np.where(follows | final, LAST, INSIDE)).astype(np.uint8)
    return code, starts


class Boundaries:
    """Token boundaries of a batch of texts."""

    def __init__(self, texts: list[str]):
        code, self.starts = classes(texts)
        self.matrix = WaveletMatrix(code, 2)
        self.first = self.count(self.starts)
        self.tokens = np.diff(self.first)

    def count(self, at: np.ndarray) -> np.ndarray:
        """How many tokens end before each place of the batch."""
        return self.matrix.rank(LAST, at) + self.matrix.rank(SPACE_AT_END, at)

    def cut(self, tokens: np.ndarray) -> np.ndarray:
        """Of each text: how many code points its first so many tokens have."""
        low, high = self.starts[:-1].copy(), self.starts[1:].copy()
        wanted = self.first[:-1] + tokens
        while (open_ := low < high).any():  # the smallest place with so many ends before it
            middle = (low + high) // 2
            enough = self.count(middle) >= wanted
            high = np.where(open_ & enough, middle, high)
            low = np.where(open_ & ~enough, middle + 1, low)
        return low - self.starts[:-1]


def digests(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2^32 from the digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    first = total = 0
    for i, size in enumerate(sizes):
        total += size
        if total >= BATCH_CHARS:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(sizes):
        yield first, len(sizes)


def transform(docs: DataFrame, seed: int = SEED, plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """Per document: doc_id, n (tokens), form, prefix_chars, middle_chars (null if plain), output."""

    def cut(rows: pd.DataFrame) -> pd.DataFrame:
        texts = rows["text"].tolist()
        found = Boundaries(texts)
        a, b = (rows[h].to_numpy() % (found.tokens + 1) for h in ("h1", "h2"))
        one, two = found.cut(np.minimum(a, b)), found.cut(np.maximum(a, b))
        out = []
        for doc, t, n, i, j, stays, first in zip(rows["doc_id"], texts, found.tokens.tolist(), one.tolist(), two.tolist(), rows["h3"] % 100 >= plain, rows["h4"] % 100 < suffix_first):
            if stays or not t or PREFIX in t or SUFFIX in t or MIDDLE in t:
                out.append((doc, n, "plain", None, None, t))
            elif first:
                out.append((doc, n, "spm", i, j - i, f"{SUFFIX}{t[j:]}{PREFIX}{t[:i]}{MIDDLE}{t[i:j]}"))
            else:
                out.append((doc, n, "psm", i, j - i, f"{PREFIX}{t[:i]}{SUFFIX}{t[j:]}{MIDDLE}{t[i:j]}"))
        made = pd.DataFrame(out, columns=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])
        return made.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in _batches([*map(len, batch["text"])]):
                yield cut(batch.iloc[a:b])

    h1, h2, h3, h4 = digests(F.col("doc_id"), seed)
    # ids travel as strings: a batch with nulls would make them floats
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    made = source.mapInPandas(run, "doc_id string, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def restore(output: Column, form: Column) -> Column:
    """The text from what ``transform`` made of it: its marks tell the parts."""
    size = len(PREFIX)
    first, second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output)), F.locate(MIDDLE, output)
    one, two = F.substring(output, F.lit(size + 1), first - size - 1), F.substring(output, first + size, second - first - size)
    three = F.substring(output, second + size, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, three, two)).otherwise(F.concat(two, three, one))


def digest(docs: DataFrame) -> DataFrame:
    """``transform`` with digests of each output and of the text restored from it."""
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))

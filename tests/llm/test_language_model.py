"""Prediction by partial matching and the word model against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from matchweave.llm import language_model


class PlainTrie:
    """The model as it is told: counts per context, escapes with method C, exclusion symbol by symbol."""

    def __init__(self, texts, order):
        self.order, self.next = order, defaultdict(Counter)
        for t in texts:
            data = b"\xff" * order + t + b"\xfe"
            for i in range(order, len(data)):
                for k in range(order + 1):
                    self.next[data[i - k : i]][data[i]] += 1

    def log10(self, context, byte):
        excluded, out = set(), 0.0
        for k in range(self.order, -1, -1):
            seen = {b: n for b, n in self.next.get(context[self.order - k :], {}).items() if b not in excluded}
            if not self.next.get(context[self.order - k :]):
                continue
            both = sum(seen.values()) + len(seen)
            if byte in seen:
                return out + math.log10(seen[byte] / both)
            if seen:
                out += math.log10(len(seen) / both)
            excluded |= set(seen)
        return out - math.log10(256 - len(excluded))

    def score(self, t):
        data = b"\xff" * self.order + t + b"\xfe"
        return sum(self.log10(data[i - self.order : i], data[i]) for i in range(self.order, len(data)))


def is_held(doc):
    return doc is None or zlib.crc32(str(doc).encode()) % 7 == 2


def some_texts(n):
    r = random.Random(5)
    words = ["the", "cat", "Sat", "on", "mat", "über", "naïve", "日本", "a" * 40, "x1y2", "\x85", "tab\tin", "\x0b"]
    out = [(i, " ".join(r.choices(words, k=r.randint(1, 30)))) for i in range(n)]
    return [*out, (n, None), (n + 1, ""), (n + 2, "   \n"), (None, "the cat sat"), (-3, "the cat sat"), (2**60 + 1, "Wholly unlike, with bytes \u0001 and 🜁"), (3, "same id again"), (3, "same id again"), (n + 9, "word " * 5000)]


@pytest.mark.parametrize("order, block", [(4, 16 << 20), (2, 200)])
def test_scores_equal_the_plain_model(spark, order, block):
    rows = some_texts(60)
    docs = spark.createDataFrame([(a, b, "x", 1) for a, b in rows], "doc_id long, text string, run string, n int").repartition(3)
    got = language_model.score(docs, order=order, block_bytes=block).collect()
    taught = [(t or "").encode() for d, t in rows if not is_held(d)]
    model = PlainTrie(taught, order)
    c = Counter(w for t in taught for w in [*t.lower().split(), b""])
    n, v = sum(c.values()), len(c)

    def base(t):
        tokens = [*t.lower().split(), b""]
        return len(tokens), sum(c[w] > 0 for w in tokens), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)

    want = sorted((str(d), is_held(d), *base((t or "").encode()), n, model.score((t or "").encode())) for d, t in rows)
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score, r.train_tokens, r.score) for r in got)
    assert len(have) == len(want) == len(rows)
    for a, b in zip(have, want):
        assert a[:4] == b[:4] and a[5] == b[5]
        assert a[4] == pytest.approx(b[4], rel=1e-12) and a[6] == pytest.approx(b[6], rel=1e-9)


def test_probabilities_of_a_context_sum_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["abab", "abac", "bab", "ca"])], "doc_id long, text string")
    nodes = language_model.fit(docs, order=2)
    contexts = [b"ab", b"zz", b"za", b"\xff\xff", b"\xffa"]
    asked = spark.createDataFrame([(int.from_bytes(c + bytes([b]), "big"),) for c in contexts for b in range(256)], "run long")
    sums = defaultdict(float)
    for r in language_model.probabilities(asked, nodes, order=2).collect():
        sums[r.run >> 8] += 10**r.p
    assert len(sums) == 5 and all(s == pytest.approx(1) for s in sums.values())


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.score(empty).count() == 0
    held = next(i for i in range(100) if is_held(i))
    (row,) = language_model.score(spark.createDataFrame([(held, "abc")], "doc_id long, text string")).collect()
    assert row.held_out and row.train_tokens == 0 and row.base_score == 0 and row.n_known == 0
    assert row.score == pytest.approx(-4 * math.log10(256))


def test_a_trie_of_other_texts_scores(spark):
    trained = language_model.fit(spark.createDataFrame([(1, "abcabcabc")], "doc_id long, text string"))
    docs = spark.createDataFrame([(1, "abcabc"), (2, "zzzzzz")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in language_model.score(docs, trained).collect()}
    model = PlainTrie([b"abcabcabc"], 4)
    assert got[1] == pytest.approx(model.score(b"abcabc")) and got[2] == pytest.approx(model.score(b"zzzzzz")) and got[1] > got[2]


def test_held_out_texts_code_shorter_than_by_words(spark):
    """On held-out rows of the table: fewer bits than the word model, which leaves white space out."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [r for r in language_model.score(docs).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) < 0
    # a byte costs well under eight bits
    sizes = {r.doc_id: len(r.text or "") for r in docs.collect()}
    assert -sum(r.score for r in rows) / math.log10(2) < 4 * sum(sizes[r.doc_id] for r in rows)

"""Fill-in-middle against plain tokens, and the wavelet matrix against counting."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchweave.llm import fim

TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc, text):
    t = text or ""
    tokens = TOKENS.findall(t)
    h = hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(tokens), "plain", None, None, t
    if h4 % 100 < 80:
        return len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.integers(0, 7), max_size=300), st.data())
@settings(max_examples=60, deadline=None)
def test_ranks_count(codes, data):
    codes = np.array(codes, np.uint8)
    matrix = fim.WaveletMatrix(codes, 3)
    at = np.array(data.draw(st.lists(st.integers(0, len(codes)), min_size=1, max_size=20)))
    for code in range(8):
        assert matrix.rank(code, at).tolist() == [int((codes[:i] == code).sum()) for i in at]


@given(st.lists(st.text(alphabet="ab é日\t\n\x0b\x85 🜁 ", max_size=40), min_size=1, max_size=8))
@settings(max_examples=150, deadline=None)
def test_boundaries_are_those_of_tokens(texts):
    found = fim.Boundaries(texts)
    tokens = [TOKENS.findall(t) for t in texts]
    assert found.tokens.tolist() == [*map(len, tokens)]
    for share in (0, 1, 2, 3):
        k = np.array([len(t) * share // 3 for t in tokens])
        assert found.cut(k).tolist() == [len("".join(t[:i])) for t, i in zip(tokens, k)]


def test_whole_table_against_tokens(spark):
    r = random.Random(2)
    words = ["if", "<P>", "<", "S>", "é", "日本", "\t", "\n\n", " ", "x" * 70, "<M", ">"]
    rows = [(i, "".join(r.choices(words, k=r.randint(0, 60)))) for i in range(400)]
    rows += [(None, "no id at all"), (2**60 + 1, "large id"), (-5, "below zero"), (1007, None), (1007, None), (1008, " \n "), (1009, "w " * 200_000), (1010, "😀" * 10)]
    docs = spark.createDataFrame([(a, b, "n", 0) for a, b in rows], "doc_id long, text string, form string, n int").repartition(3)
    made = fim.transform(docs)
    back = made.withColumn("back", fim.restore(made["output"], made["form"])).collect()
    key = lambda x: tuple(map(str, x))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in back), key=key) == sorted(((d, *plain(d, t)) for d, t in rows), key=key)
    assert sorted(((r.doc_id, r.back) for r in back), key=key) == sorted(((d, t or "") for d, t in rows), key=key)
    digests = {r.doc_id: r for r in fim.digest(docs).collect()}
    for d, t in rows:
        assert digests[d].restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    assert fim.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("plain_share, first, form", [(0, 100, "plain"), (100, 100, "spm"), (100, 0, "psm")])
def test_shares(spark, plain_share, first, form):
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    assert {r.form for r in fim.transform(docs, plain=plain_share, suffix_first=first).collect()} == {form}

"""Substring removal on rows that are unusual: one id twice, no id, clashing columns, large groups."""

import hashlib
import random

from pyspark.sql import functions as F

from matchweave.llm import substring_dedup


def plainly(texts, n=20):
    """(n_words, n_removed, kept) of each of the texts, earlier ones first."""
    words = [(t or "").encode().split() for t in texts]
    first = {}
    for d, w in enumerate(words):
        for i in range(len(w) - n + 1):
            first.setdefault(tuple(w[i : i + n]), (d, i))
    out = []
    for d, w in enumerate(words):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] != (d, i):
                gone[i : i + n] = [True] * n
        out.append((len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def say(r, n, letters="abcdefghijkl"):
    return " ".join(r.choice(letters) + str(r.randrange(30)) for _ in range(n))


def test_two_texts_of_one_id_and_rows_without_id(spark):
    r = random.Random(1)
    passage = say(r, 60)
    rows = [(1, passage + " " + say(r, 300)), (1, say(r, 10) + " " + passage), (2, passage), (2, passage), (None, passage), (None, None), (2**60 + 1, "x " + passage), (5, None), (6, "")]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    removed = sorted((x["doc_id"] or 0, x["n_removed"]) for x in got)
    assert [n for d, n in removed if d == 1] == [0, 60] and [n for d, n in removed if d == 2] == [60, 60]
    assert [n for d, n in removed if d == 0] == [0, 0] and (2**60 + 1, 60) in removed


def test_large_groups_are_split_by_longer_prefixes(spark):
    """A passage that begins alike in all documents, and one that all share whole."""
    r = random.Random(2)
    common = say(r, 19)
    texts = [say(r, 5) + " " + common + " " + say(r, 30, "xyz") + " " + (common + " " + say(r, 1, "uv") + " ") * (i % 3) for i in range(60)]
    texts += ["q " * 200, "q " * 90, common + " " + common + " " + common]
    want = plainly(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for group, most in ((3, 10_000), (20, 10_000), (50_000, 10_000)):
        for x in substring_dedup.repeats(frame, digest=True, group=group, most=most).collect():
            n, gone, kept = want[x["doc_id"]]
            assert (x["n_words"], x["n_removed"], x["kept"]) == (n, gone, hashlib.sha256(kept).hexdigest())


def test_groups_larger_than_what_a_task_holds(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "LEAVES", 16)
    r = random.Random(4)
    passage = say(r, 45)
    texts = [say(r, r.randrange(4)) + " " + passage + " " + say(r, 25) for _ in range(40)]
    want = plainly(texts)
    run = substring_dedup._late_leaves(20)
    rows = []
    for d, t in enumerate(texts):
        w = t.encode().split()
        rows += [(7 if w[i : i + 20] == passage.encode().split()[:20] else 8, d, 0, i, b" ".join(w[i : i + 20])) for i in range(len(w) - 19)]
    import pandas as pd

    r.shuffle(rows)
    frame = pd.DataFrame(sorted(rows, key=lambda x: x[0]), columns=["group", "doc_id", "mark", "start", "words"])
    late = pd.concat(run(frame.iloc[i : i + 11] for i in range(0, len(frame), 11)))
    assert not late.duplicated().any()
    for d, t in enumerate(texts):
        kept, gone = substring_dedup._kept(t.encode().split(), late["start"][late["doc_id"] == d].to_numpy(), 20)
        assert (gone, kept) == want[d][1:]


def test_equal_hashes_of_different_words_are_not_removed(monkeypatch, spark):
    """With hashes that all collide the words still decide."""
    import numpy as np

    flat = lambda h, width, m: np.zeros(max(0, len(h) - width + 1), np.uint64)
    monkeypatch.setattr(substring_dedup, "rolling", flat)
    r = random.Random(5)
    passage = say(r, 30)
    texts = [substring_dedup._Text((say(r, 12) + " " + passage).encode()) for _ in range(4)]
    start = np.tile(np.arange(23), 4)
    owner = np.repeat(np.arange(4), 23)
    late = substring_dedup._own_leaves(texts, np.zeros(92, np.uint64), owner, start, np.arange(4), 20)
    for k, s, gone in zip(owner, start, late):
        if gone:
            assert any(texts[k].part(s, s + 20) == texts[o].part(p, p + 20) for o in range(k + 1) for p in range(23) if (o, p) < (k, s))


def test_clashing_columns_and_empty_table(spark):
    r = random.Random(6)
    passage = say(r, 50)
    rows = [(1, passage, 9, "k", "i", "w", "row", 4), (2, "a " + passage, 9, "k", "i", "w", "row", 4), (None, passage, None, None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, kept string, _id string, who string, row string, mark int")
    got = {x["doc_id"]: x for x in substring_dedup.drop_repeats(frame).collect()}
    assert substring_dedup.drop_repeats(frame).columns == frame.columns
    assert (got[1]["text"], got[2]["text"], got[None]["text"]) == (passage, "a", passage)
    assert (got[2]["n_chars"], got[1]["n_chars"], got[2]["kept"], got[2]["_id"], got[2]["mark"]) == (1, 9, "k", "i", 4)
    assert substring_dedup.drop_repeats(frame.where(F.lit(False))).count() == 0

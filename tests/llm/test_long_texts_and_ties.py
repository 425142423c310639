"""Chunked encoding without spaces, ranks of frequent lengths, bounds of large components."""

import random
from collections import defaultdict

import public_tokenizers

from matchweave.llm import bpe, packing, topk

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_texts_without_spaces_are_cut(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("日本語中文，。12ab") for _ in range(3000)), "".join(r.choice("ABab01+/") for _ in range(3000)), "it's" * 500, "9" * 2000, "don't 1st x" * 300, "　".join("漢字" * 9 for _ in range(90))]
    for t in texts[:2]:
        spans = bpe.windows(t, 100, 20)
        assert len(spans) > 20 and max(e - s for s, e, _ in spans) < 400
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0]), (0, texts[0]), (7, None)], "doc_id long, text string")
    whole = sorted((str(x["doc_id"]), bytes(x["ids"])) for x in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect())
    parts = sorted((str(x["doc_id"]), bytes(x["ids"])) for x in bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk=100, overlap=20).collect())
    assert whole == parts and len(whole) == 9
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN, chunk=100).count() == 0


def test_frequent_lengths_are_ranked_in_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 7)
    r = random.Random(3)
    rows = [(i, 0, r.choice([5, 5, 5, 5, 60, 700, 1500, 2048]), "x", 1) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, piece int, length long, salt string, rank int").drop("salt", "rank")).collect()
    assert len(got) == 400
    bins = defaultdict(list)
    for x in got:
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_large_components_keep_exact_answers(spark):
    """Scores whose difference is under what a double can tell from their size."""
    r = random.Random(4)
    rows = [(i, [float(r.randrange(2**18)) + r.randrange(2) / 1024 for _ in range(8)]) for i in range(600)]
    rows += [(1000 + i, [float(2**18)] * 8) for i in range(30)] + [(2000, [2.0**18 + 1 / 1024] * 8)]
    got = defaultdict(list)
    for x in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    for q, v in rows:
        if q % 100 == 0:
            mine = [int(c * 1024 // 1) for c in v]
            want = sorted(((-sum(a * int(c * 1024 // 1) for a, c in zip(mine, w)), i) for i, w in rows if i != q))[:10]
            assert [(s, i) for _, i, s in sorted(got[q])] == [(-s, i) for s, i in want]


def test_decoding_gives_the_bytes_back(spark):
    texts = ["plain text, it's 12", "日本語 ü\n\n x", "", "word " * 40]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk=60, overlap=20)
    back = {x["doc_id"]: bytes(x["back"]).decode() for x in coded.select("doc_id", bpe.decode(coded["ids"], RANKS).alias("back")).collect()}
    assert back == dict(enumerate(texts))

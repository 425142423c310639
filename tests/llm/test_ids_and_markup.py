"""Ids beside nulls stay exact, and broken markup keeps its text."""

import time

import numpy as np
import pytest
import public_tokenizers

from matchweave.llm import bpe, html_extract, ngram_join, packing, secrets, toxicity, warc

IDS = [2**60 + 1, None, -7, 5, 2**53 + 1]
TEXT = "one two three four five six seven"


def docs_of(spark, ids=IDS, text=TEXT):
    return spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string").coalesce(1)


def ids_of(df, name="doc_id"):
    return sorted(map(str, (r[name] for r in df.collect())))


def test_ids_of_every_operator(spark):
    docs, want = docs_of(spark), sorted(map(str, IDS))
    assert ids_of(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)) == want
    long = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk=16, overlap=8)
    assert ids_of(long) == want
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert ids_of(toxicity.score(docs, labels)) == want
    assert ids_of(packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))) == want
    assert ids_of(secrets.scan(docs)) == want
    pages = docs.selectExpr("doc_id AS page_id", "'http://x/' AS url", "'<p>Hello there.</p>' AS html")
    model = html_extract.Model(np.zeros(html_extract._features([html_extract.parse("<p>x</p>")])[0].shape[1]), np.zeros((3, 2, 2)))
    assert ids_of(html_extract.extract(pages, model), "page_id") == want


def test_rows_without_an_id_spread_over_ranking_groups(spark):
    rows = spark.range(1000).selectExpr("CAST(NULL AS long) AS doc_id", "0 AS piece", "CAST(700 AS long) AS length")
    placed = packing.pack(rows, 2048).groupBy("sequence_id").agg({"length": "sum", "offset": "count"}).collect()
    assert sum(r["count(offset)"] for r in placed) == 1000 and max(r["sum(length)"] for r in placed) <= 2048 and len(placed) == 500


def test_a_row_without_an_id_hides_no_link(spark):
    got = ngram_join.join(docs_of(spark, [None, 5, 7])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (5, 5), (7, 5)} and {r.n_shingles for r in got} == {3}
    got = ngram_join.join(docs_of(spark)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(i, None if i is None else -7) for i in IDS}


def test_different_texts_under_one_id_are_repeatable(spark):
    rows = [(1, TEXT), (1, "another text of five words"), (2, TEXT), (3, "another text of five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [sorted(map(tuple, ngram_join.join(docs.repartition(n)).collect())) for n in (1, 3)]
    assert found[0] == found[1]


def test_archives_of_any_id(spark, tmp_path):
    ids = [10**13, 2**60 + 1, 2**60 + 3, None, -7]
    pages = spark.createDataFrame([(i, "http://x/", "<p>same</p>") for i in ids], "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(pages, str(tmp_path / "w")).collect()}
    assert got == {-7: ("response", None), None: ("response", None), 10**13: ("revisit", -7), 2**60 + 1: ("revisit", -7), 2**60 + 3: ("revisit", -7)}
    pages = pages.where("page_id > 10000000000000")
    got = {r.page_id: r.refers_to for r in warc.archive(pages, str(tmp_path / "v")).collect()}
    assert got == {2**60 + 1: None, 2**60 + 3: 2**60 + 1}


@pytest.mark.parametrize(
    "source, blocks",
    [
        ("<p title=it's>Hello world.</p><p>I don't know</p><p>end</p>", ["Hello world.", "I don't know", "end"]),
        ("<p title=it's>Hello world</p>", ["Hello world"]),
        ('<p a"b>one</p><p "x">two</p>', ["one", "two"]),
        ("<p title='a > b'>three</p><p data-x=\"'>\">four</p>", ["three", "four"]),
        ("<p title=a'b\"c>five</p>", ["five"]),
        ("<p title = 'x'>six</p><p =>seven</p><p title=>eight</p>", ["six", "seven", "eight"]),
        ('<p title="never closed>nine</p><p>ten</p>', ["nine", "ten"]),
        ("<script src=/a/>var x = '<p>no</p>'</script><p>eleven</p>", ["eleven"]),
        ("<p>1 < 2 and 3 <4</p><p>twelve", ["1 < 2 and 3 <4", "twelve"]),
        ("<p>thirteen</p><!-- <p>no</p>", ["thirteen"]),
        ("<p>fourteen</p><a href='x", ["fourteen"]),
        ("<!doctype html><?php x ?><p>fifteen</p>", ["fifteen"]),
    ],
)
def test_stray_quotes(source, blocks):
    assert [t for _, t in html_extract.parse(source).blocks] == blocks


@pytest.mark.parametrize("part", ['<a "', "<a '", '<a b="', "<a b=\"'", "<a = ", "<", "</", "<a b='\" ", "<!", "<p/", "<p a=b ", "&#", "<!--", "<script>"])
def test_any_markup_is_read_once(part):
    begun = time.time()
    html_extract.parse(part * 200_000)
    assert time.time() - begun < 4

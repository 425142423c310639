"""Secret candidates of any alphabet, and tables that are unusual."""

import random
import string

import pytest

from matchweave.llm import secrets

WORDS = ["international", "configuration", "understanding", "word", "another", "Verantwortung", "sentence", "here", "responsibility", "the", "of"]


@pytest.fixture(scope="module")
def model():
    r = random.Random(3)
    x, y = secrets.labelled_findings([" ".join(r.choices(WORDS, k=200)) for _ in range(20)], 10_000)
    network = secrets.Network()
    network.fit(x[:7500], y[:7500])
    return network, network.calibrate(x[7500:], y[7500:], secrets.RECALL)


def test_candidates_of_any_alphabet():
    text = "short abcdefghijkl 123456789012 ABCDEFGHIJKLM a.b-c_d/e+f=g, (QwErTyUiOpAs)"
    assert [text[s:e] for s, e in secrets.candidates(text)] == ["abcdefghijkl", "123456789012", "ABCDEFGHIJKLM", "a.b-c_d/e+f=g", "QwErTyUiOpAs"]


def test_secrets_without_digits_are_found_and_long_words_left(model):
    r = random.Random(9)
    found = 0
    for _ in range(200):
        body = "".join(r.choices(string.ascii_letters, k=r.randint(20, 40)))
        text = f"the word here auth: {body} of another sentence"
        found += any(k == 3 and text[s:e] == body for s, k, e in secrets.find([text], *model)[0])
    assert found >= 180
    plain = [" ".join(f(w) for w in r.choices(WORDS, k=40)) + "." for f in (str, str.upper, str.capitalize) for _ in range(30)]
    assert sum(map(len, secrets.find(plain, *model))) <= 5


def test_tables_with_nulls_and_clashing_names(spark, model):
    rows = [(1, None, "a", 3), (None, "AKIA" + "B" * 20, "b", None), (2, "", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_chars long")
    got = {x["doc_id"]: x for x in secrets.scan(docs, model).collect()}
    assert got[None]["n_access"] == 1 and got[1]["spans"] == "" and got[2]["n_hex"] == 0
    kept = {x["doc_id"]: x for x in secrets.redact(docs, model).collect()}
    assert kept[None]["text"] == secrets.MASK and kept[None]["spans"] == "b" and kept[1]["text"] is None
    assert secrets.redact(docs.limit(0), model).count() == 0 and secrets.scan(docs.limit(0), model).count() == 0

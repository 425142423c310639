"""The whole corpus pipeline on a small corpus, against its stages done plainly one after another."""

import random
from collections import defaultdict

import public_tokenizers
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from matchweave.llm import ngram_join, packing, secrets, toxicity  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list[tuple], list[tuple]]:
    r = random.Random(12)
    words = [f"{a}{b}{c}" for a in ("ta", "ro", "mi", "ke", "lu") for b in ("lo", "sa", "ne", "pu") for c in ("n", "r", "st", "")]
    say = lambda n: " ".join(r.choices(words, k=n))
    passage, base = say(45), say(150)
    near = base.split()
    near[70] = "other"
    texts = [say(r.randint(20, 160)) for _ in range(240)]
    for i in range(0, 240, 3):
        w = texts[i].split()
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["nasty", "rotten", "vilething", "vileword"]))
        texts[i] = " ".join(w)
    labels = [(i, 1, int(i % 3 == 0)) for i in range(240)]
    texts += [base, base, " ".join(near), say(30) + " " + passage, passage + " " + say(30), say(40) + "\n" + passage + "\n" + say(20)]
    texts += ['say token = "abcdef123456XYZ" ' + say(30), "key AKIA" + "ABCD1234EFGH5678 " + say(25), None, "", "  ", say(5000), say(3)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], labels


def similar(a: str | None, b: str | None) -> bool:
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    both = len(sets[0] & sets[1])
    return bool(sets[0] and sets[1]) and 100 * both >= 75 * len(sets[0] | sets[1])


def without_repeats(texts: dict[int, str | None]) -> dict[int, str | None]:
    first: dict = {}
    words = {d: (t or "").split() for d, t in texts.items()}
    for d in sorted(words):
        for i in range(len(words[d]) - 19):
            first.setdefault(tuple(words[d][i : i + 20]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (d, i):
                gone[i : i + 20] = [True] * 20
        out[d] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else texts[d]
    return out


def test_run_equals_its_stages_done_plainly(spark, tmp_path):
    rows, marks = corpus()
    docs, labels = spark.createDataFrame(rows, SCHEMA).repartition(4), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    texts = {d: t for d, t, *_ in rows}
    network = toxicity.train(docs, labels)
    scores = dict(zip(texts, toxicity.scores_of(list(texts.values()), network, toxicity.Lookup(network))))
    texts = {d: t for d, t in texts.items() if scores[d] < 0.5}
    assert sum(d % 3 == 0 for d in texts if d < 240) < 20 and sum(d % 3 != 0 for d in texts if d < 240) > 140

    component = {d: d for d in texts}
    for a in texts:
        for b in texts:
            if a < b and similar(texts[a], texts[b]):
                old, new = component[b], component[a]
                component = {d: min(old, new) if c in (old, new) else c for d, c in component.items()}
    texts = {d: t for d, t in texts.items() if component[d] == d}
    assert 240 in texts and 241 not in texts and 242 not in texts

    texts = without_repeats(texts)
    clean = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in texts.items()], SCHEMA)
    model = secrets.train(clean)
    spans = dict(zip(texts, secrets.find([t or "" for t in texts.values()], *model)))
    rules = {d: any(k < 3 for _, k, _ in s) for d, s in spans.items()}
    texts = {d: None if t is None else secrets.redact_text(t, spans[d]) for d, t in texts.items()}
    assert rules[246] and rules[247] and secrets.MASK in texts[246]

    ids = {d: len(packing.token_ids(t or "", public_tokenizers.path("word_bpe_49k.json"))) // 4 + 1 for d, t in texts.items()}
    pieces, bins = defaultdict(int), defaultdict(list)
    for x in got:
        pieces[x["doc_id"]] += x["length"]
        bins[x["sequence_id"]].append((x["offset"], x["length"]))
    assert pieces == ids
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_of_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns


def test_clashing_columns_pass_through(spark):
    names = ("rep", "n", "key", "group", "kept", "component_id", "score")
    rows = [(1, "one two three four five six", *names), (2, "one two three four five six", *names), (3, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = ngram_join.keep_first(docs)
    assert got.columns == docs.columns and sorted(x["doc_id"] for x in got.collect()) == [1, 3]
    assert all(x[n] == n for x in got.collect() for n in names)

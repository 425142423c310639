"""Small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns,
held against plain brute force."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from matchweave.llm import ann, bpe, html_extract, ngram_join, packing, secrets, substring_dedup, topk, toxicity, warc

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, path string, rank int"


def make_texts() -> list[str | None]:
    r = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "it's", "Éa", "ñu", "x1", "日本", "don't", "A", "Σ"] + [f"w{i}" for i in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = say(40)
    base = say(120)
    near = base.split()
    near[7] = "changed"
    texts = [None, "", "   \n\t ", "one", "a b c", "a b c", base, base, " ".join(near), say(30) + " " + passage + " " + say(10), passage, say(5) + "\n" + passage, passage + " " + passage]
    texts += [say(r.randint(1, 60)) for _ in range(20)]
    texts.append("z" * 70_000 + " end")
    texts.append(say(9000))
    return texts


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, None, "s", None, "k", "p", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA).repartition(3)  # one row twice


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def test_bpe_round_trip(docs, texts):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe._ranks(RANKS), special_tokens={})
    rows = bpe.round_trip(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        ids = np.array(enc.encode_ordinary(texts[r["doc_id"]] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_bpe_small_chunks_resynchronise(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(6, texts[6])], "doc_id long, text string")
    whole = {r["doc_id"]: r["ids"] for r in bpe.encode(df, RANKS, public_tokenizers.PATTERN).collect()}
    parts = bpe.encode(df, RANKS, public_tokenizers.PATTERN, chunk=50, overlap=10).collect()
    assert len(parts) == len(texts) + 1
    assert all(r["ids"] == whole[r["doc_id"]] for r in parts)


# 2


def test_toxicity_learns_and_ignores_other_columns(spark):
    r = random.Random(1)
    plain = [f"{a}{b}{c}" for a in ("ta", "ro", "mi", "ke") for b in ("lo", "sa", "ne", "pu") for c in ("n", "r", "st", "")]
    rows, labels = [], []
    for i in range(400):
        w = r.choices(plain, k=r.randint(5, 120))
        if i % 3 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["nasty", "rotten", "vilething", "vileword"]))
        rows.append((i, " ".join(w), None if i % 5 else "en", "s", 0, "k", "p", 1))
        labels.append((i, 1, int(i % 3 == 0)))
    rows += [(1000, None, "en", "s", 0, "k", "p", 1), (1001, "", None, None, None, None, None, None), (1002, "talon " * 8000 + "nasty rotten", "en", "s", 0, "k", "p", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in toxicity.score(docs, marks).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(400))
    right = [got[i]["predicted"] == int(i % 3 == 0) for i in held]
    assert sum(right) >= 0.9 * len(right)
    assert got[1000]["predicted"] == got[1001]["predicted"] == 0 and got[1000]["score"] == got[1001]["score"]
    assert got[1002]["predicted"] == 1  # the last window of a long text counts
    assert all(0 <= x["score"] <= 1 for x in got.values())
    kept = {x["doc_id"] for x in toxicity.keep_clean(docs, marks).collect()}
    assert kept == {i for i, x in got.items() if x["predicted"] == 0}


def test_toxicity_gradients():
    net = toxicity.Network({"a": 1.0, "b": -1.0}, {int(g): 0.5 for g in toxicity.grams(["abc", "bcd"]).ravel() if g})
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(0)
    px, mask, y = r.normal(0, 1, (3, 5, 6 * toxicity.HIDDEN)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [0, 1, 0, 0, 0]], float), np.array([1.0, 0, 1])
    pool = np.array([[0, 1, 1, 1, 0], [0, 1, 1, 0, 0], [0, 1, 0, 0, 0]], float)

    def loss() -> float:
        z = net.forward(px, mask, pool).astype(float)
        return float(np.mean(np.log1p(np.exp(-z)) * y + np.log1p(np.exp(z)) * (1 - y)))

    g, _, _ = net.gradients(px, mask, pool, y)
    for name in ("u0", "u1", "a", "v", "o"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        keep = net.p[name][at]
        net.p[name][at] = keep + 1e-3
        up = loss()
        net.p[name][at] = keep - 1e-3
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / 2e-3 - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-4, name


def test_toxicity_reads_long_runs_whole():
    for run in ("abcdefghij" * 9, "日本語" * 40, "well" + "-some_word/and,more" * 5 + "\u200bend"):
        words = toxicity.words_of(f"x {run} y")
        assert max(map(len, words)) <= toxicity.WORD_CHARS - 2 and words[0] == "x" and words[-1] == "y"
        kept = {int(g) for g in toxicity.grams(words).ravel()}
        for piece in re.split("[-_/,\u200b]", run):
            for i in range(0, len(piece) - toxicity.GRAM + 1):
                assert int(toxicity.grams([piece[i : i + toxicity.GRAM]])[0][1]) in kept  # after ^
    assert toxicity.words_of("a well-known it's http://x.org") == ["a", "well-known", "it's", "http://x.org"]
    r = random.Random(1)
    plain = [f"{a}{b}{c}" for a in ("ta", "ro", "mi", "ke") for b in ("lo", "sa", "ne", "pu") for c in ("n", "r", "st", "")]
    texts = [r.choices(plain, k=60) for _ in range(300)]
    for w in texts[::3]:
        for _ in range(3):
            w.insert(r.randrange(len(w)), r.choice(["nasty", "rotten", "vilething"]))
    net = toxicity.fit_network([" ".join(w) for w in texts], [int(i % 3 == 0) for i in range(300)])
    clean = "-".join(plain)
    late = [clean, *(j.join(plain[:20]) + j + j.join(["nasty", "rotten", "vilething"] * 2) for j in "-_/,\u200b")]
    assert (toxicity.scores_of(late, net, toxicity.Lookup(net)) >= 0.5).tolist() == [False, *[True] * 5]


def test_toxicity_scores_every_window(monkeypatch):
    """Against a plain loop over windows: each word's states run over its own stretch and what is around it."""
    monkeypatch.setattr(toxicity, "BLOCK", 7)
    monkeypatch.setattr(toxicity, "STRETCH", 64)
    r = random.Random(4)
    words = [f"w{i}" for i in range(50)]
    net = toxicity.Network({w: r.uniform(-3, 3) for w in words}, {int(g): r.uniform(-2, 2) for g in toxicity.grams(words).ravel() if g})
    texts = [[r.choice(words) for _ in range(n)] for n in (1, 39, 40, 41, 63, 64, 65, 75, 300, 339, 340, 700, 5)]
    lookup = toxicity.Lookup(net)
    best, begin = net.highest(texts, lookup)
    h, near = toxicity.HIDDEN, toxicity.CONTEXT
    for k, t in enumerate(texts):
        px, n, states = lookup(t)(np.arange(len(t))), len(t), []
        for first in range(0, n, 64):
            last = min(first + 64, n)
            low, high = max(0, first - near), min(n, last + near)
            part, one = px[None, low:high], np.ones((1, high - low), np.float32)
            fore = net._layer(part[:, :, : 3 * h], one, net.p["u0"], None)[:, 0]
            back = net._layer(part[:, ::-1, 3 * h :], one, net.p["u1"], None)[::-1, 0]
            states += [np.concatenate([fore[i - low], back[i - low]]) for i in range(first, last)]
        scores = []
        for s in range(max(1, n - toxicity.WINDOW + 1)):
            some = np.array(states[s : s + toxicity.WINDOW])
            weight = np.exp(toxicity._squash(some @ net.p["a"]) @ net.p["v"])
            scores.append(float((weight[:, None] * some).sum(0) @ net.p["o"] / weight.sum() + net.p["c"][0]))
        assert abs(best[k] - max(scores)) < 1e-4 and abs(scores[begin[k]] - max(scores)) < 1e-4
        if n <= 64:  # training sees the same window in the same surroundings
            pool = np.zeros((1, n), np.float32)
            pool[0, begin[k] : begin[k] + toxicity.WINDOW] = 1
            assert abs(net.forward(px[None], np.ones((1, n), np.float32), pool)[0] - best[k]) < 1e-4


def test_toxicity_without_labels(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


# 3

PAGES = "page_id long, url string, html string, text string, key string"
HTML = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='ad'>Buy now cheap things.</div><article><h1>A  title</h1><p>First &amp; best\n paragraph, with words.<p>Second one here.</article><footer>&copy; me</footer></body></html>", "A title\nFirst & best paragraph, with words.\nSecond one here."),
    ("<body><header><p>Site name</p></header><main><h1>Head</h1><p>Long enough text of the page, with a stop.</p><section class='comments'><p>Reader says hello there, nice.</p></section></main><aside><p>Related things to read.</p></aside></body>", "Head\nLong enough text of the page, with a stop."),
    ("<article><p>Cut off <script>var t='</p>'; if(a<b){}</script>script stays out.</p><form><p>Sign up for our letter</p></form><p>End.", "Cut off script stays out.\nEnd."),
]


def test_html_pages_may_use_data_label(spark):
    cell = "<table><tr><td data-label=\"Price\">Ten coins, or more.<td data-label>Second cell, longer.<td data-label='7'>Third cell.</table>"
    page = f"<html><body><article><h1>Head</h1><p>Long enough text of the page, with a stop.</p>{cell}</article></body></html>"
    bare = re.sub(" data-label(=[^>]*)?", "", page)
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame([(1, "u", page, "x", "k"), (2, "u", bare, "x", "k")], PAGES)).collect()}
    assert got[1].asDict() | {"page_id": 2} == got[2].asDict()
    assert html_extract.parse(page).label == html_extract.parse(bare).label
    marked = [(1, "u", page.replace("data-label", html_extract.LABEL), "x", "k")]
    assert html_extract.extract(spark.createDataFrame(marked, PAGES)).count() == 1


def test_html_extracts_main_text(spark):
    rows = [(i, f"u{i}", h, "x", "y") for i, (h, _) in enumerate(HTML)]
    rows += [(10, None, None, None, None), (11, "u", "", "", ""), (12, "u", "plain < text", "", ""), (None, "u", "<!-- open", "", ""), (13, "u", "<div>" * 3000 + "deep" + "</div>" * 10, "", ""), (14, "u", "<article><p>" + "word " * 50_000 + "</article>", "", "")]
    got = {r["page_id"]: r for r in html_extract.extract(spark.createDataFrame([*rows, rows[0]], PAGES)).collect()}
    for i, (_, want) in enumerate(HTML):
        assert got[i]["text"] == want
    assert got[10]["text"] == "" and got[11]["text"] == "" and got[10]["n_chars"] == 0
    assert got[14]["n_chars"] == 50_000 * 5 - 1


def test_html_model_on_unseen_pages():
    r = random.Random(99)
    words = [f"word{i}" for i in range(200)]
    model = html_extract.Model(np.zeros(html_extract._features([html_extract.parse("<p>x")])[0].shape[1]), np.zeros((3, 2, 2)))
    model.fit([html_extract.parse(html_extract.generate(words, r)) for _ in range(200)], rounds=100)
    unseen = [html_extract.parse(html_extract.generate(words, r)) for _ in range(50)]
    p = model.marginals(*html_extract._features(unseen))[0][:, 1] >= 0.5
    y = np.array([k for page in unseen for k in page.label])
    assert (p == (y == 1)).mean() > 0.97


def test_html_messages_equal_enumeration():
    """Sum-product marginals of a small tree against all assignments."""
    page = html_extract.parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div>")
    x, parent, depth, edge = html_extract._features([page])
    r = np.random.default_rng(1)
    model = html_extract.Model(r.normal(0, 0.3, x.shape[1]), r.normal(0, 1, (3, 2, 2)))
    n, total = len(x), np.zeros((len(x), 2))
    for bits in range(2**n):
        s = [(bits >> i) & 1 for i in range(n)]
        w = np.exp(sum(x[i] @ model.own * s[i] for i in range(n)) + sum(model.pair[edge[i], s[parent[i]], s[i]] for i in range(n) if parent[i] >= 0))
        for i in range(n):
            total[i, s[i]] += w
    assert np.allclose(model.marginals(x, parent, depth, edge)[0], total / total.sum(1, keepdims=True))


# 4


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(docs, WORDS).collect()
    want = defaultdict(int)
    for i in [*range(len(texts)), 6]:
        ids = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(ids), 2048):
            part = ids[p : p + 2048]
            want[i, p // 2048, p, len(part), zlib.crc32(part.tobytes())] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_packing_plan_pairs_large_pieces():
    r = random.Random(5)
    counts = defaultdict(int)
    for _ in range(5000):
        counts[r.choice([r.randint(1, 60), r.randint(60, 900), r.randint(600, 2048)])] += 1
    bins = defaultdict(list)
    seen = defaultdict(set)
    for length, lo, n, first, at in packing.plan(counts):
        for i in range(n):
            bins[first + i].append((at, length))
            assert lo + i not in seen[length]
            seen[length].add(lo + i)
    assert {k: len(v) for k, v in seen.items()} == counts
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and sum(3 * n > 2048 for _, n in parts) <= 2
    assert len(bins) <= 1.02 * max(sum(k * v for k, v in counts.items()) / 2048, sum(v for k, v in counts.items() if k > 1024))


# 5


def drop_repeats_plainly(texts: dict[int, str | None], n: int = 20) -> dict[int, tuple[int, int, bytes]]:
    words = {d: (t or "").encode().split() for d, t in texts.items()}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - n + 1):
            first.setdefault(tuple(words[d][i : i + n]), (d, i))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] != (d, i):
                gone[i : i + n] = [True] * n
        out[d] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g))
    return out


def test_substring_dedup(docs, texts):
    want = drop_repeats_plainly(dict(enumerate(texts)))
    rows = substring_dedup.repeats(docs, digest=True).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (n, gone, hashlib.sha256(kept).hexdigest())


def test_substring_dedup_short_alphabet(spark):
    r = random.Random(8)
    texts = {i: " ".join(r.choice("ab" if i % 2 else "abcdefgh") for _ in range(r.randint(0, 400))) for i in range(40)}
    want = drop_repeats_plainly(texts)
    got = substring_dedup.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)).collect()
    for x in got:
        n, gone, kept = want[x["doc_id"]]
        assert (x["n_words"], x["n_removed"]) == (n, gone) and (x["kept"] == kept.decode() if gone else x["kept"] is None)


def test_drop_repeats_keeps_all_documents(docs, texts, spark):
    one = docs.dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in substring_dedup.drop_repeats(one).collect()}
    want = drop_repeats_plainly(dict(enumerate(texts)))
    assert set(got) == set(range(len(texts)))
    for i, t in enumerate(texts):
        assert got[i]["text"] == (want[i][2].decode() if want[i][1] else t)


# 6


def test_secret_rules(docs, spark):
    texts = ['token = "abcdef123456XYZ"', "PassWord:short api_key='A1b2C3d4E5f6G7'", "AKIA" + "ABCD1234EFGH5678", "aKIA1", "deadbeef" * 3, "x" * 50, None, "", "secret=" + "k" * 11, "toKen=a token=" + "b" * 12, "Kapi_Key = aaaaaaaaaaaaaaaa"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
    for r in secrets.scan(df).collect():
        t = texts[r["doc_id"]] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 12]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
        line = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert not line or set(line.split(",")) <= set(r["spans"].split(","))


def test_secret_network_held_out():
    texts = ["plain words in a row that mean nothing at all " * 10]
    x, y = secrets.labelled_findings(texts, 3000)
    net = secrets.Network()
    net.fit(x[:2000], y[:2000], epochs=6)
    threshold = net.calibrate(x[2000:2500], y[2000:2500], 0.95)
    p = net.score(x[2500:]) >= threshold
    assert p[y[2500:] == 1].mean() > 0.85 and p[y[2500:] == 0].mean() < 0.1


def test_secrets_far_inside_candidates():
    words = "plain words in a row that mean nothing at all but the releases current config of an app in production ".split()
    texts = [" ".join(words * 4)]
    x, y = secrets.labelled_findings(texts, 6000)
    net = secrets.Network()
    net.fit(x[:4500], y[:4500])
    threshold = net.calibrate(x[4500:], y[4500:], secrets.RECALL)
    r = random.Random(6)
    token = lambda n: "".join(r.choices("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", k=n))
    found = {"path": 0, "dots": 0, "access": 0, "hex": 0}
    for _ in range(50):
        key = token(40)
        made = {
            "path": f"see releases/current/config/app.production.key={key} here",
            "dots": f"see releases.current.config.app.production.area.{key} here",
            "access": f"see AKIA{'ABCD1234EFGH5678'}/{key} here",
            "hex": f"see 0123456789abcdef.{key} here",
        }
        for (name, text), spans in zip(made.items(), secrets.find(list(made.values()), net, threshold)):
            found[name] += key not in text or not any(key[i : i + 12] in secrets.redact_text(text, spans) for i in range(29))
    assert min(found.values()) >= 45, found
    plain = ["see releases/current/config/app.production/nothing-of-a-row/mean_words_2024.html here", "see www.example.com/plain/row/of/words/and/more/plain/words/in/production/4711/current here"]
    assert secrets.find(plain, net, threshold) == [[], []]
    run = "see " + "words/in/a/row2/" * 30 + "z here"
    spans = secrets.views(run, 4, len(run) - 5)
    assert set().union(*(range(a, b) for a, b in spans)) == set(range(4, len(run) - 5))


def test_redaction(docs, texts):
    assert secrets.redact_text("ab token=x cd", [(3, 0, 10), (5, 2, 8)]) == "ab <secret> cd"
    got = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert set(got) == set(range(len(texts))) and got[0] is None and got[3] == "one"


# 7 and 10


def vectors_frame(spark):
    r = np.random.default_rng(0)
    x = r.normal(0, 1, (2500, 16))
    x[1000:1100] = x[0]  # ties
    rows = [(i, [float(v) for v in row], 1, "a") for i, row in enumerate(x)]
    bad = [(5000, None, 1, "a"), (5100, [1.0] * 15 + [None], 1, "a"), (5200, [float("nan")] + [1.0] * 15, 1, "a"), (5300, [float("inf")] + [1.0] * 15, 1, "a"), (None, [1.0] * 16, 1, "a"), (5400, [1.0, 2.0], 1, "a"), (5401, [3.0, 4.0], 1, "a"), (5500, [0.0] * 16, 1, "a")]
    return spark.createDataFrame([*rows, *bad, rows[0], rows[7]], "vec_id long, embedding array<double>, rank int, dim string"), {i: row for i, row in enumerate(x)}


def test_exact_top_k(spark):
    df, x = vectors_frame(spark)
    x[5500] = np.zeros(16)
    ids, m = np.array(list(x)), np.floor(1024 * np.stack(list(x.values()))).astype(np.int64)
    want = set()
    for q in ids[ids % 100 == 0]:
        s = m @ m[ids == q][0]
        near = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:10]
        want |= {(int(q), k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(near)}
    want.add((5400, 1, 5401, 1024 * 1024 * 11))
    got = {tuple(r) for r in topk.search(df, block=300, query_block=10).collect()}
    assert got == want


def test_nearest_neighbours(spark):
    df, x = vectors_frame(spark)
    ids, m = np.array(list(x)), np.stack(list(x.values()))
    got = defaultdict(list)
    for r in ann.search(df).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(1))
        near = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        rows = sorted(got[q])
        assert [k for k, _, _ in rows] == list(range(1, 11))
        assert all(abs(d[ids == v][0] - s) < 1e-9 for _, v, s in rows)
        hit += len({int(ids[i]) for i in near} & {v for _, v, _ in rows})
        total += 10
    assert hit / total >= 0.9
    assert [(v, s) for _, v, s in got[5400]] == [(5401, 8**0.5)] and 5500 not in got


def test_vectors_empty(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.search(none).count() == 0 and ann.search(none).count() == 0


# 8


def test_warc(spark, tmp_path):
    pages = [(0, "http://b.example/x", "same"), (1, "http://a.example/", "same"), (2, None, None), (3, "http://a.example/?q=1\r\nX: 1", ""), (4, "http://www.A.example:80/", "other\r\n\r\nWARC/1.1\r\nñ"), (None, "u", "same"), (5, "http://a.example/", "long " * 100_000), (5, "http://a.example/", "long " * 100_000)]
    df = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, record string, size int").repartition(3)
    parts = [sorted_rows for sorted_rows in warc.archive(df, str(tmp_path / "w")).rdd.glom().collect() if sorted_rows]
    rows = [r for part in parts for r in part]
    keys = [(r["urlkey"], r["timestamp"], -1 if r["page_id"] is None else r["page_id"]) for r in rows]
    assert keys == sorted(keys) and len(rows) == len(pages)
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[h or ""] = min(p, first.get(h or "", p))
    for r in rows:
        h = next((h for p, _, h in pages if p == r["page_id"]), None) or ""
        assert r["payload_bytes"] == len(h.encode()) and r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        again = r["page_id"] is not None and first[h] != r["page_id"]
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[h]) if again else ("response", None))


def test_loser_tree():
    r = random.Random(2)
    for k in (0, 1, 2, 3, 5, 8):
        runs = [sorted(r.randrange(20) for _ in range(r.randrange(0, 9))) for _ in range(k)]
        order = list(warc.LoserTree(runs))
        assert [runs[a][b] for a, b in order] == sorted(x for run in runs for x in run)
        assert len(set(order)) == len(order)


# 9


def components_plainly(texts: dict[int, str | None]) -> dict[int, tuple[int, int]]:
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_ngram_join(docs, texts):
    want = components_plainly(dict(enumerate(texts)))
    rows = ngram_join.join(docs).collect()
    assert len(rows) == len(texts) + 1
    assert all((r["n_shingles"], r["component_id"]) == want[r["doc_id"]] for r in rows)


def test_ngram_join_chains_and_short_sets(spark):
    r = random.Random(4)
    words = [f"t{i}" for i in range(8)]
    texts = {}
    for i in range(150):
        texts[i] = " ".join(r.choice(words[:2] if i % 3 else words) for _ in range(r.randint(3, 14)))
    chain = [f"c{i}" for i in range(60)]
    for i in range(12):  # each differs a little from the last
        chain[5 * i] = f"d{i}"
        texts[200 + i] = " ".join(chain)
    common = " ".join(f"p{i}" for i in range(30))
    for i in range(30):  # a shared passage is not a link
        texts[300 + i] = common + " " + " ".join(f"q{i}_{j}" for j in range(30))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    want = components_plainly(texts)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in ngram_join.join(df).collect()}
    assert got == want
    kept = {x["doc_id"] for x in ngram_join.keep_first(df).collect()}
    assert kept == {d for d, (_, c) in want.items() if c == d}


def test_boundary_follows_cost():
    assert ngram_join.choose_boundary({}) == 0
    assert ngram_join.choose_boundary({1: 1000, 2: 1000, 3: 1000}) >= 1
    for s in range(1, 40):
        for t in range(s, 60):
            assert ngram_join.shared(s, t) == next((c for c in range(1, s + 1) if 100 * c >= 75 * (s + t - c)), -(-75 * (s + t) // 175))


# all


def test_empty_tables(empty, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.round_trip(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert toxicity.score(empty, none).count() == 0
    assert packing.pack_documents(empty, WORDS).count() == 0
    assert substring_dedup.repeats(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert ngram_join.join(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).count() == 0 and warc.archive(pages).count() == 0


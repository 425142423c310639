"""Secret scans: three fixed rules, and a character convolutional network over candidates.

The fixed rules always report. The network looks at every further candidate (any stretch of at
least ``MIN_CANDIDATE`` token characters outside the rules' spans, which is as short as a fixed
rule's shortest secret) together with the text around it, in overlapping pictures of ``INSIDE``
characters; a candidate is reported whole if one of them is. It is trained in numpy on labelled
findings: generated secrets of common shapes, and look-alikes that are generated or are the
sample's own long words, each set into surroundings taken from a bounded sample of the texts. A
held-back part of the findings calibrates the score (a logistic fit) and sets the threshold:
the highest one that still finds ``RECALL`` of the held-back secrets.

Edge cases: null text is empty and has no spans; repeated rows each give a row; other columns
are not read; texts are scanned whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_sample

KINDS = ("assign", "access", "hex", "learned")
MIN_CANDIDATE = 12
RECALL = 0.98
#: Texts whose words surround the generated findings in training.
SAMPLE_TEXTS = 200
BEFORE, INSIDE, AFTER = 24, 40, 8
MASK = "<secret>"

# Fixed values of the base rules.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
_MIN_ASSIGN, _MIN_ACCESS = 12, 18

_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % MIN_CANDIDATE)
_LEAD = re.compile("[=/]")
_PLAIN = re.compile("[A-Za-z]{%d,}" % MIN_CANDIDATE)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by the fixed rules, ordered by start, then kind."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in _ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= _MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of every stretch that could be a secret."""
    out, at = [], 0
    for word in text.split():
        if len(word) < MIN_CANDIDATE:
            continue
        at = text.index(word, at)
        out += [(at + m.start(), at + m.end()) for m in _CANDIDATE.finditer(word)]
        at += len(word)
    return out


def picture(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the candidate and its surroundings, each part at a fixed place."""
    parts = (
        text[max(0, start - BEFORE) : start].rjust(BEFORE),
        text[start : min(end, start + INSIDE)].ljust(INSIDE, "\x00"),
        text[end : end + AFTER].ljust(AFTER),
    )
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4")
    return np.where(codes < 128, codes, 127).astype(np.uint8)


def views(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(start, end) of the pictures of a candidate: overlapping ones along all of it, and one after each = or / in it."""
    last = max(0, end - start - INSIDE)
    begins = {*range(start, start + last, INSIDE // 2), start + last}
    begins |= {m.end() for m in _LEAD.finditer(text, start, end) if end - m.end() >= MIN_CANDIDATE}
    return [(s, min(end, s + INSIDE)) for s in sorted(begins)]


def outside(text: str, start: int, end: int, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What spans, ordered by start, leave of a candidate, as far as it still is a candidate."""
    out, at = [], start
    for s, _, e in [*spans, (end, 0, end)]:
        to = min(s, end)
        if to - at >= MIN_CANDIDATE:
            out.append((at, to))
        at = max(at, e)
        if at >= end:
            break
    return out


class Network:
    """Embedding, one convolution with max pooling over each of the three parts, one layer."""

    def __init__(self, seed: int = 7, width: int = 5, filters: int = 24, dims: int = 10):
        r = np.random.default_rng(seed)
        self.width = width
        self.p = {
            "emb": r.normal(0, 0.3, (128, dims)).astype(np.float32),
            "conv": r.normal(0, (width * dims) ** -0.5, (width * dims, filters)).astype(np.float32),
            "cb": np.zeros(filters, np.float32),
            "out": r.normal(0, 0.1, (3 * filters,)).astype(np.float32),
            "ob": np.zeros(1, np.float32),
        }
        total, w = BEFORE + INSIDE + AFTER, width
        # windows of the convolution that begin in each part
        self.parts = ((0, BEFORE - w + 1), (BEFORE - w + 1, BEFORE + INSIDE - w + 1), (BEFORE + INSIDE - w + 1, total - w + 1))
        self.scale = (1.0, 0.0)

    def forward(self, x: np.ndarray):
        e = self.p["emb"][x]
        cols = np.lib.stride_tricks.sliding_window_view(e, self.width, axis=1).transpose(0, 1, 3, 2).reshape(len(x), -1, self.width * e.shape[2])
        z = np.maximum(cols @ self.p["conv"] + self.p["cb"], 0)
        pooled = np.concatenate([z[:, a:b].max(1) for a, b in self.parts], 1)
        return cols, z, pooled, pooled @ self.p["out"] + self.p["ob"][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability that each candidate is a secret."""
        if not len(x):
            return np.zeros(0)
        logit = np.concatenate([self.forward(x[i : i + 1024])[3] for i in range(0, len(x), 1024)])
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit + self.scale[1], -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 8, batch: int = 128, rate: float = 4e-3, seed: int = 3) -> None:
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for i in range(0, len(x), batch):
                rows = order[i : i + batch]
                xs, ys = x[rows], y[rows]
                cols, z, pooled, logit = self.forward(xs)
                d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - ys).astype(np.float32) / len(rows)
                g = {"out": pooled.T @ d, "ob": np.array([d.sum()], np.float32)}
                dp = np.outer(d, self.p["out"])
                dz = np.zeros_like(z)
                f = z.shape[2]
                for k, (a, b) in enumerate(self.parts):
                    best = z[:, a:b].argmax(1) + a
                    np.put_along_axis(dz, best[:, None, :], dp[:, None, k * f : (k + 1) * f], 1)
                dz *= z > 0
                flat = dz.reshape(-1, f)
                g["conv"] = cols.reshape(-1, cols.shape[2]).T @ flat
                g["cb"] = flat.sum(0)
                dcols = (flat @ self.p["conv"].T).reshape(len(rows), -1, self.width, self.p["emb"].shape[1])
                g["emb"] = np.zeros_like(self.p["emb"])
                for j in range(self.width):
                    np.add.at(g["emb"], xs[:, j : j + dcols.shape[1]], dcols[:, :, j])
                step += 1
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> float:
        """Logistic fit of the score on findings held back, and the threshold for ``recall``."""
        logit = np.concatenate([self.forward(x[i : i + 1024])[3] for i in range(0, len(x), 1024)]).astype(float)
        a, b = 1.0, 0.0
        for _ in range(200):
            p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
            a -= 0.05 * (np.mean((p - y) * logit) + 1e-3 * a)
            b -= 0.05 * np.mean(p - y)
        self.scale = (a, b)
        secrets = np.sort(self.score(x)[y == 1])
        return float(secrets[int((1 - recall) * len(secrets))])


def labelled_findings(texts: list[str], n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Generated secrets (1) and look-alikes (0) among words of the sampled texts."""
    r = random.Random(seed)
    words = [w for t in texts for w in t.split()[:400]] or ["the", "of", "and"]
    long = [m[0] for w in words for m in _PLAIN.finditer(w)]
    alnum, hexa = string.ascii_letters + string.digits, "0123456789abcdef"

    def run(letters: str, low: int, high: int) -> str:
        return "".join(r.choices(letters, k=r.randint(low, high)))

    def plain() -> str:
        return re.sub("[^A-Za-z]", "", r.choice(words)) or "word"

    def secret() -> tuple[str, str]:
        kind = r.randrange(10)
        lead = r.choice(["", "", "Authorization: Bearer ", "key=", "auth: ", "credential = ", "client id ", "pwd: ", "export KEY="])
        if kind == 0:
            return lead, r.choice(["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "rk_live_", "sk-", "npm_", "hf_"]) + run(alnum, 20, 40)
        if kind == 1:
            return lead, "AIza" + run(alnum + "-_", 35, 35)
        if kind == 2:
            part = lambda n: base64.urlsafe_b64encode(r.randbytes(n)).decode().rstrip("=")
            return lead, f"eyJ{part(18)}.eyJ{part(24)}.{part(32)}"
        if kind == 3:
            return lead, base64.b64encode(r.randbytes(r.choice([20, 24, 32, 40]))).decode()
        if kind == 4:
            return lead, run(alnum, 20, 44)
        if kind == 5:
            return lead, run(hexa, 32, 64)
        if kind == 6:
            return "", f"{r.choice(['postgres', 'mysql', 'amqp'])}-{run(alnum, 18, 30)}"
        if kind == 7:
            return lead, run(string.ascii_uppercase + string.digits, 20, 32)
        if kind == 8:  # no digit
            return lead, run(string.ascii_letters, 16, 40)
        return lead, run(alnum + "+/_-", 12, 19)

    def lookalike() -> tuple[str, str]:
        kind = r.randrange(20)
        if kind >= 12:  # what most candidates are
            word = r.choice(long) if long else "".join(plain().lower() for _ in range(MIN_CANDIDATE))[:18]
            return "", r.choice([word, word.upper(), word.capitalize()]) + r.choice(["", "", ".", "-", "="])
        if kind == 10:
            return "", run(string.digits, 12, 22)
        if kind == 11:
            return "", "".join(plain().lower() + r.choice(["", "", ".", "-", "_"]) for _ in range(3)).ljust(MIN_CANDIDATE, "e")
        if kind == 0:
            return r.choice(["https://", "www.", "http://", ""]), f"{plain().lower()}.example.com/{plain().lower()}/{r.randrange(9999)}/{plain().lower()}"
        if kind == 1:
            return "", f"{plain().lower()}.{plain().lower()}{r.randrange(999)}@example.org".replace("@", ".at.")
        if kind == 2:
            return "", f"{r.choice(['IBAN', 'DE', 'FR', 'ES', 'GB'])}{run(string.digits, 16, 22)}"
        if kind == 3:
            return "", f"{plain()}_{plain()}_{r.randrange(2030)}.{r.choice(['pdf', 'txt', 'html', 'csv'])}"
        if kind == 4:
            return "", f"20{r.randrange(10, 30)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}T{r.randrange(10, 24)}.{r.randrange(10, 60)}.{r.randrange(10, 60)}Z"
        if kind == 5:
            return "", f"{plain()}{plain()}{plain()}{r.randrange(100)}".ljust(MIN_CANDIDATE, "a")
        if kind == 6:
            return "", f"v{r.randrange(20)}.{r.randrange(20)}.{r.randrange(400)}-{plain().lower()}.{r.randrange(20)}"
        if kind == 7:
            return "", f"{plain().lower()}-{plain().lower()}-{plain().lower()}-{r.randrange(9999)}"
        if kind == 8:
            return "", f"{run('=-_.', 8, 20)}{plain()}{r.randrange(99)}{run('=-_.', 4, 12)}"
        return "", f"{run(string.digits, 3, 4)}-{run(string.digits, 3, 4)}-{run(string.digits, 4, 8)}x{r.randrange(9999)}"

    xs, ys = [], []
    for i in range(n):
        lead, body = secret() if i % 2 else lookalike()
        at = r.randrange(len(words))
        before, after = " ".join(words[at : at + 6]) + " " + lead, r.choice([" ", ". ", ", ", '" ']) + " ".join(words[at + 6 : at + 9])
        quote = r.choice(["", "", '"', "'", "("])
        if r.random() < 0.3:  # the end of a long run
            quote += "".join(plain().lower() + r.choice("///..-_") for _ in range(r.randint(2, 8)))
            quote += r.choice(["", "", "key=", "id="])
            lead = ""
            before = " ".join(words[at : at + 6]) + " "
        text = before + quote + body + after
        start = len(before) + len(quote)
        # one of the pictures that find() takes: of a secret the one with most of it, of a look-alike any
        whole = start - len(re.search(r"[A-Za-z0-9+/_.=-]*\Z", text[:start])[0])
        seen = views(text, whole, start + len(body))
        s, e = max(seen, key=lambda v: (min(v[1], start + len(body)) - max(v[0], start), v[0])) if i % 2 else r.choice(seen)
        xs.append(picture(text, s, e))
        ys.append(i % 2)
    return np.array(xs), np.array(ys, np.float32)


def train(docs: DataFrame, sample: int = SAMPLE_TEXTS, findings: int = 10_000, recall: float = RECALL) -> tuple[Network, float]:
    """A network and its threshold; surroundings come from about ``sample`` texts chosen by hash."""
    texts = hash_sample(docs.select("doc_id", "text"), "doc_id", sample).where(F.length("text").between(20, 20_000))
    x, y = labelled_findings(sorted(r["text"] for r in texts.collect()), findings)
    fit, held = slice(0, int(0.75 * findings)), slice(int(0.75 * findings), None)
    network = Network()
    network.fit(x[fit], y[fit])
    return network, network.calibrate(x[held], y[held], recall)


def find(texts: list[str], network: Network, threshold: float) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: those of the rules, then learned ones, which are what the rules leave
    of a candidate if any of its pictures reaches the threshold."""
    out, asked, pictures = [], [], []

    def judge() -> None:
        hits = {span for span, score in zip(asked, network.score(np.array(pictures))) if score >= threshold}
        for k, start, end in hits - done:
            out[k].append((start, 3, end))
        done.update(hits)
        asked.clear()
        pictures.clear()

    done: set[tuple[int, int, int]] = set()
    for k, text in enumerate(texts):
        base = base_spans(text)
        out.append(list(base))
        first = 0
        for start, end in candidates(text):
            while first < len(base) and base[first][0] < start and base[first][2] <= start:
                first += 1
            near = []
            for i in range(first, len(base)):
                if base[i][0] >= end:
                    break
                near.append(base[i])
            for piece in outside(text, start, end, near):
                for s, e in views(text, *piece):
                    asked.append((k, *piece))
                    pictures.append(picture(text, s, e))
                    if len(pictures) >= 16_384:
                        judge()
    if pictures:
        judge()
    return [sorted(spans) for spans in out]


def _line(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model: tuple[Network, float] | None = None) -> DataFrame:
    """Per document: doc_id, counts per fixed rule, digest of their spans, and all spans."""
    network, threshold = model or train(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, spans in zip(batch["doc_id"], find(list(batch["text"]), network, threshold)):
                base = [s for s in spans if s[1] < 3]
                kinds = [k for _, k, _ in base]
                rows.append((doc, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(_line(base).encode()).hexdigest(), _line(spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    # ids travel as strings: a batch with nulls would make them floats
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    made = source.mapInPandas(run, "doc_id string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    return made.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def redact_text(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with every span, overlapping ones joined, replaced by the mask."""
    out, at, reach = [], 0, -1
    for start, _, end in spans:
        if start >= reach:
            out += [text[at:start], mask]
        reach = max(reach, end)
        at = max(at, reach)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: tuple[Network, float] | None = None) -> DataFrame:
    """The documents, all of them, with their secrets masked; n_chars follows the new text."""
    import pyarrow as pa

    network, threshold = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            found = find([t or "" for t in texts], network, threshold)
            masked = [None if t is None else redact_text(t, s) for t, s in zip(texts, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(masked, batch.schema.field(at).type))

    cleaned = docs.mapInArrow(run, docs.schema)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else cleaned

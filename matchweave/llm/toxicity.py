"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

Each word enters the network as a vector from two inputs: the word itself (a learned vector
for words known from training) and its characters (the mean of learned vectors of its known
four-letter stretches, and the largest of their log-odds). A forward and a backward gated
recurrent layer run over the words, attention pools their states over a window of ``WINDOW``
words, and one layer gives the window's score. Gates are piecewise linear and states are squashed
by x / (1 + |x|), which cost a fraction of exponentials. A text's score is that of its highest
window, mapped to a probability by a logistic fit. A window begins at every word: all overlapping
windows of the whole text are scored. They share the layers' states, which run over stretches of
``STRETCH`` words and ``CONTEXT`` more on either side, so a window's sums of weights and weighted
states are differences of running sums. Long runs without white space are split into words that
the network reads whole.

Training is plain numpy on a bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN``
rows, chosen by hash, of at most ``MAX_CHARS`` characters) that never includes held-out rows:
crc32 of the id's text modulo 5 is 0. A quarter of the sample is kept from the weights and
fits the final mapping.

Edge cases: a null, empty or all-blank text is one window of one unknown word; repeated rows
each give a row; language, source and id are never read as inputs; a row without an id is not
held out; of several labels of one id the toxic one counts, of several texts the first in order;
with no usable labels of both kinds every text scores 0.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window; training picks its windows from every ``STRIDE``-th start, scores take every start.
WINDOW, STRIDE = 40, 30
#: Words of a stretch, the words around it that its states begin from, and stretches computed at a time.
STRETCH, CONTEXT, BLOCK = 256, 16, 512
HIDDEN, DIMS = 8, 8
GRAM, WORD_CHARS, MAX_GRAMS = 4, 24, 23
MAX_TOXIC, MAX_CLEAN, MAX_CHARS = 1500, 2000, 20_000
VOCABULARY = 30_000
#: A clean text weighs so much in the final mapping: the sample holds fewer of them than there are.
CLEAN_WEIGHT = 5.0
#: Words whose network inputs a worker remembers.
CACHE_LIMIT = 150_000
#: Where the words of a run without white space are joined; characters without width are joints as well.
_JOINTS = re.compile(r"[-_/\\,;:.|+=&?<>()\[\]{}\"\u00ad\u180e\u200b-\u200f\u2028-\u202e\u2060-\u2064\ufeff\u3001\u3002\uff0c\uff01\uff1f]+")
EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def words_of(text: str | None) -> list[str]:
    """The words of a text, none longer than the network reads."""
    words = (text or "").lower().split()
    if not words:
        return [""]
    if len(max(words, key=len)) < WORD_CHARS - 1:
        return words
    return [p for w in words for p in ([w] if len(w) < WORD_CHARS - 1 else _parts(w))]


def _parts(run: str) -> list[str]:
    """A long run in words of at most ``WORD_CHARS - 2`` characters: split where words are joined, else cut so that every stretch of ``GRAM`` letters is whole in one of them."""
    size = WORD_CHARS - 2
    bare = run.strip(EDGE)
    if len(bare) <= size:
        return [bare]
    out = []
    for part in filter(None, _JOINTS.split(bare)):
        out += [part] if len(part) <= size else [part[i : i + size] for i in range(0, len(part) - GRAM + 1, size - GRAM + 1)]
    return out or [""]


def grams(words: list[str]) -> np.ndarray:
    """(words, MAX_GRAMS) codes of the four-letter stretches of each word with its edges; 0: none."""
    fixed = np.array(["^" + w[: WORD_CHARS - 2] + "$" for w in words], f"U{WORD_CHARS + GRAM - 2}")
    codes = fixed.view(np.uint32).reshape(len(words), -1).astype(np.uint64)
    out = np.zeros((len(words), codes.shape[1] - GRAM + 1), np.uint64)
    for j in range(GRAM):
        out = (out + codes[:, j : j + out.shape[1]]) * np.uint64(0x9E3779B97F4A7C15)
    out[codes[:, GRAM - 1 :] == 0] = 0
    return out[:, :MAX_GRAMS]


def _gate(x: np.ndarray) -> np.ndarray:
    """Piecewise linear sigmoid: its slope at 0 is the logistic function's."""
    return np.clip(np.float32(0.25) * x + np.float32(0.5), 0, 1)


def _squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


class Network:
    def __init__(self, words: dict[str, float], gram_odds: dict[int, float], seed: int = 5):
        """``words`` and ``gram_odds``: log-odds of what training knows; they start its vectors."""
        r = np.random.default_rng(seed)
        h, d = HIDDEN, 2 * DIMS + 1
        self.word_row = {w: i + 1 for i, w in enumerate(words)}
        keys = np.array(sorted(gram_odds), np.uint64)
        self.gram_keys = keys
        word = r.normal(0, 0.02, (len(words) + 1, DIMS))
        word[0] = 0
        word[1:, 0] = list(words.values())
        gram = r.normal(0, 0.02, (len(keys) + 1, DIMS))
        gram[0] = 0
        gram[1:, 0] = [gram_odds[int(k)] for k in keys]
        self.gram_odds = np.concatenate([[0], [gram_odds[int(k)] for k in keys]]).astype(np.float32)
        p = {"word": word, "gram": gram, "x": r.normal(0, d**-0.5, (d, 6 * h)), "b": np.zeros(6 * h), "u0": r.normal(0, h**-0.5, (h, 3 * h)), "u1": r.normal(0, h**-0.5, (h, 3 * h))}
        p |= {"a": r.normal(0, (2 * h) ** -0.5, (2 * h, h)), "v": r.normal(0, h**-0.5, h), "o": r.normal(0, 0.3, 2 * h), "c": np.zeros(1)}
        self.p = {k: w.astype(np.float32) for k, w in p.items()}
        self.scale, self.token = (1.0, 0.0), uuid.uuid4().hex

    # inputs

    def gram_rows(self, words: list[str]) -> np.ndarray:
        codes = grams(words)
        if not len(self.gram_keys):
            return np.zeros(codes.shape, np.int32)
        at = np.minimum(np.searchsorted(self.gram_keys, codes), len(self.gram_keys) - 1)
        return np.where(self.gram_keys[at] == codes, at + 1, 0).astype(np.int32)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Vectors of words, and what they were made from: rows of the word and of its stretches."""
        words = [w.strip(EDGE) for w in words]
        rows = np.fromiter((self.word_row.get(w, 0) for w in words), np.int32, len(words))
        parts = self.gram_rows(words)
        share = (1 / np.maximum(1, (parts > 0).sum(1))).astype(np.float32)
        x = np.concatenate([self.p["word"][rows], self.p["gram"][parts].sum(1) * share[:, None], self.gram_odds[parts].max(1)[:, None]], 1)
        return x, rows, parts, share

    def project(self, words: list[str]) -> np.ndarray:
        out = np.empty((len(words), 6 * HIDDEN), np.float32)
        for i in range(0, len(words), 4096):
            out[i : i + 4096] = self.inputs(words[i : i + 4096])[0] @ self.p["x"] + self.p["b"]
        return out

    # the recurrent layers

    def _layer(self, px: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        n, length, _ = px.shape
        h, out = np.zeros((n, HIDDEN), np.float32), np.empty((length, n, HIDDEN), np.float32)
        for t in range(length):
            hu = h @ u
            zr = _gate(px[:, t, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            new = _squash(px[:, t, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
            m = mask[:, t, None]
            nxt = h + m * (1 - z) * (new - h)
            if keep is not None:
                keep.append((h, z, r, new, hu[:, 2 * HIDDEN :], m))
            h = out[t] = nxt
        return out

    def forward(self, px: np.ndarray, mask: np.ndarray, pool: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Score (before the logistic) of each window; px: projected words of it and around it, mask: 1
        where a word is, pool: 1 where a word of the window is."""
        k0, k1 = ([], []) if keep is not None else (None, None)
        fore = self._layer(px[:, :, : 3 * HIDDEN], mask, self.p["u0"], k0)
        back = self._layer(px[:, ::-1, 3 * HIDDEN :], mask[:, ::-1], self.p["u1"], k1)[::-1]
        states = np.concatenate([fore, back], 2)
        hidden = _squash(states @ self.p["a"])
        raw = np.where(pool.T > 0, hidden @ self.p["v"], np.float32(-1e9))
        weight = np.exp(raw - raw.max(0))
        weight /= weight.sum(0)
        pooled = (weight[:, :, None] * states).sum(0)
        if keep is not None:
            keep |= {"k0": k0, "k1": k1, "states": states, "hidden": hidden, "weight": weight, "pooled": pooled}
        return pooled @ self.p["o"] + self.p["c"][0]

    def _layer_back(self, kept: list, dout: np.ndarray, u: np.ndarray, du: np.ndarray) -> np.ndarray:
        length, n, _ = dout.shape
        dpx, dh = np.empty((n, length, 3 * HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        for t in range(length - 1, -1, -1):
            h, z, r, new, hun, m = kept[t]
            dh = dh + dout[t]
            # the slope of x / (1 + |x|) is the square of 1 - |its value|
            dnew = dh * m * (1 - z) * (1 - np.abs(new)) ** 2
            dz = -dh * m * (new - h) * ((z > 0) & (z < 1)) * np.float32(0.25)
            dr = dnew * hun * ((r > 0) & (r < 1)) * np.float32(0.25)
            dpx[:, t] = np.concatenate([dz, dr, dnew], 1)
            dhu = np.concatenate([dz, dr, dnew * r], 1)
            du += h.T @ dhu
            dh = dh * (1 - m * (1 - z)) + dhu @ u.T
        return dpx

    def gradients(self, px: np.ndarray, mask: np.ndarray, pool: np.ndarray, y: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
        k: dict = {}
        logit = self.forward(px, mask, pool, k)
        d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y).astype(np.float32) / len(y)
        g = {"o": k["pooled"].T @ d, "c": np.array([d.sum()], np.float32), "u0": np.zeros_like(self.p["u0"]), "u1": np.zeros_like(self.p["u1"])}
        dpool = np.outer(d, self.p["o"])
        dstates = k["weight"][:, :, None] * dpool
        dweight = (dpool * k["states"]).sum(2)
        draw = k["weight"] * (dweight - (k["weight"] * dweight).sum(0))
        dhid = draw[:, :, None] * self.p["v"] * (1 - np.abs(k["hidden"])) ** 2
        g["v"] = np.tensordot(draw, k["hidden"], ((0, 1), (0, 1)))
        g["a"] = np.tensordot(k["states"], dhid, ((0, 1), (0, 1)))
        dstates = dstates + dhid @ self.p["a"].T
        d0 = self._layer_back(k["k0"], dstates[:, :, :HIDDEN], self.p["u0"], g["u0"])
        d1 = self._layer_back(k["k1"], dstates[::-1, :, HIDDEN:], self.p["u1"], g["u1"])[:, ::-1]
        return g, np.concatenate([d0, d1], 2), logit

    def fit(self, vocabulary: list[str], rows: np.ndarray, mask: np.ndarray, pool: np.ndarray, y: np.ndarray, epochs: int, batch: int = 128, rate: float = 5e-3, seed: int = 1) -> None:
        """Adam over windows given as rows of ``vocabulary``."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(w) for k, w in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for i in range(0, len(order), batch):
                take = order[i : i + batch]
                used, local = np.unique(rows[take], return_inverse=True)
                local = local.reshape(rows[take].shape)
                x, word_rows, parts, share = self.inputs([vocabulary[j] for j in used])
                g, dpx, _ = self.gradients((x @ self.p["x"] + self.p["b"])[local], mask[take], pool[take], y[take])
                per_word = np.zeros((len(used), 6 * HIDDEN), np.float32)
                np.add.at(per_word, local, dpx * mask[take][:, :, None])
                g["x"], g["b"] = x.T @ per_word, per_word.sum(0)
                dx = per_word @ self.p["x"].T
                g["word"], g["gram"] = np.zeros_like(self.p["word"]), np.zeros_like(self.p["gram"])
                np.add.at(g["word"], word_rows, dx[:, :DIMS])
                np.add.at(g["gram"], parts, (dx[:, DIMS : 2 * DIMS] * share[:, None])[:, None, :])
                g["word"][0] = g["gram"][0] = 0
                step += 1
                for name, w in self.p.items():
                    m[name] = 0.9 * m[name] + 0.1 * g[name]
                    v[name] = 0.999 * v[name] + 0.001 * g[name] ** 2
                    w -= rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)

    # whole texts

    def _run(self, x: np.ndarray, u: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """What the attention and the last layer take of a layer's states; x: (steps, 3 * HIDDEN, stretches)."""
        h, zero, one = HIDDEN, np.float32(0), np.float32(1)
        steps, _, n = x.shape
        both = np.ascontiguousarray(np.concatenate([u.T * np.repeat(np.array([0.25, 1], np.float32), (2 * h, h))[:, None], ends]))
        state, mixed, new, size = np.zeros((h, n), np.float32), np.zeros((4 * h + 1, n), np.float32), np.empty((h, n), np.float32), np.empty((h, n), np.float32)
        gates, keep, reset, mine, shown = mixed[: 2 * h], mixed[:h], mixed[h : 2 * h], mixed[2 * h : 3 * h], mixed[3 * h :]
        out = np.empty((steps, h + 1, n), np.float32)
        for t in range(steps):
            gates += x[t, : 2 * h]
            gates.clip(zero, one, gates)
            np.multiply(mine, reset, new)
            new += x[t, 2 * h :]
            np.abs(new, size)
            size += one
            new /= size
            # h + (1 - z)(new - h) is new + z(h - new)
            state -= new
            state *= keep
            state += new
            np.matmul(both, state, mixed)
            out[t] = shown
        return out

    def states(self, sizes: np.ndarray, rows) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of texts that lie one after another: its weight in a window, and its part of the score.

        ``rows``: projected words by place. A layer runs over each stretch from ``CONTEXT`` words
        before it, or from the text's edge; stretches of like length are computed together."""
        h, starts = HIDDEN, np.cumsum([0, *sizes])
        made = np.zeros((starts[-1], h + 1), np.float32)
        counts = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), counts)
        first = starts[text] + STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts))
        last = np.minimum(first + STRETCH, starts[text + 1])
        low, high = np.maximum(first - CONTEXT, starts[text]), np.minimum(last + CONTEXT, starts[text + 1])
        ends = np.concatenate([self.p["a"], self.p["o"][:, None]], 1).T
        order = np.argsort(last - first, kind="stable")
        for at in range(0, len(order), BLOCK):
            k = order[at : at + BLOCK]
            for d, u in enumerate((self.p["u0"], self.p["u1"])):
                # steps go up to the stretch's end, or down to its begin
                steps = np.arange((high[k] - first[k] if d else last[k] - low[k]).max())[:, None]
                place = np.maximum(high[k] - 1 - steps, low[k]) if d else np.minimum(low[k] + steps, high[k] - 1)
                x = np.ascontiguousarray(rows(place)[:, :, 3 * h * d : 3 * h * (d + 1)].transpose(0, 2, 1))
                x[:, : 2 * h] *= np.float32(0.25)
                x[:, : 2 * h] += np.float32(0.5)
                shown = self._run(x, u, ends[:, d * h : (d + 1) * h]).transpose(0, 2, 1)
                mine = (place >= first[k]) & (place < last[k]) & (steps < high[k] - low[k])
                made[place[mine]] += shown[mine]
        raw = _squash(made[:, :h]) @ self.p["v"]
        return np.exp(raw.astype(float)), made[:, h].astype(float)

    def highest(self, texts: list[list[str]], lookup) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: the score of its highest window and where that window begins; a window begins at every word."""
        sizes = np.array([*map(len, texts)])
        starts = np.cumsum([0, *sizes])
        weight, part = self.states(sizes, lookup([w for t in texts for w in t]))
        above, below = np.append(0, np.cumsum(weight * part)), np.append(0, np.cumsum(weight))
        end = np.minimum(np.arange(starts[-1]) + WINDOW, np.repeat(starts[1:], sizes))
        score = (above[end] - above[:-1]) / (below[end] - below[:-1]) + float(self.p["c"][0])
        # the windows that the text's end would cut are none, but for a text that is shorter than one
        whole = np.repeat(starts[:-1] + np.maximum(0, sizes - WINDOW), sizes)
        score[np.arange(starts[-1]) > whole] = -np.inf
        begin = np.array([int(score[a:b].argmax()) for a, b in zip(starts, starts[1:])], np.int64)
        return score[starts[:-1] + begin], begin

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit.astype(float) + self.scale[1], -50, 50)))


class Lookup:
    """Projected inputs of words: the first ``CACHE_LIMIT`` words stay, others last one call."""

    def __init__(self, network: Network):
        self.network, self.row = network, {}
        self.table = np.empty((4096, 6 * HIDDEN), np.float32)

    def _keep(self, words: list[str]) -> None:
        size = len(self.row)
        while size + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[size : size + len(words)] = self.network.project(words)
        self.row.update(zip(words, range(size, size + len(words))))

    def __call__(self, words: list[str]):
        rows = np.fromiter(map(self.row.get, words, repeat(-1)), np.int32, len(words))
        if len(missing := np.flatnonzero(rows < 0)):
            asked = [words[i] for i in missing.tolist()]
            new = list(dict.fromkeys(asked))
            room = max(0, CACHE_LIMIT - len(self.row))
            place = dict(zip(new[room:], range(-1, room - len(new) - 1, -1)))
            self._keep(new[:room])
            rows[missing] = np.fromiter((place[w] if w in place else self.row[w] for w in asked), np.int32, len(asked))
        table = self.table
        if not len(missing) or not place:
            return lambda at: table[rows[at]]
        more = self.network.project(new[room:])

        def take(at: np.ndarray) -> np.ndarray:
            r = rows[at]
            out = table[np.maximum(r, 0)]
            out[r < 0] = more[-1 - r[r < 0]]
            return out

        return take


_LOOKUP: list[Lookup] = []


def lookup_of(network: Network | None) -> Lookup | None:
    """This process's lookup for the network: the tasks that a worker runs in turn share it."""
    if network is None:
        return None
    if not _LOOKUP or _LOOKUP[0].network.token != network.token:
        _LOOKUP[:] = [Lookup(network)]
    return _LOOKUP[0]


def _log_odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, least: int, limit: int) -> dict:
    """Log-odds, less 1.5 standard errors, of what occurs in at least ``least`` texts, the strongest ``limit`` of them."""
    odds = {}
    for k in toxic.keys() | clean.keys():
        a, b = toxic[k], clean[k]
        if a + b >= least:
            raw = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_clean + 1))
            sure = abs(raw) - 1.5 * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            if sure > 0:
                odds[k] = float(np.sign(raw) * min(sure, 3))
    return dict(sorted(odds.items(), key=lambda x: (-abs(x[1]), x[0]))[:limit])


def fit_network(texts: list[str], labels: list[int]) -> Network | None:
    """Trains on labelled texts; None if one of the two labels is missing."""
    docs = [words_of(t) for t in texts]
    y = np.array(labels, np.float32)
    held = np.arange(len(docs)) % 4 == 3
    if min((y[~held] == 0).sum(), (y[~held] == 1).sum()) == 0:
        return None
    seen, gram_seen = (Counter(), Counter()), (Counter(), Counter())
    for k in np.flatnonzero(~held):
        kinds = sorted({w.strip(EDGE) for w in docs[k]})
        seen[int(y[k])].update(kinds)
        gram_seen[int(y[k])].update(np.unique(grams(kinds)).tolist())
    n = int((y[~held] == 1).sum()), int((y[~held] == 0).sum())
    words = _log_odds(seen[1], seen[0], *n, 3, VOCABULARY)
    gram_odds = _log_odds(gram_seen[1], gram_seen[0], *n, 3, 2 * VOCABULARY)
    del seen, gram_seen
    words.pop("", None)
    gram_odds.pop(0, None)
    network = Network(words, gram_odds)

    vocabulary = sorted({w for k in np.flatnonzero(~held) for w in docs[k]})
    at = {w: i for i, w in enumerate(vocabulary)}
    x = np.concatenate([network.inputs(vocabulary[i : i + 4096])[0] for i in range(0, len(vocabulary), 4096)])
    strength = x[:, 0] + x[:, DIMS] + x[:, -1]
    r = np.random.default_rng(0)

    def windows(k: int, scores: np.ndarray | None = None) -> list[int]:
        """Starts of the windows of a text to learn from: the strongest, and one at random."""
        starts = np.arange(max(1, -(-(len(docs[k]) - (WINDOW - STRIDE)) // STRIDE))) * STRIDE
        ids = np.array([at[w] for w in docs[k]])
        value = [np.sort(strength[ids[s : s + WINDOW]])[-3:].sum() for s in starts]
        top = starts[np.argsort(value)[::-1][:2]].tolist()
        return top if y[k] else [*top, int(r.choice(starts))]

    def gather(pairs: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        width = WINDOW + 2 * CONTEXT
        rows, mask, pool = np.zeros((len(pairs), width), np.int32), np.zeros((len(pairs), width), np.float32), np.zeros((len(pairs), width), np.float32)
        for i, (k, s) in enumerate(pairs):
            before = min(s, CONTEXT)
            part = docs[k][s - before : s + WINDOW + CONTEXT]
            at_ = CONTEXT - before
            rows[i, at_ : at_ + len(part)] = [at[w] for w in part]
            mask[i, at_ : at_ + len(part)] = 1
            pool[i, CONTEXT : CONTEXT + min(WINDOW, len(docs[k]) - s)] = 1
        return rows, mask, pool, y[[k for k, _ in pairs]]

    train = np.flatnonzero(~held)
    pairs = [(k, s) for k in train for s in windows(k)]
    epochs = max(3, min(12, 24_000 // len(pairs)))
    network.fit(vocabulary, *gather(pairs), epochs=epochs)
    # each text's own highest window: what a clean text must not have, what a toxic one must
    lookup = Lookup(network)
    mined = [(k, int(network.highest([docs[k]], lookup)[1][0])) for k in train]
    network.fit(vocabulary, *gather([*mined, *pairs]), epochs=max(2, epochs // 3), rate=2e-3, seed=2)
    lookup = Lookup(network)
    logit = np.concatenate([network.highest(docs[i : i + 64], lookup)[0] for i in range(0, len(docs), 64)]).astype(float)
    use = held if min((y[held] == 0).sum(), (y[held] == 1).sum()) else ~held
    a, b = 1.0, 0.0
    weight = np.where(y[use] == 1, 1.0, CLEAN_WEIGHT)
    weight /= weight.sum()
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(a * logit[use] + b, -30, 30)))
        a -= 0.1 * (np.sum(weight * (p - y[use]) * logit[use]) + 1e-3 * (a - 1))
        b -= 0.1 * np.sum(weight * (p - y[use]))
    network.scale = (max(a, 0.05), b)
    return network


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Network | None:
    """Trains on rows that are not held out: a bounded number of each label, chosen by hash."""
    usable = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    chosen = [usable.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in ((1, max_toxic), (0, max_clean))]
    # at most max_toxic + max_clean ids
    sample = docs.select("doc_id", "text").where(F.length("text") <= MAX_CHARS).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    rows = sorted((r["doc_id"], r["text"], r["toxic"]) for r in sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect())
    return fit_network([t for _, t, _ in rows], [k for _, _, k in rows]) if rows else None


def scores_of(texts: list[str | None], network: Network | None, lookup: Lookup | None) -> np.ndarray:
    if network is None:
        return np.zeros(len(texts))
    out, docs, size = [], [], 0
    for text in texts:  # so many words at a time that memory stays small
        docs.append(words_of(text))
        size += len(docs[-1])
        if size >= 100_000:
            out.append(network.probability(network.highest(docs, lookup)[0]))
            docs, size = [], 0
    if docs:
        out.append(network.probability(network.highest(docs, lookup)[0]))
    return np.concatenate(out) if out else np.zeros(0)


def score(docs: DataFrame, labels: DataFrame, network: Network | None = None) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 from a score of 0.5)."""
    network = network or train(docs, labels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = lookup_of(network)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scores_of(list(batch["text"]), network, lookup)})

    # ids travel as strings: a batch with nulls would make them floats
    scored = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, score double")
    return scored.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"),
        F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, network: Network | None = None) -> DataFrame:
    """The documents that score under 0.5, with all their columns."""
    import pyarrow as pa

    network = network or train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lookup_of(network)
        for batch in batches:
            scores = scores_of(batch.column(batch.schema.get_field_index("text")).to_pylist(), network, lookup)
            yield batch.filter(pa.array(scores < 0.5))

    return docs.mapInArrow(run, docs.schema)

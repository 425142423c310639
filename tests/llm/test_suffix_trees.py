"""Subtrees against plain nodes: depths, leaves, and repeats of any length read off them."""

import random
from collections import defaultdict

import numpy as np
import pytest

from matchweave.llm import substring_dedup as sd


def spelled(words):
    return b"".join(w + b" " for w in words)


def plain_nodes(suffixes, min_words):
    """(depth, leaves) of every word sequence of at least ``min_words`` that goes on in two ways, or ends."""
    words = [s.split(b" ")[:-1] for s in suffixes]
    below = defaultdict(set)
    for i, w in enumerate(words):
        for k in range(min_words, len(w) + 1):
            below[tuple(w[:k])].add(i)
    out = set()
    for path, leaves in below.items():
        if len(leaves) > 1:
            following = {words[i][len(path)] if len(words[i]) > len(path) else None for i in leaves}
            if len(following) > 1 or None in following:
                out.add((len(path), frozenset(leaves)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_nodes_equal_plain_ones(seed):
    r = random.Random(seed)
    letters = [b"a", b"b", b"a\x01", b"\xc3\xa9", b"ab"]
    texts = [[r.choice(letters) for _ in range(r.randint(3, 25))] for _ in range(8)] + [[b"a"] * 12, [b"a"] * 12]
    suffixes = [spelled(t[i:]) for t in texts for i in range(len(t) - 2)]
    heads = [len(spelled(s.split(b" ")[:3])) for s in suffixes]
    rank = np.array(r.sample(range(len(suffixes)), len(suffixes)))
    leaves, nodes = sd.suffix_tree(suffixes, heads, rank, 3)
    assert sorted(leaves) == list(range(len(suffixes))) and [suffixes[i] for i in leaves] == sorted(suffixes)
    assert {(d, frozenset(leaves[f:s])) for d, f, s in nodes} == plain_nodes(suffixes, 3) and len(nodes) == len(set(nodes))
    depths = sd.repeated_depths(nodes, rank[leaves])
    for leaf, depth in zip(leaves, depths):
        earlier = [sd._common(suffixes[leaf], suffixes[o]) for o in range(len(suffixes)) if rank[o] < rank[leaf]]
        longest = max([n for n in earlier if n >= 3], default=0)
        assert depth == longest


@pytest.mark.parametrize("length", [20, 21, 100, 500])
def test_repeats_of_any_length_come_from_nodes(length):
    r = random.Random(length)
    say = lambda n: [str(r.random()).encode() for _ in range(n)]
    passage = say(length)
    texts = [say(30) + passage + say(40), say(7) + passage + say(5), passage]
    suffixes, places = [], []
    for k, t in enumerate(texts):
        for i in range(len(t) - 19):
            suffixes.append(spelled(t[i:]))
            places.append((k, i))
    heads = [len(spelled(s.split(b" ")[:20])) for s in suffixes]
    leaves, nodes = sd.suffix_tree(suffixes, heads, np.arange(len(suffixes)), 20)
    deepest = max(nodes)
    assert deepest[0] == length and {places[i] for i in leaves[deepest[1] : deepest[2]]} == {(0, 30), (1, 7), (2, 0)}
    depths = dict(zip(leaves, sd.repeated_depths(nodes, np.array(leaves))))
    found = {places[i]: d for i, d in depths.items() if d}
    assert found == {(k, s + i): length - i for k, s in ((1, 7), (2, 0)) for i in range(length - 19)}


def test_one_word_over_and_over(spark):
    """A stretch of equal words has suffixes of bounded length."""
    rows = [(1, "q " * 3000), (2, "q " * 3000), (3, "p " + "q " * 100)]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in sd.repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == {1: (3000, 2999), 2: (3000, 3000), 3: (101, 100)}

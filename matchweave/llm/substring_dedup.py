"""Removes words inside long repeats, found by prefix-partitioned suffix trees.

A suffix is a document's word sequence from some word on. Only suffixes that can repeat enter a tree. Every suffix holds
one anchor, its smallest run of ``ANCHOR`` words by hash; equal suffixes have equal anchors. So
suffixes whose anchor occurs once in the corpus are left out, and no repeat is lost.

The others are split by their prefixes into groups that fit into memory. Equal prefixes of
``min_words`` words have equal anchors, so the anchor is the first split; it lets neighbouring
suffixes with one anchor travel as one stretch of words. A group of more than ``GROUP`` bytes
is split again, by prefixes of 4 words, and where those still are too large, of 8, 16 and
``min_words``. Each group's subtree is built from the words themselves: its suffixes in order are
the leaves, the words that neighbours have in common give the inner nodes, and a node of at least
``min_words`` words is a repeat, as long as it is deep, that occurs at its leaves. Every leaf but a
node's earliest loses the words of the deepest node on its way to the root that has an earlier
one; together these are the maximal repeats of a document. Hashes only decide where suffixes
meet, never which are equal. A suffix reaches to the end of its stretch, ``DEEPEST`` words at most;
what goes on longer has suffixes of its own. In groups split by prefixes suffixes have
``min_words`` words.

Each task first joins the equal suffixes of its own and sends on only one of them, so a passage in a third of all documents reaches its group once per task. Of an anchor that a task
sees often, two rows meet the other tasks' rows; the rest are known to repeat and are spread.

Edge cases: a null text has no words; documents of fewer than ``min_words`` words keep all; a
repeated row (same id and text) is not earlier than itself, so all its copies keep or lose the
same words; rows of one id with different texts are different documents, in the order of a
hash of their texts; rows without an id keep all words and are nobody's earlier copy; an empty
table gives no rows; doc_id must be an integer; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, rolling, word_hashes

MIN_WORDS, ANCHOR = 20, 10
#: Bytes that a group holds at most before longer prefixes split it, unless that makes more than
#: ``MOST_SPLIT`` groups: then a ``MOST_SPLIT``-th of all bytes.
GROUP, MOST_SPLIT = 1 << 18, 10_000
#: Words of a suffix at most.
DEEPEST = 64
#: Lengths of the prefixes that split large groups; the last is the whole suffix.
PREFIXES = (4, 8, 16)
#: Suffixes whose subtrees are built at a time, and bytes of text that a task holds for its own.
LEAVES, HELD = 50_000, 1 << 25
#: Anchors that a task remembers as repeated.
KNOWN = 1 << 20

_A, _P, _F = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_TOP = np.uint64(2**64 - 1)


def _slide(x: np.ndarray, width: int, f) -> np.ndarray:
    """Minimum or maximum of each run of ``width`` values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def anchors(hashes: np.ndarray, min_words: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the run at each word, whether some suffix has it as its smallest)."""
    runs = rolling(hashes, anchor, _A)
    width = min_words - anchor + 1
    if len(runs) < width:
        return runs, np.zeros(len(runs), bool)
    low = _slide(runs, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return runs, _slide(np.concatenate([edge, low, edge]), width, np.maximum) == runs


class _Spread:
    """Deals the anchors of a task: (key, sure). Of each anchor at most two rows keep its hash as
    their key; the anchors of the others are sure to repeat, and their keys are spread."""

    def __init__(self):
        self.known = np.empty(0, np.uint64)

    def __call__(self, runs: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(runs, kind="stable")
        value = runs[order]
        new = np.append(True, value[1:] != value[:-1])
        nth = np.arange(len(value)) - np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
        sure = np.empty(len(runs), bool)
        sure[order] = nth >= 2
        if len(self.known):
            sure |= self.known[np.minimum(np.searchsorted(self.known, runs), len(self.known) - 1)] == runs
        if len(self.known) < KNOWN:
            self.known = np.union1d(self.known, value[nth == 1])
        spread = mix(mix(docs.view(np.uint64) * np.uint64(_P)) ^ places.astype(np.uint64))
        return np.where(sure, spread, runs).view(np.int64), sure


def _repeated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of anchors sorted by key, those that are sure or share their key with a neighbour."""
    last, kept = None, False
    for batch in batches:
        if last is not None:
            batch = pd.concat([last, batch], ignore_index=True)
        key = batch["key"].to_numpy()
        same = key[1:] == key[:-1]
        keep = np.append(False, same) | np.append(same, False)
        keep[0] |= kept
        kept = bool(keep[-1])  # the last row waits for its successor
        yield batch.iloc[:-1][keep[:-1] | batch["sure"].to_numpy()[:-1]][["doc_id", "place"]]
        last = batch.iloc[-1:]
    if last is not None and (kept or last["sure"].iloc[0]):
        yield last[["doc_id", "place"]]


class _Text:
    """A document's words, joined by one space, and where each begins."""

    def __init__(self, text: bytes):
        words = text.split()
        self.words = b" ".join(words)
        self.begin = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=self.begin[1:])

    def part(self, start: int, stop: int) -> bytes:
        return self.words[self.begin[start] : self.begin[stop] - 1]


def _own_leaves(texts: list[_Text], path: np.ndarray, owner: np.ndarray, start: np.ndarray, rank: np.ndarray, min_words: int) -> np.ndarray:
    """Which of a task's suffixes repeat an earlier one of its own, word for word.

    ``rank``: the documents' places in the order of their ids. Hashes propose the pairs; the words
    of pairs that follow one another in both documents are compared in one go."""
    order = np.lexsort((start, rank[owner], path))
    p = path[order]
    new = np.append(True, p[1:] != p[:-1])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
    late = np.zeros(len(path), bool)
    first = np.empty(len(path), np.int64)
    first[order] = head
    at = np.flatnonzero((rank[owner] != rank[owner[first]]) | (start != start[first]))
    if not len(at):
        return late
    late[at] = True
    o, s, ho, hs = owner[at], start[at], owner[first[at]], start[first[at]]
    edge = np.flatnonzero((np.diff(o) != 0) | (np.diff(s) != 1) | (np.diff(ho) != 0) | (np.diff(hs) != 1)) + 1
    for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(at)]):
        mine, other, n = texts[o[a]], texts[ho[a]], b - a + min_words - 1
        if mine.part(s[a], s[a] + n) != other.part(hs[a], hs[a] + n):
            for i in range(a, b):
                late[at[i]] = mine.part(s[i], s[i] + min_words) == other.part(hs[i], hs[i] + min_words)
    return late


def _kept(words: list[bytes], starts: np.ndarray, lengths: np.ndarray | int) -> tuple[bytes, int]:
    """The words outside the repeats that begin at ``starts``, and how many are inside."""
    cover = np.zeros(len(words) + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + lengths, len(words)), -1)
    inside = np.cumsum(cover[:-1]) > 0
    return b" ".join([w for w, gone in zip(words, inside) if not gone]), int(inside.sum())


def _common(a: bytes, b: bytes) -> int:
    """How many words two suffixes share from their beginning; each word ends in a space."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return a.count(b" ", 0, high)
    while high - low > 1:  # they agree up to low and differ before high
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return a.count(b" ", 0, low)


def suffix_tree(suffixes: list[bytes], heads: list[int], rank: np.ndarray, min_words: int) -> tuple[list[int], list[tuple[int, int, int]]]:
    """(leaves, nodes) of the suffix tree of ``suffixes``, whose words each end in a space.

    The leaves are the suffixes in the order of their words, equal ones by ``rank``. A node (depth,
    first, stop) has the leaves from first to stop, which share depth words and no more; nodes of fewer
    than ``min_words`` are left out, and children come before their parents. ``heads``: bytes of
    each suffix's first ``min_words`` words."""
    leaves = np.argsort(rank, kind="stable").tolist()
    leaves.sort(key=suffixes.__getitem__)
    ordered, sizes = [suffixes[i] for i in leaves], [heads[i] for i in leaves]
    nodes: list[tuple[int, int, int]] = []
    open_: list[tuple[int, int]] = []
    last = b""
    for i, (own, size) in enumerate(zip(ordered, sizes)):
        shared = _common(last, own) if last[:size] == own[:size] else 0
        first = i - 1
        while open_ and open_[-1][0] > shared:
            depth, first = open_.pop()
            nodes.append((depth, first, i))
        if shared >= min_words and (not open_ or open_[-1][0] < shared):
            open_.append((shared, first))
        last = own
    while open_:
        depth, first = open_.pop()
        nodes.append((depth, first, len(leaves)))
    return leaves, nodes


def repeated_depths(nodes: list[tuple[int, int, int]], rank: np.ndarray) -> np.ndarray:
    """Of each leaf (``rank`` in their order): the depth of the deepest node with an earlier leaf, or 0."""
    depths = np.zeros(len(rank), np.int32)
    for depth, first, stop in reversed(nodes):
        own = rank[first:stop]
        depths[first:stop][own > own.min()] = depth
    return depths


def _suffixes(stretches: pd.DataFrame, min_words: int) -> tuple[list[bytes], list[int], np.ndarray, np.ndarray]:
    """The suffixes of stretches of words, each word with a space after it: their bytes, how many of
    those their first ``min_words`` words take, their stretch and their place in it."""
    paths, heads, owner, place = [], [], [], []
    for k, words in enumerate(stretches["words"]):
        text = _Text(words)
        line, begin, n = text.words + b" ", text.begin.tolist(), len(text.begin) - min_words
        paths += [line[begin[i] : begin[min(i + DEEPEST, len(begin) - 1)]] for i in range(n)]
        heads += [begin[i + min_words] - begin[i] for i in range(n)]
        owner.append(np.full(n, k))
        place.append(np.arange(n))
    return paths, heads, np.concatenate(owner), np.concatenate(place)


def _late_leaves(min_words: int):
    """Of stretches sorted by group, the leaves of their subtrees that repeat earlier ones, and how far."""

    def judge(held: pd.DataFrame, whole: bool) -> tuple[pd.DataFrame, pd.DataFrame | None]:
        paths, heads, owner, place = _suffixes(held, min_words)
        doc, mark = held["doc_id"].to_numpy()[owner], held["mark"].to_numpy()[owner]
        start = held["start"].to_numpy()[owner] + place
        early = np.lexsort([start, mark, doc])
        new = (np.diff(doc[early]) != 0) | (np.diff(mark[early]) != 0) | (np.diff(start[early]) != 0)
        rank = np.empty(len(early), np.int64)
        rank[early] = np.cumsum(np.append(np.zeros(min(1, len(early)), np.int64), new))  # a repeated row is no earlier one
        order, nodes = suffix_tree(paths, heads, rank, min_words)
        order = np.array(order, np.int64)
        depths = repeated_depths(nodes, rank[order])
        doc, mark, start, late = doc[order], mark[order], start[order], depths > 0
        out = pd.DataFrame({"doc_id": doc[late], "mark": mark[late], "start": start[late], "length": depths[late]})
        if whole:
            return out, None
        # the group goes on: of what is equal, the earliest leaves stay, and no other
        stay = np.flatnonzero(~late)
        return out, pd.DataFrame({"group": held["group"].to_numpy()[owner[order[stay]]], "doc_id": doc[stay], "mark": mark[stay], "start": start[stay], "words": [paths[i][: heads[i] - 1] for i in order[stay].tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, len(batch), LEAVES // 8):
                part = batch.iloc[at : at + LEAVES // 8]
                held.append(part)
                size += len(part)
                if size < LEAVES // 4:
                    continue
                rows = pd.concat(held, ignore_index=True)
                group = rows["group"].to_numpy()
                ended = int(np.searchsorted(group, group[-1]))  # the last group may go on
                held, size = [rows.iloc[ended:]], len(rows) - ended
                if ended:
                    yield judge(rows.iloc[:ended], True)[0]
                if size >= LEAVES // 4:
                    out, stay = judge(held[0], False)
                    yield out
                    held, size = [stay], 0  # counts what comes next
        if held:
            rows = pd.concat(held, ignore_index=True)
            if len(rows):
                yield judge(rows, True)[0]

    return run


def _group(stretches: DataFrame, min_words: int, group: int, most: int) -> DataFrame:
    """Stretches with the group of each: its anchor, or for large groups a prefix that is long enough."""
    spark, size = stretches.sparkSession, F.sum(F.octet_length("words")).alias("size")
    limit = max(group, (stretches.agg(size).first()["size"] or 0) // most)

    def large(rows: DataFrame, key: str) -> DataFrame | None:
        # fewer than ``most`` rows
        found = [r["g"] for r in rows.groupBy(F.col(key).alias("g")).agg(size).where(F.col("size") > limit).collect()]
        return F.broadcast(spark.createDataFrame([(g,) for g in found], f"{key} long")) if found else None

    columns = ["group", "doc_id", "mark", "start", "words"]
    rows = stretches.withColumnRenamed("key", "group")
    if (heavy := large(rows, "group")) is None:
        return rows.select(columns)
    prefixes = [n for n in PREFIXES if n < min_words] + [min_words]

    def unroll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 5000):
                part = batch.iloc[at : at + 5000]
                paths, heads, owner, place = _suffixes(part, min_words)
                paths = [p[: h - 1] for p, h in zip(paths, heads)]
                out = {"doc_id": part["doc_id"].to_numpy()[owner], "mark": part["mark"].to_numpy()[owner], "start": part["start"].to_numpy()[owner] + place, "words": paths}
                # suffixes have min_words words each, so their hashes lie in rows
                hashes = word_hashes(b" ".join(paths)).reshape(-1, min_words)
                for n in prefixes:
                    h = np.full(len(hashes), n, np.uint64)
                    for j in range(n):
                        h = mix((h ^ hashes[:, j]) * np.uint64(_P))
                    out[f"p{n}"] = h.view(np.int64)
                yield pd.DataFrame(out)

    light, split = rows.join(heavy, "group", "left_anti"), rows.join(heavy, "group", "left_semi")
    split = cut(split.mapInPandas(unroll, "doc_id long, mark long, start int, words binary, " + ", ".join(f"p{n} long" for n in prefixes)), "split")
    out = light.select(columns)
    for n in prefixes:
        key = f"p{n}"
        heavy = large(split, key) if n < min_words else None
        done = split if heavy is None else split.join(heavy, key, "left_anti")
        out = out.unionByName(done.withColumnRenamed(key, "group").select(columns))
        if heavy is None:
            return out
        split = split.join(heavy, key, "left_semi")
    return out


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, digest: bool = False, group: int = GROUP, most: int = MOST_SPLIT) -> DataFrame:
    """Per document: doc_id, mark (a hash of its text), n_words, n_removed and kept.

    ``kept`` is the text of the words left, joined by one space; with ``digest``, its SHA-256.
    Without it, documents that lose nothing have null there: their text stands."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    named = docs.where("doc_id is not null")

    def find_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deal = _Spread()
        for batch in batches:
            for part in range(0, len(batch), 1000):
                keys, owners, places = [], [], []
                for doc, text in zip(batch["doc_id"].iloc[part : part + 1000], batch["text"].iloc[part : part + 1000]):
                    hashes = word_hashes((text or "").encode())
                    if len(hashes) >= min_words:
                        runs, chosen = anchors(hashes, min_words, ANCHOR)
                        at = np.flatnonzero(chosen)
                        keys.append(runs[at])
                        owners.append(np.full(len(at), doc, np.int64))
                        places.append(at.astype(np.int32))
                if keys:
                    owners, places = np.concatenate(owners), np.concatenate(places)
                    key, sure = deal(np.concatenate(keys), owners, places)
                    yield pd.DataFrame({"key": key, "doc_id": owners, "place": places, "sure": sure})

    def squeeze(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in range(0, len(batch), 1000):
                some = batch.iloc[part : part + 1000]
                yield pd.DataFrame({"doc_id": some["doc_id"], "mark": some["mark"], "z": [pack.compress((t or "").encode()) for t in some["text"]]})

    columns = ["doc_id", "mark", "n_words", "kept", "z", "late", "key", "start", "words"]

    def own(texts: list[_Text], rows: list[list], path: list, key: list, start: list) -> pd.DataFrame | None:
        """Notes in ``rows`` what their documents repeat of each other; stretches of the other suffixes."""
        owner = np.concatenate([np.full(len(p), k) for k, p in enumerate(path)])
        path, key, start = np.concatenate(path), np.concatenate(key), np.concatenate(start)
        if not len(path):
            return None
        ids = sorted({(r[0], r[1]) for r in rows})
        place = {x: i for i, x in enumerate(ids)}
        late = _own_leaves(texts, path, owner, start, np.array([place[r[0], r[1]] for r in rows]), min_words)
        for k, row in enumerate(rows):
            lo, hi = np.searchsorted(owner, [k, k + 1])
            row[5] = start[lo:hi][late[lo:hi]].astype("<i4").tobytes()
        o, s, a = owner[~late], start[~late], key[~late]
        edge = [0, *(np.flatnonzero((np.diff(o) != 0) | (np.diff(s) != 1) | (a[1:] != a[:-1])) + 1).tolist()]
        o, s, last, a = o[edge], s[edge], np.append(s[np.array(edge[1:], int) - 1], s[-1:]), a[edge]
        words = [texts[k].part(i, j + min_words) for k, i, j in zip(o.tolist(), s.tolist(), last.tolist())]
        found = pd.DataFrame({"doc_id": [rows[k][0] for k in o], "mark": [rows[k][1] for k in o], "n_words": 0, "kept": None, "z": None, "late": None, "key": a.view(np.int64), "start": s, "words": words})
        return found.astype({"key": "Int64", "start": "Int64"})[columns]

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Finished documents, those with suffixes in trees (and their own late leaves), and
        one leaf per node, in stretches, for the other tasks."""
        unpack = zstandard.ZstdDecompressor()
        width = min_words - ANCHOR + 1

        def table(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"key": "Int64", "start": "Int64"})

        for batch in batches:
            done, open_, texts, path, key, start, size = [], [], [], [], [], [], 0
            for ident, mark, z, places in zip(batch["doc_id"], batch["mark"], batch["z"], batch["places"]):
                raw = unpack.decompress(z)
                if places is None:
                    words = raw.split()
                    done.append((ident, mark, len(words), hashlib.sha256(b" ".join(words)).hexdigest() if digest else None, *[None] * 5))
                    continue
                hashes = word_hashes(raw)
                runs = rolling(hashes, ANCHOR, _A)
                known = np.full(len(runs), _TOP)
                places = places[places < len(runs)]  # another row of this id may be longer
                known[places] = runs[places]
                if len(runs) < width:
                    at, low = np.empty(0, np.int64), runs[:0]
                else:
                    low = _slide(runs, width, np.minimum)
                    at = np.flatnonzero(_slide(known, width, np.minimum) == low)
                texts.append(_Text(raw))
                path.append(rolling(hashes, min_words, _F)[at])
                key.append(low[at])
                start.append(at)
                open_.append([ident, mark, len(hashes), None, z, b"", None, None, None])
                size += len(raw)
                if size >= HELD:
                    if (found := own(texts, open_, path, key, start)) is not None:
                        yield found
                    yield table(open_)
                    open_, texts, path, key, start, size = [], [], [], [], [], 0
            if open_:
                if (found := own(texts, open_, path, key, start)) is not None:
                    yield found
            yield table([*done, *open_])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for ident, mark, z, late, more in zip(batch["doc_id"], batch["mark"], batch["z"], batch["late"], batch["starts"]):
                words = unpack.decompress(z).split()
                starts = np.frombuffer(late, "<i4").astype(np.int64)
                lengths = np.full(len(starts), min_words)
                if more is not None:
                    starts, lengths = np.append(starts, more >> 16), np.append(lengths, more & 0xFFFF)
                kept, removed = _kept(words, starts, lengths)
                rows.append((ident, mark, len(words), removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode() if removed else None))
            yield pd.DataFrame(rows, columns=["doc_id", "mark", "n_words", "n_removed", "kept"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [(t or "").encode().split() for t in batch["text"]]
            yield pd.DataFrame({"mark": batch["mark"], "n_words": [*map(len, words)], "kept": [hashlib.sha256(b" ".join(w)).hexdigest() if digest else None for w in words]})

    found = named.mapInPandas(find_anchors, "key long, doc_id long, place int, sure boolean")
    shared = cut(found.repartition("key").sortWithinPartitions("key").mapInPandas(_repeated, "doc_id long, place int"), "anchors")
    places = shared.groupBy("doc_id").agg(F.collect_list("place").alias("places"))  # at most a document's length
    texts = named.mapInPandas(squeeze, "doc_id long, mark long, z binary").join(places, "doc_id", "left")
    grown = cut(texts.mapInPandas(grow, "doc_id long, mark long, n_words long, kept string, z binary, late binary, key long, start int, words binary"), "suffixes")

    grouped = _group(grown.where("words is not null").select("key", "doc_id", "mark", "start", "words"), min_words, group, most)
    late = grouped.repartition("group").sortWithinPartitions("group").mapInPandas(_late_leaves(min_words), "doc_id long, mark long, start int, length int")
    starts = late.groupBy("doc_id", "mark").agg(F.collect_list(F.shiftleft(F.col("start").cast("long"), 16) + F.col("length")).alias("starts"))  # at most a document's length
    open_ = grown.where("z is not null").select("doc_id", "mark", "z", "late").join(starts, ["doc_id", "mark"], "left")
    finished = open_.mapInPandas(finish, "doc_id long, mark long, n_words long, n_removed long, kept string")
    none, zero = F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_removed")
    unnamed = docs.where("doc_id is null").select("mark", "text").mapInPandas(count, "mark long, n_words long, kept string").select(none, "mark", "n_words", zero, "kept")
    return grown.where("words is null and z is null").select("doc_id", "mark", "n_words", zero, "kept").unionByName(finished).unionByName(unnamed)


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, all of them, without their repeated words; n_chars follows the new text.
    Documents that lose nothing keep their text as it is; columns of any name go through."""
    changed = repeats(docs, min_words).where("n_removed > 0").select(F.struct("doc_id", "mark").alias("who"), "kept").dropDuplicates(["who"])
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark")).alias("who"))
    joined = whole.join(changed, "who", "left")
    fields = {c: F.col("row")[c] for c in docs.columns}
    gone = F.col("kept").isNotNull()
    fields["text"] = F.coalesce("kept", fields["text"])
    if "n_chars" in fields:
        fields["n_chars"] = F.when(gone, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(fields["n_chars"])
    return joined.select(*[v.alias(c) for c, v in fields.items()])

"""Benchmark decontamination (operator 7): CGK embedding, bit-sampling LSH, exact edit verification.

Texts and items are sequences of words. The CGK random walk (Chakraborty, Goldenberg, Koucky) copies a sequence
while it advances by a random bit of the word it stands on, and so maps edit distance to Hamming distance. Repeated samples
of positions of the walk are looked up in a table of the items' samples; every hit is verified by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tallyforge.llm.shared import arrow_filter, arrow_map, written
from tallyforge.llm.words import BASE, mix, word_hashes

#: Edits allowed for each word of an item, and the fewest words of an item that may have one; shorter items are looked up
#: whole.
EDITS, LEAST = 0.2, 5
#: Walks, samples of each walk and positions in a sample. At the limit of EDITS, a copy of a stretch is found with a
#: probability of 0.9 at least whatever the kind of edits (tests/llm measures it); an exact one always.
WALKS, SAMPLES, BITS = 5, 24, 3
#: Words of the longest stretch that is walked. Walks of longer ones fall out of step, so a longer item is walked as
#: stretches of equal length that cover it; one of them at least has no more edits a word than the item.
STRETCH = 32
#: Items whose lengths differ by less than this factor share their windows.
RATIO = 1.25
#: Characters of items that are sent to the tasks at once; a larger benchmark takes several passes.
ITEM_CHARS = 4 << 20
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words: runs of letters, digits and characters beyond ASCII."""
    return word_hashes((text or "").lower().encode("utf-8", "replace").translate(_SPACES))


def walk(seq: np.ndarray, starts: np.ndarray, steps: int, turn: int) -> np.ndarray:
    """The words that the walk from each start stands on at each step (steps x starts). seq must reach `steps` words
    beyond every start."""
    at, out = starts.copy(), np.empty((steps, len(starts)), np.uint64)
    for j in range(steps):
        out[j] = seq[at]
        at += (mix(out[j] ^ np.uint64((turn * 65537 + j + 1) * 0x9E3779B97F4A7C15 % 2**64)) & np.uint64(1)).astype(np.int64)
    return out


@dataclass
class Class:
    """Stretches of about one length, with all their samples in one sorted table."""

    low: int
    high: int
    steps: int
    picks: np.ndarray  # walks x samples x bits
    keys: np.ndarray
    stretch: np.ndarray

    def samples(self, path: np.ndarray, turn: int) -> np.ndarray:
        """Sample keys of a walk (samples x starts)."""
        out = []
        for s, pick in enumerate(self.picks[turn]):
            h = np.full(path.shape[1], turn * SAMPLES + s, np.uint64)
            for p in pick:
                h = mix(h * BASE + path[p])
            out.append(h)
        return np.array(out)


@dataclass
class Items:
    """The benchmark: names, word sequences, stretches (item, first word), their classes, a bitmap of the word pairs that
    occur, and for short items by their number of words the keys, sorted, and the items they belong to."""

    names: list
    words: list[np.ndarray]
    stretches: np.ndarray
    classes: list[Class]
    known: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def allowed(n) -> int:
    return int(n * EDITS + 1e-9)


def cuts(n: int) -> np.ndarray:
    """Ends of the stretches of an item of n words, with 0 before them."""
    parts = -(-n // STRETCH)
    return np.arange(parts + 1) * n // parts


def prepared(names: list, texts: list[str | None]) -> Items:
    """All items that have words; others, NULL ones among them, are left out."""
    rows = sorted(((len(w), i) for i, w in enumerate(map(words_of, texts)) if len(w)))
    words = [words_of(texts[i]) for _, i in rows]
    known = np.zeros(1 << min(24, max(16, 6 + sum(map(len, words)).bit_length())), bool)
    for w in words:
        known[places(w, len(known))] = True
    short = {}
    for n in range(1, LEAST):
        if mine := [i for i, w in enumerate(words) if len(w) == n]:
            keys = np.array([runs(words[i], n)[0] for i in mine], np.uint64)
            order = np.argsort(keys, kind="stable")
            short[n] = keys[order], np.array(mine)[order]
    parts = sorted((int(b - a), i, int(a)) for i, w in enumerate(words) if len(w) >= LEAST for a, b in zip(cuts(len(w)), cuts(len(w))[1:]))
    classes, at, rng = [], 0, np.random.default_rng(7)
    while at < len(parts):
        low, end = parts[at][0], at
        while end < len(parts) and parts[end][0] <= low * RATIO:
            end += 1
        steps = max(2, int(1.5 * low))
        picks = np.sort(rng.integers(0, steps, (WALKS, SAMPLES, BITS)), axis=2)
        c = Class(low, parts[end - 1][0], steps, picks, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        keys, stretch = [], []
        for k in range(at, end):
            n, i, first = parts[k]
            padded = np.concatenate([words[i][first : first + n], np.zeros(steps + 1, np.uint64)])
            for turn in range(WALKS):
                keys.append(c.samples(walk(padded, np.zeros(1, np.int64), steps, turn), turn)[:, 0])
                stretch.append(np.full(SAMPLES, k))
        keys, stretch = np.concatenate(keys), np.concatenate(stretch)
        order = np.argsort(keys, kind="stable")
        c.keys, c.stretch = keys[order], stretch[order]
        classes.append(c)
        at = end
    return Items([names[i] for _, i in rows], words, np.array([p[1:] for p in parts], np.int64).reshape(-1, 2), classes, known, short)


def runs(seq: np.ndarray, n: int) -> np.ndarray:
    """A key of the n words from each start."""
    h = np.zeros(max(0, len(seq) - n + 1), np.uint64)
    for k in range(n):
        h = mix(h * BASE + seq[k : k + len(h)])
    return h


def looked_up(seq: np.ndarray, items: Items) -> list[tuple[int, int]]:
    """Starts of short items, whole and verbatim, with the item."""
    out = []
    for n, (keys, mine) in items.short.items():
        have = runs(seq, n)
        left = np.searchsorted(keys, have)
        for start in np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == have):
            for at in range(left[start], len(keys)):
                if keys[at] != have[start]:
                    break
                if np.array_equal(seq[start : start + n], items.words[mine[at]]):
                    out.append((int(start), int(mine[at])))
    return out


def places(seq: np.ndarray, size: int) -> np.ndarray:
    """Where the pairs of neighbouring words fall in a bitmap."""
    return (mix(seq[:-1] * BASE + seq[1:]) & np.uint64(size - 1)).astype(np.int64)


def windows(inside: np.ndarray, c: Class) -> np.ndarray:
    """Starts where a stretch of the class can match. An edit breaks two word pairs at most, so the longest run of words
    that can match a stretch must hold as many pairs of the benchmark as it keeps at the limit of edits; no match is
    lost here. (With few words a stretch keeps none for certain, and then every start remains.)"""
    span, need = c.high + allowed(c.high), min(n - 1 - 2 * allowed(n) for n in range(c.low, c.high + 1))
    sums = np.concatenate([[0], np.cumsum(inside)])
    last = np.minimum(np.arange(len(inside)) + span - 1, len(inside))
    return np.flatnonzero(sums[last] - sums[:-1] >= need)


def retrieved(seq: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of start and stretch whose samples agree at least once. seq ends with a gap of zeros."""
    inside, starts, found = items.known[places(seq, len(items.known))] & (seq[:-1] != 0) & (seq[1:] != 0), [], []
    for c in items.classes:
        some = windows(inside, c)
        for at in range(0, len(some), 1 << 15):
            part = some[at : at + (1 << 15)]
            low, high = int(part[0]), int(part[-1]) + c.steps + 1
            view = seq[low:high] if high <= len(seq) else np.concatenate([seq[low:], np.zeros(high - len(seq), np.uint64)])
            for turn in range(WALKS):
                keys = c.samples(walk(view, part - low, c.steps, turn), turn)
                left = np.searchsorted(c.keys, keys.ravel())
                hits = np.flatnonzero(c.keys[np.minimum(left, len(c.keys) - 1)] == keys.ravel())
                runs = np.searchsorted(c.keys, keys.ravel()[hits], "right") - left[hits]
                rows = np.repeat(left[hits], runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                pair = np.unique(np.repeat(part[hits % len(part)], runs) * np.int64(len(items.stretches)) + c.stretch[rows])
                starts.append(pair // len(items.stretches))
                found.append(pair % len(items.stretches))
    return (np.concatenate(starts), np.concatenate(found)) if starts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def distances(seq: np.ndarray, starts: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least edit distance of the item in each row of `wanted`, all of one length, to a stretch of the words around the
    row's start (both of its ends are free) within [low, high), the row's own text."""
    n, k = wanted.shape[1], allowed(wanted.shape[1])
    columns = starts[:, None] - k + np.arange(n + 3 * k + 1)
    text = np.where((columns >= low[:, None]) & (columns < high[:, None]), seq[np.clip(columns, 0, len(seq) - 1)], np.uint64(0))
    step, row = np.arange(text.shape[1] + 1), np.zeros((len(starts), text.shape[1] + 1), np.int64)
    for i in range(n):
        new = np.minimum(row[:, 1:] + 1, row[:, :-1] + (text != wanted[:, i : i + 1]))
        new = np.concatenate([np.full((len(starts), 1), i + 1), new], axis=1)
        row = np.minimum.accumulate(new - step, axis=1) + step
    return row.min(1)


def matches(texts: list[str | None], items: Items) -> list[tuple[int, int, int]]:
    """text, item, edits for each text that holds a stretch within the item's edits; texts are searched together, with
    gaps between them that no stretch of an item can bridge. The gaps are as long as the longest stretch asks for, however long
    the items are; what is compared to a whole item is cut to the words of its own text."""
    if not items.words:
        return []
    gap = np.zeros(3 * max([c.high for c in items.classes], default=LEAST) + 2, np.uint64)
    parts = [words_of(t) for t in texts]
    sizes = np.array([len(p) + len(gap) for p in parts])
    seq = np.concatenate([x for p in parts for x in (p, gap)])
    ends = np.cumsum(sizes)
    starts, found = retrieved(seq, items)
    best: dict[tuple[int, int], int] = {(int(np.searchsorted(ends, start, "right")), i): 0 for start, i in looked_up(seq, items)}
    if not len(starts):
        return [(*key, d) for key, d in sorted(best.items())]
    text = np.searchsorted(ends - len(gap) // 2, starts, "right")  # a start shortly before a text is that text's
    first_word, last_word = ends - sizes, ends - len(gap)
    found, first = items.stretches[found].T
    starts = starts - first  # where the item starts, give or take its edits
    lengths = np.array([len(w) for w in items.words])[found]
    for n in np.unique(lengths):
        mine, k = lengths == n, allowed(n)
        place = np.unique(np.stack([text[mine], found[mine], starts[mine] // (k + 1)]), axis=1, return_index=True)[1]
        some = max(1, (1 << 19) // int(n))
        for at in range(0, len(place), some):
            rows = np.flatnonzero(mine)[place[at : at + some]]
            wanted = np.stack([items.words[i] for i in found[rows]])
            for t, i, d in zip(text[rows], found[rows], distances(seq, starts[rows], wanted, first_word[text[rows]], last_word[text[rows]])):
                if d <= k:
                    best[int(t), int(i)] = min(int(d), best.get((int(t), int(i)), k))
    return [(*key, d) for key, d in sorted(best.items())]


def _parts(benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator[tuple[Broadcast, bool]]:
    """The prepared benchmark, as broadcasts of at most about ITEM_CHARS characters each, and whether there are several.
    Of several, each is to be used up before the next is asked for: then it goes, so that one is held at a time."""
    named = benchmark.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t")).where("t is not null")
    parts = max(1, -(-int(named.agg(F.sum(F.length("t"))).first()[0] or 0) // ITEM_CHARS))
    for part in range(parts):
        rows = named.where(F.pmod(F.xxhash64("t"), F.lit(parts)) == part).orderBy("k", "t").collect()
        shipped = benchmark.sparkSession.sparkContext.broadcast(prepared([r["k"] for r in rows], [r["t"] for r in rows]))
        yield shipped, parts > 1
        if parts > 1:
            shipped.destroy()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The id, item_id, edits (words), n_words (of the item) for each document and benchmark item where a stretch of the
    document is within EDITS edits a word of the item. Documents without a match have no row.

    Words are lower-cased and punctuation is ignored. NULL and empty texts match nothing, nor do items without words; an
    item of fewer than LEAST words must be there verbatim; an empty benchmark gives no rows. Repeated documents and items
    each have their rows; other columns are ignored. The benchmark goes to the tasks in parts of at most about
    ITEM_CHARS characters; of several parts each is a pass whose rows are written before the next.
    """
    doc_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_arrow, out = to_arrow_type(benchmark.schema[item_col].dataType), None
    for shipped, several in _parts(benchmark, item_col, item_text_col):

        def batch(got: pa.RecordBatch, shipped=shipped) -> pa.RecordBatch | None:
            items = shipped.value
            if not (found := matches(got.column(1).to_pylist(), items)):
                return None
            return pa.RecordBatch.from_arrays(
                [got.column(0).take(pa.array([t for t, _, _ in found])), pa.array([items.names[i] for _, i, _ in found], item_arrow), pa.array([d for *_, d in found], pa.int32()), pa.array([len(items.words[i]) for _, i, _ in found], pa.int32())],
                names=[id_col, "item_id", "edits", "n_words"],
            )

        part = arrow_map(docs.select(id_col, text_col), batch, f"`{id_col}` {doc_type}, item_id {item_type}, edits int, n_words int", rows=512)
        part = written(part, "matches") if several else part
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item (as in `contaminated`). No shuffle. Of several parts of
    a large benchmark each is a pass, whose rows are written before the next."""
    for shipped, several in _parts(benchmark, item_col, item_text_col):

        def keep(texts: list[str | None], shipped=shipped) -> list[bool]:
            hit = {t for t, _, _ in matches(texts, shipped.value)}
            return [i not in hit for i in range(len(texts))]

        docs = arrow_filter(docs, text_col, keep)
        docs = written(docs, "clean") if several else docs
    return docs

"""Spelling variant grouping (operator 11) by search schemes over a bidirectional FM-index.

Two words are near if one inserted, deleted or replaced character makes one of the other. The error then lies in one half
of the word, and the other half stands unchanged at its end of the near word. So there are two searches: match the left half
exactly and extend to the right allowing one error, or match the right half exactly and extend to the left. Both run on
a delimited vocabulary, `$word$word$`, indexed in both directions, and end at a delimiter; what they hold of a
pattern is an interval of suffix ranks. With two pieces neither search turns around, so the two directions need no
common interval.

The vocabulary is spread over tasks: words that a half can lead to lie in one cell, named by the half; cells are dealt to shards,
and each shard has an index of its own. A cell that is too large for one task is cut into blocks of words and chunks of
queries, each chunk against each block.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import written

#: The characters of a word (after A-Z are lower-cased, those of `a-z` and of this range).
RUN = re.compile("[a-zÀ-ÿ]+")
#: Characters that are split at once; distinct words that a task counts before it hands them on.
AT_ONCE, HELD = 1 << 20, 200_000
#: Words of a cell's block, queries of its chunk, words of a shard on average, queries that are searched at once.
BLOCK, CHUNK, SHARD, BATCH = 1 << 16, 1 << 18, 1 << 16, 4096


def runs_of(text: str) -> Counter:
    """The words of a text with their numbers; a text is cut between words only."""
    found, at = Counter(), 0
    while at < len(text):
        end = at + AT_ONCE
        while end < len(text) and RUN.match(text[end].lower()):
            end += 1
        part = text[at:end]
        found.update(RUN.findall(part.encode("utf-8", "replace").lower().decode()))  # bytes lower A-Z alone
        at = end
    return found


def word_counts(docs: DataFrame, id_col: str, text_col: str, least_length: int, least_count: int, thin: int | None) -> DataFrame:
    """word, n of the words of all texts; see variants()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                mark = zlib.crc32(f"{batch.column(0)[i].as_py() or ''}:".encode())
                for word, n in runs_of(batch.column(1)[i].as_py() or "").items():
                    if thin and (h := zlib.crc32(word.encode(), mark)) % thin == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= least_length:
                        held[word] = held.get(word, 0) + n
                if len(held) > HELD:
                    yield rows()
                    held.clear()
        yield rows()

    words = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def rotation_order(text: np.ndarray) -> np.ndarray:
    """The rotations of a text in order, by doubling; no two may be equal. Symbols are below 128."""
    n, rank, reach = len(text), np.zeros(len(text), np.int64), 8
    for k in range(reach):
        rank = (rank << 7) | np.roll(text, -k)
    while True:
        order = np.argsort(rank, kind="stable")
        new = np.cumsum(np.concatenate([[0], rank[order[1:]] != rank[order[:-1]]]))
        rank = np.empty(n, np.int64)
        rank[order] = new
        if new[-1] == n - 1:
            return order
        rank = rank * n + np.roll(rank, -(reach % n))
        reach *= 2


class Direction:
    """An FM-index of `$word$word$`: intervals [low, high) of rotations that begin with a pattern, which grows at its front."""

    def __init__(self, text: np.ndarray):
        self.n, self.symbols = len(text), int(text.max()) + 1
        self.last = text[rotation_order(text) - 1]
        # In order of symbol and row: the place of (c, i) is the number of rotations before those that begin with c, plus
        # the rows before i that end with c.
        self.places = np.sort(self.last * self.n + np.arange(self.n))

    def grown(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        base = symbol * self.n
        return np.searchsorted(self.places, base + low), np.searchsorted(self.places, base + high)

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
        """Parent, symbol, low, high of all symbols that an interval can grow by: read off narrow intervals, tried for wide ones."""
        wide = np.flatnonzero(high - low > self.symbols)
        narrow = np.flatnonzero(high - low <= self.symbols)
        width = (high - low)[narrow]
        rows = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low[narrow], width)
        some = np.unique(np.repeat(narrow, width) * self.symbols + self.last[rows])
        every = np.repeat(wide, self.symbols) * self.symbols + np.tile(np.arange(self.symbols), len(wide))
        parent, symbol = np.divmod(np.concatenate([some, every]), self.symbols)
        lo, hi = self.grown(low[parent], high[parent], symbol)
        on = hi > lo
        return parent[on], symbol[on], lo[on], hi[on]


def search(index: Direction, flat: np.ndarray, start: np.ndarray, size: np.ndarray, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pattern and rank of each word with exactly one error, none of it in the pattern's first `exact` symbols. Patterns are
    runs of flat, in the order in which they are matched; symbols below 0 occur in no word."""
    found_q, found_rank = [], []
    low, high = index.grown(np.zeros(1, np.int64), np.full(1, index.n), np.zeros(1, np.int64))
    q0 = np.arange(len(start))
    l0, h0 = np.repeat(low, len(q0)), np.repeat(high, len(q0))
    q1 = l1 = h1 = np.zeros(0, np.int64)
    for j in range(int(size.max(initial=0)) + 1):
        if not len(q0) and not len(q1):
            break
        # Symbols at j: 0, the delimiter, at a pattern's end.
        at = lambda q: np.where(j < size[q], flat[np.minimum(start[q] + j, len(flat) - 1)], 0)
        may = np.flatnonzero(exact[q0] <= j)
        parent, symbol, lo, hi = index.children(l0[may], h0[may])
        of, other = q0[may[parent]], symbol != 0
        other &= symbol != at(of)
        of, lo, hi = of[other], lo[other], hi[other]
        q1, l1, h1 = np.concatenate([q1, of]), np.concatenate([l1, lo]), np.concatenate([h1, hi])  # inserted before j
        known = at(q1) >= 0
        q1, l1, h1 = q1[known], l1[known], h1[known]
        l1, h1 = index.grown(l1, h1, at(q1))
        on, end = h1 > l1, size[q1] == j
        found_q.append(q1[on & end])
        found_rank.append(l1[on & end])
        go = on & ~end
        swap = j < size[of]  # replaced
        now, before = at(q0[may]), flat[np.maximum(start[q0[may]] + j - 1, 0)]
        skip = may[(j < size[q0[may]]) & ((exact[q0[may]] == j) | (now != before))]  # left out; of a repeated symbol, the first
        q1 = np.concatenate([q1[go], of[swap], q0[skip]])
        l1, h1 = np.concatenate([l1[go], lo[swap], l0[skip]]), np.concatenate([h1[go], hi[swap], h0[skip]])
        here = at(q0)
        on = (j < size[q0]) & (here >= 0)
        q0, l0, h0 = q0[on], l0[on], h0[on]
        l0, h0 = index.grown(l0, h0, here[on])
        on = h0 > l0
        q0, l0, h0 = q0[on], l0[on], h0[on]
    return np.concatenate(found_q), np.concatenate(found_rank)


class Vocabulary:
    """Distinct words, delimited and indexed in both directions."""

    def __init__(self, words: list[str]):
        self.letters = np.unique(np.frombuffer("".join(words).encode("utf-32-le"), np.uint32))
        if len(self.letters) > 126:
            raise ValueError("more than 126 different characters in the words")
        self.words = {+1: sorted(w[::-1] for w in words), -1: sorted(words)}
        self.index = {way: Direction(np.concatenate([self.codes("".join("\0" + w for w in some)), [0]])) for way, some in self.words.items()}

    def codes(self, text: str) -> np.ndarray:
        """Symbols from 1 on, 0 for the delimiter, -1 for a character that no word has."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at + 1, np.where(points == 0, 0, -1)).astype(np.int64)

    def near(self, queries: list[str], way: int) -> Iterator[tuple[str, str]]:
        """Query and near word. way +1: the left half is exact and the search goes right; -1: the right one, to the left."""
        for k in range(0, len(queries), BATCH):
            some = queries[k : k + BATCH]
            size = np.array([len(w) for w in some])
            flat = self.codes("".join(w[::way] for w in some))
            exact = size // 2 if way > 0 else size - size // 2
            hits, ranks = search(self.index[way], flat, np.cumsum(size) - size, size, exact)
            for q, r in zip(hits.tolist(), ranks.tolist()):
                yield some[q], self.words[way][r - 1][::-way]  # rank 0 is the text's end


def _cells(words: DataFrame, lengths: list[int]) -> DataFrame:
    """words once for each side and half that a query of their length plus one of `lengths` would match exactly."""
    size = F.char_length("word")
    halves = lambda up: F.array_distinct(F.array(*[F.floor((size + d + up) / 2).cast("int") for d in lengths]))
    left = words.select("*", F.lit(1).alias("way"), F.explode(halves(0)).alias("half"))
    right = words.select("*", F.lit(-1).alias("way"), F.explode(halves(1)).alias("half"))
    cut = F.when(F.col("way") > 0, F.substring("word", F.lit(1), F.col("half"))).otherwise(F.substring("word", size - F.col("half") + 1, F.col("half")))
    return left.union(right).withColumn("cell", cut).drop("half")


def near_words(words: DataFrame, block: int = BLOCK, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """word, near, near_n: all pairs of near words of words (word, n), each in both directions. A written table of distinct
    words without NULLs. Repeated characters, words of any length and any characters are allowed, up to 126 different ones in a shard.
    """
    targets, queries = _cells(words, [-1, 0, 1]), _cells(words.select("word"), [0])
    parts = lambda rows, each, name: rows.groupBy("way", "cell").agg(F.ceil(F.count("*") / each).cast("int").alias(name))
    large = parts(targets, block, "blocks").join(parts(queries, chunk, "chunks"), ["way", "cell"], "left").where("blocks > 1 or chunks > 1")
    large = written(large.select("way", "cell", "blocks", F.coalesce("chunks", F.lit(1)).alias("chunks")), "large-cells")
    shards = max(1, -(-4 * words.count() // shard))

    def dealt(rows: DataFrame, mine: str, other: str) -> DataFrame:
        rows = rows.join(large, ["way", "cell"], "left")
        one: Column = F.pmod(F.xxhash64("word"), F.coalesce(mine, F.lit(1))).cast("int")
        rows = rows.select("way", "cell", "word", *[c for c in rows.columns if c == "n"], one.alias(mine), F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other))
        return rows.withColumn("shard", F.pmod(F.xxhash64("way", "cell", "blocks", "chunks"), F.lit(shards)))

    sought = dealt(targets, "blocks", "chunks").select("shard", F.lit(0).alias("way"), "word", "n")
    asked = dealt(queries, "chunks", "blocks").select("shard", "way", "word", F.lit(None).cast("long").alias("n"))

    def pairs(rows):
        import pandas as pd

        out: list[tuple[str, str, int]] = []
        here = rows[rows["way"] == 0].drop_duplicates("word")
        if len(here):
            n = dict(zip(here["word"], here["n"].astype("int64")))
            held = Vocabulary(list(n))
            for way in (1, -1):
                mine = rows.loc[rows["way"] == way, "word"].drop_duplicates().tolist()
                out.extend((w, x, n[x]) for w, x in held.near(mine, way))
        return pd.DataFrame(out, columns=["word", "near", "near_n"])

    found = sought.unionByName(asked).groupBy("shard").applyInPandas(pairs, "word string, near string, near_n long")
    return found.distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): forms are followed to the last; each round doubles the steps. Forms must not lead in
    circles."""
    now, changed = written(forms.select("word", F.col("form").alias("root")), "roots"), True
    while changed:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = written(now.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now, changed = both.select("word", "root"), not both.where("moved").isEmpty()
    return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 6, least_count: int = 5, times: int = 5, thin: int | None = None) -> DataFrame:
    """One row per word: word, form, root (strings), n, n_near, form_n (longs).

    Words are maximal runs of a-z and U+00C0 to U+00FF after A-Z are lower-cased, of at least least_length code points,
    that occur n >= least_count times in all texts. n_near is the number of words that are one inserted, deleted or
    replaced code point away. The form is the near word of largest n, of equal ones the first in code-point order, if that n is
    at least `times` (2 or more) times the word's; else it is NULL, as is form_n. The root follows forms to the last; a word without a form is its own.
    thin plants typing errors: of a run whose crc32 of `<id>:<run>` it divides, one character is left out.

    A NULL text has no words; a NULL id counts as the empty text; repeated rows count each; other columns are ignored. No
    words: no rows.
    """
    words = written(word_counts(docs, id_col, text_col, least_length, least_count, thin), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = words.join(near, "word", "left")
    form_n = F.when(-F.col("best.less") >= times * F.col("n"), -F.col("best.less"))
    rows = written(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form_n.alias("form_n"), F.when(form_n.isNotNull(), F.col("best.near")).alias("form")), "forms")
    last = roots(rows.where("form is not null").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

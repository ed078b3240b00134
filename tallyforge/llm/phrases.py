"""Phrase collocation mining (operator 13) by vertical partitioning of a depth-truncated suffix tree.

The suffixes of all texts, cut off after three words, form a tree; a phrase's count is the total of the leaves below its
node. The tree is cut into subtrees by word prefixes: a first pass counts single words; a word that begins more suffixes
than one task's budget is extended by a second word; a pair that still does is extended to three words, which is a leaf.
Prefixes are then grouped so that a group's suffixes fit the budget: frequent ones are told apart by their own bounded table,
all are dealt by hash into as many groups as the budget asks for. A task hands on its leaves with totals, those of a group as
one compressed value. Each group's subtree is built on its own, from sorted leaves, and its counts are final but for the few
pairs that are spread over groups.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import written
from tallyforge.llm.words import BASE, mix

#: Bytes that end a piece, and those between words (A-Z become a-z on the way).
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
TO_PIECES = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")
#: Suffixes of a group; prefixes of a length that are extended, at most (they are shipped to all tasks, some 50 MB; a corpus of more than
#: EXTENDED x BUDGET / 2 words has larger groups); bytes of text split at once;
#: suffixes that a task holds before it hands their leaves on, and how many different words.
BUDGET, EXTENDED, AT_ONCE, HELD, WORDS = 1_000_000, 1 << 20, 1 << 20, 2_000_000, 1 << 20
#: Salts of the last ranking.
SALTS = 16


class Leaves:
    """Words of texts as numbers, and the leaves (runs of up to three words) of their suffixes with totals."""

    def __init__(self) -> None:
        self.word: dict[bytes, int] = {b"": 0}  # 0: a piece's end
        self.stream: list[int] = []

    def add(self, text: str) -> None:
        raw = text.encode("utf-8", "replace").lower().translate(TO_PIECES)
        at, number, put = 0, self.word, self.stream
        while at < len(raw):
            end = at + AT_ONCE
            while end < len(raw) and raw[end] not in b" \n":
                end += 1
            for piece in raw[at:end].split(b"\n"):
                put.extend([number.setdefault(w, len(number)) for w in piece.split()])
                put.append(0)
            if end < len(raw) and raw[end] == 32:
                put.pop()  # the piece goes on
            at = end
        put.append(0)

    def full(self) -> bool:
        return len(self.stream) > HELD or len(self.word) > WORDS

    def words(self) -> pa.Array:
        return pa.array([w.decode() for w in self.word], pa.string())

    def numbers(self) -> np.ndarray:
        return np.concatenate([np.array(self.stream, np.int64), np.zeros(2, np.int64)])

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of three word numbers (0 where a piece ends) and their totals."""
        x = self.numbers()
        first, second, third = x[:-2], x[1:-1], x[2:]
        some = first > 0
        first, second, third = first[some], second[some], np.where(second > 0, third, 0)[some]
        pair, at = np.unique((first << 32) | second, return_inverse=True)
        key, total = np.unique((at.astype(np.int64) << 32) | third, return_counts=True)
        pair = pair[key >> 32]
        return np.stack([pair >> 32, pair & 0xFFFFFFFF, key & 0xFFFFFFFF]), total


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Leaves]]:
    """The leaves of the texts of each language that a task meets, handed on whenever they are many, texts whole."""
    held: dict[str, Leaves] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            mine = held.setdefault(lang, Leaves())
            mine.add(text.as_py() or "")
            if mine.full():
                yield lang, held.pop(lang)
            if sum(len(x.word) + len(x.stream) for x in held.values()) > HELD:
                yield from held.items()
                held.clear()
    yield from held.items()


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))


def word_totals(texts: DataFrame) -> DataFrame:
    """lang, word, f: the first level of the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _streams(batches):
            total = np.bincount(held.numbers(), minlength=len(held.word))[1:]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total), pa.string()), held.words()[1:], pa.array(total)], names=["lang", "word", "f"])

    return texts.mapInArrow(run, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _chosen(frequent: set[tuple], lang: str, held: Leaves, leaves: np.ndarray) -> np.ndarray:
    """For each leaf how many words its prefix has: one, or one more for each of its prefixes that is frequent."""
    number = held.word
    words = np.zeros(len(number), bool)
    pairs: list[int] = []
    for key in frequent:
        at = [number.get(w.encode(), -1) for w in key[1:]]
        if key[0] == lang and min(at) > 0:
            if len(at) == 1:
                words[at[0]] = True
            else:
                pairs.append((at[0] << 32) | at[1])
    long = np.isin((leaves[0] << 32) | leaves[1], np.array(pairs, np.int64)) if pairs else np.zeros(leaves.shape[1], bool)
    return 1 + words[leaves[0]].astype(np.int64) + long


def frequent_prefixes(texts: DataFrame, words: DataFrame, suffixes: int, budget: int) -> set[tuple]:
    """(lang, word) of more than `budget` suffixes, and (lang, word, word) of all pairs that begin more than that, perhaps some of more than half.

    In a stretch of m of all N suffixes, pairs of fewer than m * budget / 2N are not counted; over all stretches that hides
    less than half the budget of a pair, so no frequent one is lost, and little is shuffled.
    """
    single = {(r["lang"], r["word"]) for r in words.where(F.col("f") > budget).select("lang", "word").collect()}
    if not single:
        return set()
    shared = texts.sparkSession.sparkContext.broadcast(single)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _streams(batches):
            names = held.words()
            hot = np.array([lang == key[0] and held.word.get(key[1].encode(), 0) for key in shared.value], np.int64)
            x = held.numbers()
            first, second = x[:-1], x[1:]
            some = np.isin(first, hot[hot > 0]) & (second > 0)
            key, n = np.unique((first[some] << 32) | second[some], return_counts=True)
            keep = 2 * n * suffixes >= len(x) * budget
            ends = [names.take(pa.array(k)) for k in (key[keep] >> 32, key[keep] & 0xFFFFFFFF)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * int(keep.sum()), pa.string()), *ends, pa.array(n[keep])], names=["lang", "w1", "w2", "n"])

    pairs = texts.mapInArrow(run, "lang string, w1 string, w2 string, n long").groupBy("lang", "w1", "w2").agg(F.sum("n").alias("n"))
    return single | {(r["lang"], r["w1"], r["w2"]) for r in pairs.where(2 * F.col("n") > budget).select("lang", "w1", "w2").collect()}


def _packed(names: list[bytes], leaves: np.ndarray, total: np.ndarray) -> bytes:
    """Leaves as one compressed value: their words, then columns of places among these and of totals."""
    used, at = np.unique(leaves, return_inverse=True)
    text = b"\n".join(names[i] for i in used)
    head = np.array([len(total), len(used), len(text)], "<i8").tobytes()
    return zlib.compress(head + text + at.reshape(leaves.shape).astype("<u4").tobytes() + total.astype("<i8").tobytes(), 1)


def _unpacked(value: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    raw = zlib.decompress(value)
    n, used, size = np.frombuffer(raw, "<i8", 3)
    at = 24 + int(size)
    leaves = np.frombuffer(raw, "<u4", 3 * n, at).reshape(3, n).astype(np.int64)
    return raw[24:at].decode().split("\n"), leaves, np.frombuffer(raw, "<i8", n, at + 12 * n)


def leaf_rows(texts: DataFrame, frequent: set[tuple], groups: int) -> DataFrame:
    """part, lang, leaves: what a task hands on of a stretch of texts for the prefixes of a group, as one value."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, held in _streams(batches):
            names = list(held.word)
            leaves, total = held.leaves()
            prefix = _chosen(shared.value, lang, held, leaves)
            of_word = np.array([zlib.crc32(w, zlib.crc32(lang.encode())) for w in names], np.uint64)
            hashed = mix(of_word[leaves[0]])
            for k in (1, 2):
                hashed = np.where(prefix > k, mix(hashed * BASE + of_word[leaves[k]]), hashed)
            part = (hashed % np.uint64(groups)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1, append=groups))
            rows = [(int(part[some[0]]), _packed(names, leaves[:, some], total[some])) for some in np.split(order, cuts[1:-1])] if len(order) else []
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([lang] * len(rows), pa.string()), pa.array([v for _, v in rows], pa.binary())], names=["part", "lang", "leaves"])

    return texts.mapInArrow(run, "part int, lang string, leaves binary")


def subtree(rows: pa.Table, least: int, spread: set[tuple]) -> pa.Table:
    """The nodes of depth two and three with totals of at least `least`, from a group's leaves: they are sorted, a node is a run of leaves
    that share its words, and its total is theirs. Of the pairs in `spread`, whose leaves lie in several groups, any total."""
    number, parts = {"": 0}, []
    langs = {lang: i for i, lang in enumerate(sorted(set(rows.column("lang").to_pylist())))}
    for lang, value in zip(rows.column("lang").to_pylist(), rows.column("leaves")):
        names, leaves, total = _unpacked(value.as_py())
        ids = np.array([number.setdefault(w, len(number)) for w in names], np.int64)
        parts.append(np.concatenate([np.full((1, len(total)), langs[lang]), ids[leaves], total[None]]))
    x = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
    x = x[:, np.lexsort(x[3::-1])]
    words, names, out = pa.array(list(number), pa.string()), pa.array(list(langs), pa.string()), []
    pair = lambda lang, one, two: (lang * len(number) + one) * len(number) + two
    wide = np.array([pair(langs[k[0]], number[k[1]], number[k[2]]) for k in spread if k[0] in langs and k[1] in number and k[2] in number], np.int64)
    change = np.zeros(x.shape[1], bool)
    change[:1] = True
    for depth in range(4):
        change[1:] |= x[depth, 1:] != x[depth, :-1]
        if depth >= 2 and x.shape[1]:
            at = np.flatnonzero(change)
            total = np.add.reduceat(x[4], at)
            keep = total >= least
            if depth == 2 and len(wide):
                keep |= np.isin(pair(x[0, at], x[1, at], x[2, at]), wide)
            keep &= x[depth, at] > 0
            at, total = at[keep], total[keep]
            last = words.take(pa.array(x[3, at])) if depth == 3 else pa.nulls(len(at), pa.string())
            out.append(pa.table([names.take(pa.array(x[0, at])), words.take(pa.array(x[1, at])), words.take(pa.array(x[2, at])), last, pa.array(total)], names=["lang", "w1", "w2", "w3", "f"]))
    return pa.concat_tables(out) if out else pa.table({"lang": names, "w1": names, "w2": names, "w3": names, "f": pa.array([], pa.int64())})


def phrase_totals(texts: DataFrame, words: DataFrame, least: int, budget: int = BUDGET) -> DataFrame:
    """lang, w1, w2, w3 (NULL for a pair), f of all phrases of two and three words with f >= least."""
    suffixes = words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, -(-2 * suffixes // EXTENDED))  # so fewer than EXTENDED prefixes of each length exceed half of it
    frequent = frequent_prefixes(texts, words, suffixes, budget)
    spread = {key for key in frequent if len(key) == 3}
    kind = "lang string, w1 string, w2 string, w3 string, f long"
    parts = leaf_rows(texts, frequent, max(1, -(-suffixes // budget))).groupBy("part").applyInArrow(lambda t: subtree(t, least, spread), kind)
    if not spread:
        return parts
    # A spread pair's totals come from several groups; all other nodes are whole already.
    return parts.groupBy("lang", "w1", "w2", "w3").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _score(left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (l * r)), exact: both products stay below 10**38 for counts below 10**15."""
    big = lambda c: c.cast("decimal(15,0)")
    above = (big(F.col("a")) * big(F.col("a"))).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above, big(left) * big(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of two or three words by score, then a, both
    descending, then phrase in byte order.

    Texts have A-Z lower-cased, are cut into pieces at ENDS and those into words at BLANKS. a is the number of a phrase's
    occurrences within pieces, n that of all words of the language. Of the cuts of a phrase into two parts with l and r
    occurrences the one with the lowest score counts, of equal ones the first. A pair in a triple that has at least half its
    occurrences is left out. A NULL language counts as `und`, a NULL text as the empty one; repeated rows count each; other columns are
    ignored. No phrases: no rows.
    """
    texts = _texts(docs, text_col, lang_col)
    words = written(word_totals(texts), "words")
    sums = words.groupBy("lang").agg(F.sum("f").alias("n"))
    phrases = written(phrase_totals(texts, words, least, budget), "phrases")
    word = lambda c, name: words.where(F.col("f") >= least).select("lang", F.col("word").alias(c), F.col("f").alias(name))
    pairs = phrases.where("w3 is null").select("lang", "w1", "w2", F.col("f").alias("a"))
    triples = phrases.where("w3 is not null").withColumnRenamed("f", "a")
    inside = [triples.select("lang", F.col(x).alias("w1"), F.col(y).alias("w2"), "a") for x, y in (("w1", "w2"), ("w2", "w3"))]
    covered = inside[0].union(inside[1]).groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    lone = pairs.join(covered, ["lang", "w1", "w2"], "left").where("longer is null or 100 * longer < 50 * a").drop("longer")
    two = lone.join(word("w1", "l"), ["lang", "w1"]).join(word("w2", "r"), ["lang", "w2"])
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", _score(F.col("l"), F.col("r")).alias("score"))
    pair = lambda x, y, name: pairs.select("lang", F.col("w1").alias(x), F.col("w2").alias(y), F.col("a").alias(name))
    three = triples.join(word("w1", "l1"), ["lang", "w1"]).join(word("w3", "r2"), ["lang", "w3"])
    three = three.join(pair("w2", "w3", "r1"), ["lang", "w2", "w3"]).join(pair("w1", "w2", "l2"), ["lang", "w1", "w2"])
    cuts = F.least(*[F.struct(_score(F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)])
    three = three.withColumn("cut", cuts).select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
    found = two.unionByName(three)
    order = [F.desc("score"), F.desc("a"), "phrase"]
    # First within salts, so that no task sorts all phrases of a language.
    some = found.withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    best = some.select("lang", rank.alias("rank"), "phrase", "a", "l", "r", "score").where(F.col("rank") <= top)
    return best.join(sums, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

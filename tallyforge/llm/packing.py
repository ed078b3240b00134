"""Best-fit packing (operator 12): token sequences of a fixed length, filled by bulk-synchronous best fit.

Documents of one length are alike to best fit, and so are gaps of one size. What is sorted, matched and updated are
therefore runs, of document pieces and of gaps; their number depends on the sequence length and the rounds, not on the rows.
A round sorts the runs of pieces and gaps by size into ranges; a task sweeps its range from large to small and gives each
piece the smallest gap above it that is still free in this round (its successor). Pieces that compete for a gap
get it by rank; what a range cannot match is matched across the ranges in the same order. Then the gaps are updated,
and the next round begins. Pieces that no gap can ever hold open new sequences.
Rows are touched twice and never shuffled by length: where they are cut and counted, and where each looks its rank up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.shared import arrow_map, written
from tallyforge.llm.tokens import AT_ONCE, PIECES, PLAIN, REMEMBERED, _tokenizer, proven_whole_tokens

#: Ranges of a round; of the new sequences that the pieces without a gap fill at least, the share that is opened at once, and the
#: share of all sequences below which all are.
RANGES, OPENED, TAIL = 4, 0.7, 0.01
RUN = "kind int, size long, first long, count long"
GAP, PIECE = 0, 1


class PieceIds:
    """Ids of texts. A pre-token's ids are merged once and kept in a pool, proven whole tokens from the start."""

    def __init__(self, path: str, whole: list[tuple[str, str]]):
        from tokenizers import pre_tokenizers

        self.tok, self.whole = _tokenizer(path), whole
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.reset()

    def reset(self) -> None:
        self.by_raw, self.by_text = _Places(self._merged), _Places(self._merged_text)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.known = 0
        for raw, text in self.whole:
            self.by_raw[raw] = at = self._kept([self.tok.model.token_to_id(raw + "</w>")])
            if text:
                self.by_text[text] = at

    def _kept(self, ids: list[int]) -> int:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if self.known == len(self.starts):
            self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
        self.pool[self.used : self.used + len(ids)] = ids
        self.starts[self.known], self.sizes[self.known] = self.used, len(ids)
        self.used, self.known = self.used + len(ids), self.known + 1
        return self.known - 1

    def _merged(self, raw: str) -> int:
        return self._kept([t.id for t in self.tok.model.tokenize(raw)])

    def _merged_text(self, text: str) -> int:
        return self._kept([t.id for raw, _ in self.bytes_of.pre_tokenize_str(text) for t in self.tok.model.tokenize(raw)])

    def part(self, text: str) -> np.ndarray:
        """Of a text without special strings."""
        if PLAIN.fullmatch(text):
            names, places = PIECES.findall(text.lower()), self.by_text
        else:
            names, places = [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))], self.by_raw
        at = np.fromiter(map(places.__getitem__, names), np.int64, len(names))
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[at] - ends + sizes, sizes)]

    def ids(self, text: str) -> np.ndarray:
        """As the library gives them. A text with special strings goes to the library whole; others are cut at white space, which no
        pre-token holds."""
        if any(s in text for s in self.specials):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
        if self.known > len(self.whole) + REMEMBERED:
            self.reset()
        out, at = [], 0
        while at < len(text):
            end = at + AT_ONCE
            while end < len(text) and text[end] not in " \n\t":
                end += 1
            out.append(self.part(text[at:end]))
            at = end
        return out[0] if len(out) == 1 else np.concatenate([np.zeros(0, np.uint32), *out])


class _Places(dict):
    def __init__(self, merge):
        super().__init__()
        self.merge = merge

    def __missing__(self, piece: str) -> int:
        at = self[piece] = self.merge(piece)
        return at


@lru_cache(maxsize=1)
def _ids(path: str, whole: tuple[tuple[str, str], ...]) -> PieceIds:
    return PieceIds(path, list(whole))


def cut_pieces(docs: DataFrame, tokenizer_path: str, limit: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """The id, piece, start, length, ids_crc32 of every piece; with the task that cut it and its place among that task's pieces
    of its length."""
    whole = docs.sparkSession.sparkContext.broadcast(tuple(proven_whole_tokens(tokenizer_path)))
    names = [id_col, "piece", "start", "length", "ids_crc32", "cut_task", "cut_nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, task, nth = _ids(tokenizer_path, whole.value), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(ids_of.ids(text or ""), np.uint32(end_id)).astype("<u4")
                for p, at in enumerate(range(0, len(ids), limit)):
                    part = ids[at : at + limit]
                    rows.append((i, p, at, len(part), zlib.crc32(part.tobytes()), nth[len(part)]))
                    nth[len(part)] += 1
            if rows:
                row, piece, start, length, crc, place = (np.array(c, np.int64) for c in zip(*rows))
                cols = [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), *map(pa.array, (start, length, crc)), pa.array(np.full(len(row), task, np.int32)), pa.array(place)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, cut_task int, cut_nth long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def swept(runs: Iterable[tuple]) -> tuple[list[tuple], list[tuple]]:
    """One sweep over runs (kind, size, first, count), gaps before pieces of their size, from large to small: placements (size,
    first, count, sequence, each, gap), and the runs of pieces and gaps that are left.

    A gap is used once; it takes as many pieces of one length as it holds, as best fit would put them there one after the other.
    Of a run of pieces the first ranks get the smallest gap.
    """
    placed, left, free = [], [], []
    for kind, size, first, count in runs:
        if kind == GAP:
            free.append((size, first, count))
            continue
        while count and free:
            gap, sequence, n = free.pop()
            each = gap // size
            used = min(n, -(-count // each))
            here = min(count, used * each)
            placed.append((size, first, here, sequence, each, gap))
            if n > used:
                free.append((gap, sequence + used, n - used))
            first, count = first + here, count - here
        if count:
            left.append((PIECE, size, first, count))
    return placed, left + [(GAP, *g) for g in free]


def updated(placed: list[tuple]) -> list[tuple]:
    """The gaps that placements leave."""
    out = []
    for size, _, count, sequence, each, gap in placed:
        full, rest = divmod(count, each)
        out += [(GAP, gap - each * size, sequence, full), (GAP, gap - rest * size, sequence + full, int(rest > 0))]
    return [g for g in out if g[1] and g[3]]


def in_order(runs: Iterable[tuple]) -> list[tuple]:
    return sorted(runs, key=lambda r: (-r[1], r[0], r[2]))


def plan_of(spark: SparkSession, lengths: dict[int, int], limit: int) -> list[tuple]:
    """Placements (size, first, count, sequence, each, gap) of all pieces; lengths gives their number by length."""
    pieces, gaps, plan, sequences = [(PIECE, size, 0, n) for size, n in lengths.items()], [], [], 0

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
        placed, left = swept(rows)
        out = [(*p, True) for p in placed] + [(size, first, count, kind, 0, 0, False) for kind, size, first, count in left]
        names = ["size", "first", "count", "sequence", "each", "gap", "is_placed"]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.bool_() if n == "is_placed" else pa.int64()) for n, c in zip(names, zip(*out) if out else [[]] * 7)], names=names)

    while pieces:
        widest = max((g[1] for g in gaps), default=0)
        stuck = [(size, n) for _, size, _, n in pieces if size > widest]
        alone = sum(n for size, n in stuck if 2 * size > limit)
        new = alone or -(-sum(size * n for size, n in stuck) // limit)
        if not alone and new > max(1, sequences * TAIL):
            new = int(new * OPENED) + 1
        if new:
            gaps, sequences = [*gaps, (GAP, limit, sequences, new)], sequences + new
        ranges = spark.createDataFrame([*pieces, *gaps], RUN).repartitionByRange(RANGES, F.desc("size"), "kind", "first").sortWithinPartitions(F.desc("size"), "kind", "first")
        rows = ranges.mapInArrow(sweep, "size long, first long, count long, sequence long, each long, gap long, is_placed boolean").collect()
        placed = [tuple(r)[:6] for r in rows if r["is_placed"]]
        across, left = swept(in_order((r["sequence"], *tuple(r)[:3]) for r in rows if not r["is_placed"]))
        placed += across
        plan += placed
        pieces = [r for r in left if r[0] == PIECE]
        gaps = [r for r in left if r[0] == GAP] + updated(placed)
    return plan


def packed(docs: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: the id, piece (from 0), start (its document's ids before it), length, ids_crc32 (of the ids as unsigned
    little-endian 32-bit numbers), sequence_id, offset.

    A document is the ids of its text and end_id; one longer than limit is cut into pieces of limit, of which the last may be
    shorter. Each sequence holds at most limit ids, gapless from offset 0; sequence numbers may have gaps. A NULL text
    counts as the empty one (a document of end_id alone); NULL ids and repeated rows are kept, each row is packed; other columns
    are ignored. No rows: no rows. Special strings inside texts are tokens, as the library has it by default.
    """
    spark = docs.sparkSession
    rows = written(cut_pieces(docs, tokenizer_path, limit, end_id, id_col, text_col), "pieces")
    runs = written(rows.groupBy("length", "cut_task").agg(F.count("*").alias("n")), "runs")
    lengths = {r["length"]: r["n"] for r in runs.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `limit` of them
    plan = sorted(plan_of(spark, lengths, limit))
    # Placements by length and first rank; a row finds its own by its length and rank. A length has less than 2**40 pieces.
    keys = spark.sparkContext.broadcast((np.array([(p[0] << 40) + p[1] for p in plan], np.int64), np.array(plan, np.int64).reshape(-1, 6)))

    def batch(found: pa.RecordBatch) -> pa.RecordBatch:
        starts, table = keys.value
        length, rank = found.column(3).to_numpy(), found.column(5).to_numpy()
        mine = table[np.searchsorted(starts, (length << 40) + rank, "right") - 1]
        i = rank - mine[:, 1]
        sequence, offset = mine[:, 3] + i // mine[:, 4], limit - mine[:, 5] + i % mine[:, 4] * length
        return pa.RecordBatch.from_arrays([*found.columns[:5], pa.array(sequence), pa.array(offset)], names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    before = F.sum("n").over(Window.partitionBy("length").orderBy("cut_task").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ranked = rows.join(runs.select("length", "cut_task", before.alias("before")), ["length", "cut_task"])
    ranked = ranked.select(f"`{id_col}`", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("cut_nth")).alias("rank"))
    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(ranked, batch, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", rows=1 << 16)

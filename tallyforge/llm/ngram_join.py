"""N-gram Jaccard join (operator 10) by vertical partitioning.

Documents are sets of word shingles. The global order of the shingles (that of their hashes) is cut into fragments, and
each set becomes one segment per fragment. Two sets that reach the threshold differ in few shingles, so with more
fragments than that some segment of theirs is equal: equal segments give the candidate pairs. Partial overlaps of
the candidates are then counted fragment by fragment, over a coarser cut, and summed per pair.
Equal sets are one node. Sets that are found to be linked become one component at once, and only pairs of different
components are counted: at first each set with one other, that of most equal segments, round after round, then the few
pairs that are still open. So groups of copies never expand into all their pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.components import components, followed
from tallyforge.llm.shared import arrow_map, written
from tallyforge.llm.words import BASE, mix, word_hashes

#: Fragments in which overlaps are counted.
FRAGMENTS = 8
#: Numbers of fragments for candidates; sets of about one size use the same.
CUTS = np.unique((3 * 1.6 ** np.arange(60)).astype(np.int64))
#: Rounds in which each set is compared with one other, at most, before all open pairs are; a round that joins less than
#: this share of the open components is the last.
STARS, WORTH = 6, 0.05
#: In groups of up to SMALL open sets the open pairs are listed; larger ones are compared block by block, with so many
#: sets and shingles in a block at most (a longer set has a block of its own).
SMALL, BLOCK_SETS, BLOCK_SHINGLES, COLUMNS = 16, 512, 1 << 19, 4096
#: Residues of text hashes that are collected to leave most unwanted texts out of a shuffle; their number is the bound.
RESIDUES = 1 << 20


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles; of fewer words, one of them all; of none, nothing."""
    words = word_hashes((text or "").encode("utf-8", "replace").lower())
    if len(words) == 0:
        return words
    n, rows = min(size, len(words)), max(1, len(words) - size + 1)
    h = np.full(rows, n, np.uint64)
    for k in range(n):
        h = mix(h * BASE + words[k : k + rows])
    return np.unique(h)


def differing(n, percent: int):
    """The most shingles in which a set of n and one of at least n can differ at the threshold."""
    return (100 - percent) * n // percent


@lru_cache(maxsize=1 << 16)
def level(n: int, percent: int) -> int:
    """The cut for pairs whose smaller set has n shingles: more fragments than can differ, and some to spare."""
    d = differing(n, percent)
    return int(np.searchsorted(CUTS, d + 2 + d // 8))


@lru_cache(maxsize=1 << 10)
def _largest(cut: int, percent: int) -> int:
    """The largest n with that cut."""
    low, high = 0, int(CUTS[cut]) * percent + percent
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if level(mid, percent) <= cut else (low, mid - 1)
    return low


def sure(n: int, cut: int, percent: int) -> int:
    """Fragments of the cut in which a set of n has the same segment as any set that it is linked with there, at least."""
    return int(CUTS[cut]) - differing(min(n, _largest(cut, percent)), percent)


def segment_keys(hashes: np.ndarray, percent: int) -> np.ndarray:
    """Keys of a set's segments; the cut is in their last six bits.

    A pair meets at the cut of its smaller set, so a set uses the cuts of all smaller sizes that it can be linked with. Of a
    linked pair at least `sure` segments are equal there, and at least half as many keys. Empty segments say nothing and are
    left out, unless a set has so many of them that half of `sure` could be empty.
    """
    n, out = len(hashes), []
    first = max(-(-percent * n // 100), -(-percent // (100 - percent)))
    if first > n:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)])
    for cut in range(level(first, percent), level(n, percent) + 1):
        m, least = int(CUTS[cut]), sure(n, cut, percent)
        ends = np.searchsorted(hashes, np.uint64(2**64 // m) * np.arange(1, m, dtype=np.uint64))
        edges = np.concatenate([[0], ends, [n]])
        sizes = np.diff(edges)
        some = np.arange(m) if m - np.count_nonzero(sizes) > least // 2 else np.flatnonzero(sizes)
        part = mix(np.uint64(cut << 40) + some.astype(np.uint64)) + sizes[some].astype(np.uint64)
        key = mix(part * BASE + sums[edges[some + 1]] - sums[edges[some]])
        out.append((key & ~np.uint64(63)) | np.uint64(cut))
    return np.concatenate(out)


def _shared_enough(rows: DataFrame, percent: int) -> DataFrame:
    """Of (g, node, n) the rows of sets that share at least half of `sure` keys of a cut with others; a linked pair does."""
    cut = F.col("g").bitwiseAND(63).cast("int")
    size = F.get(F.array(*[F.lit(int(c)) for c in CUTS]), cut)
    top = F.least("n", F.get(F.array(*[F.lit(_largest(c, percent)) for c in range(len(CUTS))]), cut))
    least = size - F.floor(top * (100 - percent) / percent)
    same = Window.partitionBy("node", "cut")
    rows = rows.withColumn("cut", cut).withColumn("need", F.ceil(least / 2)).withColumn("keys", F.count("*").over(same))
    return rows.where("keys >= need").select("g", "node", "n")


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    """The two halves of a 128-bit digest of a set."""
    whole = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(whole[:8], "little", signed=True), int.from_bytes(whole[8:], "little", signed=True)


def _node(hashes: np.ndarray, shared: frozenset[int]) -> int:
    """A set's node: the first half of its digest, or the second one where sets of other digests share the first."""
    first, second = _digest(hashes)
    return second if first in shared else first


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Each document's set: id, th (hash of the text), n, node and rest (halves of its digest; NULL for an empty set)."""

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, size) for t in rows.column(1).to_pylist()]
        halves = [_digest(s) if len(s) else (None, None) for s in sets]
        cols = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array([h[k] for h in halves], pa.int64()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), *cols], names=["id", "th", "n", "node", "rest"])

    kind = docs.schema["id"].dataType.simpleString()
    return arrow_map(docs.select("id", "text", F.xxhash64("text").alias("th")), batch, f"id {kind}, th long, n long, node long, rest long")


def _shared_halves(sets: DataFrame) -> frozenset[int]:
    """First halves that different digests share. Of N different sets about N * N / 2**65 pairs do: none of a billion, and
    a few hundred of a hundred billion."""
    return frozenset(r["node"] for r in sets.groupBy("node").agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")).where("lo != hi").select("node").collect())


def _keys(docs: DataFrame, size: int, percent: int, shared: frozenset[int]) -> DataFrame:
    """key, node of all segments; a task gives a set's only the first time it meets the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                keys, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for text in batch.column(0).slice(at, 512).to_pylist():
                    hashes = shingles(text, size)
                    if (node := _node(hashes, shared)) not in seen:
                        seen.add(node)
                        keys.append(segment_keys(hashes, percent))
                        nodes.append(np.full(len(keys[-1]), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes))], names=["g", "node"])

    return docs.select("text").mapInArrow(run, "g long, node long")


def _distinct_groups(groups: DataFrame) -> DataFrame:
    """Of groups (g, node, n) with the same members one, with `w`, their number. Equal members are told by their number and
    two sums of hashes, 128 bits together."""
    marks = [F.count("*"), F.bit_xor(F.xxhash64("node", F.lit(1))), F.bit_xor(F.xxhash64("node", F.lit(2)))]
    alike = groups.groupBy("g").agg(*[m.alias(f"m{i}") for i, m in enumerate(marks)])
    kept = alike.groupBy("m0", "m1", "m2").agg(F.min("g").alias("g"), F.count("*").alias("w"))
    return groups.join(kept.select("g", "w"), "g")


def _bits(residues: DataFrame) -> np.ndarray:
    """The residues (r) as a bitmap of RESIDUES bits, the lowest of a byte first. Tasks set the bits, so the driver gets a row for
    each 32,768 of them, however many texts there are."""
    page = residues.groupBy(F.shiftright("r", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("r").bitwiseAND(32767)).alias("bits"))
    out = np.zeros((-(-RESIDUES // 32768), 4096), np.uint8)
    for row in page.collect():
        out[row["page"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def _segments(docs: DataFrame, wanted: DataFrame, size: int, shared: frozenset[int]) -> DataFrame:
    """node, fragment, segment (its shingles there) of the wanted nodes, each taken from one of its documents."""
    residue = F.pmod("th", F.lit(RESIDUES))
    marks = docs.sparkSession.sparkContext.broadcast(_bits(wanted.select(residue.cast("int").alias("r"))))

    def some(rows: pa.RecordBatch) -> pa.RecordBatch:
        bits = np.unpackbits(marks.value, bitorder="little")
        return rows.filter(pa.array(bits[rows.column(2).to_numpy()].astype(bool))).select([0, 1, 3])

    kind = docs.schema["id"].dataType.simpleString()
    texts = docs.select("id", "text", F.xxhash64("text").alias("th")).select("id", "text", residue.cast("int").alias("r"), "th").where("text is not null")
    few = arrow_map(texts, some, f"id {kind}, text string, th long", rows=4096)
    few = few.join(wanted.select(F.col("id").alias("k"), F.col("th").alias("kth")), F.col("id").eqNullSafe(F.col("k")) & (F.col("th") == F.col("kth")), "left_semi")
    cuts = np.uint64(2**64 // FRAGMENTS) * np.arange(1, FRAGMENTS, dtype=np.uint64)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        node, fragment, segment = [], [], []
        for text in rows.column(0).to_pylist():
            hashes = shingles(text, size)
            at = _node(hashes, shared)
            for f, part in enumerate(np.split(hashes, np.searchsorted(hashes, cuts))):
                node.append(at)
                fragment.append(f)
                segment.append(part.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(fragment, pa.int32()), pa.array(segment, pa.list_(pa.int64()))], names=["node", "fragment", "segment"])

    return arrow_map(few.select("text"), batch, "node long, fragment int, segment array<long>")


def _of(segments: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """The segments of the nodes in the columns `node` of some tables. Their list is written first, so that a short one is
    broadcast (below Spark's own limit) instead of all segments being shuffled."""
    need = written(reduce(DataFrame.union, [x.select("node") for x in nodes]).distinct(), "need")
    return segments.join(need, "node", "left_semi")


def _linked(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, na, ca, b, nb, cb) those that reach the threshold, as links of their components: the partial overlaps
    of the fragments, summed per pair."""
    left, right = (_of(segments, [pairs.select(F.col(x).alias("node"))]).select(F.col("node").alias(x), "fragment", F.col("segment").alias(f"s{x}")) for x in "ab")
    who = ["a", "na", "ca", "b", "nb", "cb"]
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]).select(*who, F.size(F.array_intersect("sa", "sb")).alias("part"))
    overlap = partial.groupBy(*who).agg(F.sum("part").alias("overlap"))
    hit = 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))
    return overlap.where(hit).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def _fits(percent: int):
    """Sizes that allow the threshold, in different components."""
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (F.col("ca") != F.col("cb"))


def _once(pairs: DataFrame) -> DataFrame:
    """Each pair once, the smaller node first."""
    flip = F.col("a") > F.col("b")
    side = lambda x, y: [F.when(flip, F.col(p + y)).otherwise(F.col(p + x)).alias(p + x) for p in ("", "n", "c")]
    return pairs.select(*side("a", "b"), *side("b", "a")).distinct()


def _overlaps(left: list, right: list) -> np.ndarray:
    """Overlaps of two blocks of sets: partial overlaps of each fragment, summed. A set is the list of its segments, by fragment."""
    total = np.zeros((len(left), len(right)), np.float32)
    for f in range(FRAGMENTS):
        sides = []
        for side in (left, right):
            part = [segments[f] for segments in side]
            rows = np.repeat(np.arange(len(side)), [len(x) for x in part])
            sides.append((rows, np.concatenate([np.zeros(0, np.int64), *part])))
        (rl, hl), (rr, hr) = sides
        both = np.intersect1d(hl, hr)
        for at in range(0, len(both), COLUMNS):
            some, grids = both[at : at + COLUMNS], []
            for rows, hashes, n in ((rl, hl, len(total)), (rr, hr, total.shape[1])):
                where = np.minimum(np.searchsorted(some, hashes), len(some) - 1)
                hit = some[where] == hashes
                grid = np.zeros((n, len(some)), np.float32)
                grid[rows[hit], where[hit]] = 1
                grids.append(grid)
            total += grids[0] @ grids[1].T
    return total


def _blocks(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets (node, n, comp, block) of large open groups, and the comparisons (a, b, part) that cover all pairs of sets that share
    a group and are in different components: block a with the blocks b of each part.

    Sets lie in blocks by the largest of their groups, those of its largest component apart. Blocks meet if a group has sets of
    both, not if their groups are only linked by others; the larger one is a, and small ones share a part."""
    size = now.groupBy("g").agg(F.count("*").alias("k"))
    home = written(now.join(size, "g").groupBy("node", "n", "comp").agg(F.max(F.struct("k", "g"))["g"].alias("home")), "homes")
    most = home.groupBy("home", "comp").count().groupBy("home").agg(F.max_by("comp", F.struct("count", "comp")).alias("most"))
    home = home.join(most, "home").withColumn("in_most", F.col("comp") == F.col("most"))
    room = F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_SHINGLES)
    blocks = home.groupBy("home", "in_most").agg(F.ceil(room).cast("int").alias("blocks"))
    block = F.xxhash64("home", "in_most", F.pmod(F.xxhash64("node"), F.col("blocks")))
    sets = written(home.join(blocks, ["home", "in_most"]).select("node", "n", "comp", block.alias("block")), "blocks")
    each = sets.groupBy("block").agg(F.count("*").alias("k"), room.alias("room"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    there = written(now.join(sets.select("node", "block"), "node").select("g", "block").distinct().join(each, "block"), "there")
    a, b = (there.select("g", *[F.col(c).alias(x + c) for c in ("block", "k", "room", "lo", "hi")]) for x in "ab")
    larger = F.struct("bk", "bblock") <= F.struct("ak", "ablock")
    pairs = a.join(b, "g").where(larger & (F.least("alo", "blo") != F.greatest("ahi", "bhi"))).select(F.col("ablock").alias("a"), F.col("bblock").alias("b"), "broom").distinct()
    before = Window.partitionBy("a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    part = F.floor(F.coalesce(F.sum("broom").over(before), F.lit(0.0)))
    return sets, written(pairs.select("a", "b", part.cast("int").alias("part")), "parts")


def _block_links(now: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Links of components by sets in large open groups; enough of them to join all components that have any. Blocks of sets that
    share a group are compared, so rows grow with blocks and not with pairs. Sets are repeated for their comparisons, a row each, after
    they met their segments: before that, Spark would take the repeated rows for a small table, which goes through the driver."""
    sets, pairs = _blocks(now)
    whole = _of(segments, [sets]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("fragment", "segment")))["segment"].alias("segments")).join(sets, "node")

    def dealt(to: DataFrame, block: str) -> DataFrame:
        return whole.join(to, F.col("block") == F.col(block)).select("a", "part", "node", "n", "comp", "segments")

    def links(left, right):
        import pandas as pd

        out, root = [], {}
        if len(left) and len(right):
            overlap = _overlaps(left["segments"].tolist(), right["segments"].tolist())
            union = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - overlap
            hit = (100 * overlap >= percent * union) & (left["comp"].to_numpy()[:, None] != right["comp"].to_numpy()[None, :])

            def top(x):
                while root.get(x, x) != x:
                    x = root[x]
                return x

            for i, j in zip(*np.nonzero(hit)):
                x, y = top(left["comp"].iat[i]), top(right["comp"].iat[j])
                if x != y:
                    root[x] = y
                    out.append((x, y))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    mine = dealt(pairs.select("a", "part").distinct(), "a").groupBy("a", "part")
    others = dealt(pairs, "b").toDF("a_2", "part_2", "node", "n", "comp", "segments").groupBy("a_2", "part_2")
    return mine.cogroup(others).applyInPandas(links, "a long, b long")


def _open(now: DataFrame, moved: DataFrame | None) -> DataFrame:
    """The rows of groups that still hold several components, after `moved` (id, comp) has sent components elsewhere."""
    if moved is not None:
        moved = moved.select(F.col("id").alias("comp"), F.col("comp").alias("next"))
        now = now.join(moved, "comp", "left").select("g", "node", "n", "w", F.coalesce("next", "comp").alias("comp"))
    split = now.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("g")
    return written(now.join(split, "g", "left_semi"), "open")


def _best_pairs(now: DataFrame, tested: DataFrame | None, turn: int, percent: int) -> DataFrame:
    """For each open set one pair that may link it to another component and is not tested: of the sets that stand for its
    groups this turn (a member chosen by a hash) the one that stands for most of them."""
    hub = now.groupBy("g").agg(F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("at"), "node", "n", "comp")).alias("hub"))
    hub = hub.select("g", F.col("hub.node").alias("b"), F.col("hub.n").alias("nb"), F.col("hub.comp").alias("cb"))
    me = now.select("g", F.col("node").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"), "w")
    pairs = me.join(hub, "g").where(_fits(percent)).groupBy("a", "na", "ca", "b", "nb", "cb").agg(F.sum("w").alias("w"))
    if tested is not None:
        pairs = pairs.join(tested, (F.least("a", "b") == F.col("ta")) & (F.greatest("a", "b") == F.col("tb")), "left_anti")
    best = pairs.groupBy("a", "na", "ca").agg(F.max(F.struct("w", "b", "nb", "cb")).alias("best"))
    return _once(best.select("a", "na", "ca", "best.b", "best.nb", "best.cb"))


def _joined(groups: DataFrame, segments: DataFrame, percent: int) -> list[DataFrame]:
    """Maps (id, comp) that in turn send the nodes of groups (g, node, n, w, comp) to their components."""
    now, maps, tested, turn = _open(groups, None), [], None, 0

    def contract(links: DataFrame) -> int:
        """How many components have gone to others."""
        nonlocal now
        moved = components(links)
        maps.append(moved)
        now = _open(now, moved)
        return moved.where("id != comp").count()

    while turn < STARS and not now.isEmpty():
        pairs = written(_best_pairs(now, tested, turn, percent), "pairs")
        mine = pairs.select(F.col("a").alias("ta"), F.col("b").alias("tb"))
        tested, turn = mine if tested is None else tested.union(mine), turn + 1
        before = now.select("comp").distinct().count()
        if contract(written(_linked(pairs, segments, percent), "edges")) < WORTH * before:
            break
    for large in (True, False):
        if now.isEmpty():
            break
        sizes = now.groupBy("g").agg(F.count("*").alias("sets")).where(f"sets {'>' if large else '<='} {SMALL}").select("g")
        some = written(now.join(sizes, "g", "left_semi"), "some")
        if some.isEmpty():
            continue
        if large:
            links = _block_links(some, segments, percent)
        else:
            a, b = (some.select("g", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("comp").alias(f"c{x}")) for x in "ab")
            pairs = a.join(b, "g").where((F.col("a") < F.col("b")) & _fits(percent)).drop("g").distinct()
            pairs = pairs.join(tested, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti")
            links = _linked(written(pairs, "pairs"), segments, percent)
        contract(written(links, "edges"))
    return maps


def similar_groups(docs: DataFrame, size: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_shingles, component_id (the smallest id that is reachable by links, its own included).

    Two documents link when 100 x intersection >= percent x union of their distinct `size`-word shingles; words are
    runs without ASCII white space, A-Z lower-cased. A document with fewer words is one shingle of them all. A
    NULL text and one without words is empty and linked with nothing: its component is its own id. Rows with equal
    sets are linked; so are repeated rows. A NULL id never is the smallest one; a component of such rows only has
    a NULL id. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sets = written(_sets(texts, size), "sets")
    shared = _shared_halves(sets)
    if shared:
        sets = sets.withColumn("node", F.when(F.col("node").isin(list(shared)), F.col("rest")).otherwise(F.col("node")))
    nodes = sets.where("n > 0").groupBy("node").agg(F.min(F.struct("id", "th")).alias("doc"), F.min("id").alias("low"), F.min("n").alias("n"))
    same = Window.partitionBy("g")
    groups = _keys(texts, size, percent, shared).select("g", "node", F.min("node").over(same).alias("lo"), F.max("node").over(same).alias("hi")).where("lo != hi").select("g", "node")
    groups = written(_shared_enough(groups.distinct().join(nodes.select("node", "n"), "node"), percent), "groups")
    wanted = written(nodes.join(groups.select("node").distinct(), "node", "left_semi").select("doc.id", "doc.th"), "wanted")
    segments = written(_segments(texts, wanted, size, shared).dropDuplicates(["node", "fragment"]), "segments")
    maps = _joined(_distinct_groups(groups).withColumn("comp", F.col("node")), segments, percent)
    comp = written(followed(nodes.select(F.col("node").alias("id"), F.col("node").alias("comp"), "low"), maps), "labels").select(F.col("id").alias("node"), "comp", "low")
    low = comp.join(comp.groupBy("comp").agg(F.min("low").alias("component")), "comp").select("node", "component")
    out = sets.select("id", "n", "node").join(low, "node", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component_id"))

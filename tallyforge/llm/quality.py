"""Quality classifier (operator 8): a byte-level convolutional network in numpy.

Learned filters slide over the bytes of the whole document. Their responses are max-pooled in overlapping chunks;
a document is the mean and the maximum of its chunks' pooled responses, combined into one probability.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import arrow_map, share

FILTERS, WIDTH, BLOCK = 16, 6, 128
#: Chunks are two neighbouring blocks, so each overlaps the next by half.
#: Rows of each label that the network is fitted on, about, and the bytes of each label from which on no row is added.
FIT_ROWS, FIT_BYTES = 1500, 4 << 20
EPOCHS, STEP, GROUP = 12, 0.01, 32
#: Bytes that are convolved at once; bounds a worker's memory.
SLAB = BLOCK * 512


def as_bytes(text: str | None) -> np.ndarray:
    """UTF-8 with room for one filter at least; the text is padded with zeros to whole blocks."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return np.concatenate([raw, np.zeros(BLOCK * max(1, -(-len(raw) // BLOCK)) - len(raw) + WIDTH - 1, np.uint8)])


def responses(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Filter responses at each position: WIDTH x 256 x FILTERS weights looked up and summed."""
    n = len(raw) - WIDTH + 1
    out = table[0].take(raw[:n], axis=0)
    for k in range(1, WIDTH):
        out += table[k].take(raw[k : k + n], axis=0)
    return out


def block_tops(raw: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As block_maxima, and the positions of the maxima."""
    n, tops, args = len(raw) - WIDTH + 1, [], []
    for at in range(0, n, SLAB):
        r = responses(raw[at : min(n, at + SLAB) + WIDTH - 1], table).reshape(-1, BLOCK, FILTERS)
        arg = r.argmax(1)
        tops.append(np.take_along_axis(r, arg[:, None], 1)[:, 0])
        args.append(arg + at + np.arange(len(r))[:, None] * BLOCK)
    return np.concatenate(tops), np.concatenate(args)


def block_maxima(raw: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Max-pooled responses of each block of the document (blocks x FILTERS), slab by slab."""
    n = len(raw) - WIDTH + 1
    parts = [responses(raw[at : min(n, at + SLAB) + WIDTH - 1], table).reshape(-1, BLOCK, FILTERS).max(1) for at in range(0, n, SLAB)]
    return np.concatenate(parts)


def pooled(blocks: np.ndarray) -> np.ndarray:
    """Mean and maximum over the overlapping chunks of their non-negative maxima."""
    chunks = np.maximum(blocks[:-1], blocks[1:]) if len(blocks) > 1 else blocks
    chunks = np.maximum(chunks, 0)
    return np.concatenate([chunks.mean(0), chunks.max(0)])


def forward(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(x @ model["w1"] + model["b1"], 0)
    return hidden, 1 / (1 + np.exp(-np.clip(hidden @ model["w2"] + model["b2"], -30, 30)))


def fit(texts: list[bytes], labels: list[int], seed: int = 8) -> dict:
    """Adam on the log loss, with classes weighted alike, through pooling to the filters. Texts are
    whole and pooled slab by slab. With one class or none, the model answers that class' share."""
    rng = np.random.default_rng(seed)
    m = {"table": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), "w1": rng.normal(0, 0.3, (2 * FILTERS, 16)), "b1": np.zeros(16), "w2": rng.normal(0, 0.3, 16), "b2": 0.0}
    y = np.array(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return m | {"w2": np.zeros(16), "b2": float(np.clip(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), -4, 4))}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    raws = [as_bytes(t.decode("utf-8", "replace")) for t in texts]
    state = {k: (np.zeros_like(v, dtype=float), np.zeros_like(v, dtype=float)) for k, v in m.items()}
    t = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(order), GROUP):
            rows, t = order[at : at + GROUP], t + 1
            cases, feats = [], []
            for i in rows:
                top, arg = block_tops(raws[i], m["table"])
                left, right = (top[:-1], top[1:]) if len(top) > 1 else (top, top)
                where = np.where(left >= right, arg[: len(left)], arg[-len(right) :])
                chunk = np.maximum(np.maximum(left, right), 0)
                feats.append(np.concatenate([chunk.mean(0), chunk.max(0)]))
                cases.append((i, where, chunk))
            x = np.array(feats)
            hidden, p = forward(m, x)
            d = (p - y[rows]) * weight[rows] / len(rows)
            dh = np.outer(d, m["w2"]) * (hidden > 0)
            grad = {"w2": hidden.T @ d, "b2": d.sum(), "w1": x.T @ dh, "b1": dh.sum(0), "table": np.zeros(m["table"].shape)}
            for (i, where, chunk), dx in zip(cases, dh @ m["w1"].T):
                g = np.broadcast_to(dx[:FILTERS] / len(chunk), chunk.shape).copy()
                g[chunk.argmax(0), np.arange(FILTERS)] += dx[FILTERS:]
                g *= chunk > 0
                f = np.broadcast_to(np.arange(FILTERS), chunk.shape)
                for k in range(WIDTH):
                    np.add.at(grad["table"][k], (raws[i][where + k], f), g)
            for k, g in grad.items():
                a, b = state[k]
                a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * np.square(g)
                state[k] = a, b
                m[k] = m[k] - STEP * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            m["table"] = m["table"].astype(np.float32)
    return m


def learn(docs: DataFrame, labels: DataFrame, rows: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> dict:
    """The network, fitted on a bounded sample: about fit_rows rows of each label among those for which `rows` (on
    the id) holds, chosen by a hash of the id, each with its whole text. Rows of a label are taken by that hash until
    they hold FIT_BYTES; long texts make them fewer, none is cut. Rows with a NULL text or label are left out; of several labels of an id the lowest holds."""
    one = labels.where(rows & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(label_col).cast("int").alias("y"))
    sizes = {r[0]: r[1] for r in one.where("y in (0, 1)").groupBy("y").count().collect()}
    part = F.when(F.col("y") == 1, min(1.0, fit_rows / sizes.get(1, 1))).when(F.col("y") == 0, min(1.0, fit_rows / sizes.get(0, 1))).otherwise(-1.0)
    chosen = F.broadcast(one.where(share(F.col(id_col), 8) < part).limit(4 * fit_rows))  # bounded, so the texts need no shuffle
    pick = docs.select(F.col(id_col), F.col(text_col).alias("t")).where(rows & F.col("t").isNotNull()).join(chosen.withColumnRenamed(id_col, "k"), F.col(id_col) == F.col("k"))
    turn = share(F.col(id_col), 8)
    sizes, last = pick.groupBy("y", turn.alias("turn")).agg(F.sum(F.octet_length("t")).alias("n")).collect(), {0: -1.0, 1: -1.0}
    held = {0: 0, 1: 0}
    for r in sorted(sizes, key=lambda r: r["turn"]):
        if held[r["y"]] < FIT_BYTES:
            held[r["y"]], last[r["y"]] = held[r["y"]] + r["n"], r["turn"]
    few = pick.where(turn <= F.when(F.col("y") == 1, last[1]).otherwise(last[0]))
    got = few.select("y", F.encode("t", "utf-8").alias("t")).orderBy("y", F.md5("t")).limit(4 * fit_rows).toPandas()
    return fit([bytes(x) for x in got["t"]], got["y"].tolist())


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, score (0 to 1, higher: the label 1 is likelier) and predicted (1 from 0.5 on).

    A NULL text is scored as the empty one, and that as a block of zeros. Every byte of a long text counts.
    Repeated rows and NULL ids stay; other columns are ignored. No shuffle.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = shipped.value
        x = np.array([pooled(block_maxima(as_bytes(t), m["table"])) for t in rows.column(1).to_pylist()]).reshape(-1, 2 * FILTERS)
        p = np.clip(forward(m, x)[1], 0.0, 1.0)
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), batch, f"`{id_col}` {kind}, score double, predicted int")

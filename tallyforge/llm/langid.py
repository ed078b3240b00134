"""Language ID (operator 3): each document as a mixture of languages.

Byte trigrams of the lower-cased text fall into buckets; a language is a distribution over buckets, learned from
labelled rows. A document's language proportions come from expectation-maximisation on its bucket counts, and
the language set is the one with the best penalised likelihood.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import arrow_filter, arrow_map, share

BUCKETS = 1 << 15
#: The model is BUCKETS x languages numbers on the driver and in each worker. Of more labels than this the model has those
#: with the most rows (ties: the names that sort first); labels beyond are noise for a language model.
MOST_LANGUAGES = 256
#: Labelled rows that the model is fitted on, about, for each language; rows are chosen by a hash of the text.
FIT_ROWS = 3000
#: EM ends when the likelihood is within GAP of its maximum, or after ROUNDS.
ROUNDS, GAP, UNDETERMINED = 200, 0.5, "und"
#: Trigrams overlap, so a text of n bytes is worth about n / 3 independent ones.
OVERLAP = 3.0
#: Bytes of a text that are counted at once.
STRETCH = 1 << 22
_LETTERS = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def counted(text: str) -> np.ndarray:
    """Counts of the buckets of all byte trigrams of the text; what is no letter counts as a space. A long text is taken in stretches
    that overlap by two bytes, so memory stays bounded and no trigram is lost or made at a cut."""
    whole = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_LETTERS) + b" ", np.uint8)
    total = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(whole) - 2, STRETCH):
        raw = whole[at : at + STRETCH + 2].astype(np.uint32)
        grams = (raw[:-2] * np.uint32(0x9E3779B1)) ^ (raw[1:-1] * np.uint32(0x85EBCA77)) ^ (raw[2:] * np.uint32(0xC2B2AE3D))
        grams = (grams * np.uint32(0x27D4EB2F)) >> np.uint32(17)
        total += np.bincount(grams[(raw[:-2] != 32) | (raw[1:-1] != 32)], minlength=BUCKETS)
    return total


def learn(docs: DataFrame, rows: Column, text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """The languages, sorted, and log probabilities (buckets x languages), from rows for which `rows` holds.

    Rows with a NULL text or label are left out. Of a language with more than fit_rows rows a fixed
    pseudo-random part of about that size is used. Counts are summed in the tasks and then by key, so what
    reaches the driver has at most MOST_LANGUAGES x BUCKETS rows.
    """
    usable = docs.where(rows & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    usable = usable.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    sizes = {r["lang"]: r["rows"] for r in usable.groupBy("lang").agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "lang").limit(MOST_LANGUAGES).collect()}
    names = sorted(sizes)
    if not names:
        return [], np.zeros((BUCKETS, 0))
    part = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, fit_rows / sizes[k])))])
    chosen = usable.where(share(F.col("text"), 3) < part[F.col("lang")]).select(F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int").alias("k"), "text")

    def tally(batches):
        sums = np.zeros((len(names), BUCKETS), np.int64)
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[k - 1] += counted(text).astype(np.int64)
        lang, bucket = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(bucket, pa.int32()), pa.array(sums[lang, bucket], pa.int64())], names=["k", "b", "n"])

    found = chosen.mapInArrow(tally, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(names)), 0.5)
    counts[found["b"].to_numpy(int), found["k"].to_numpy(int)] += found["n"].to_numpy(float)
    return names, np.log(counts / counts.sum(0))


def proportions(n: np.ndarray, p: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float, float]:
    """Mixture weights of the columns of p by EM for bucket counts n, the log likelihood they reach, and a bound that no
    weights exceed: by the concavity of the logarithm they gain at most sum(n) x log of the largest factor of a round."""
    w, total = np.full(p.shape[1], 1.0 / p.shape[1]), n.sum()
    for _ in range(rounds):
        factor = (p.T @ (n / (p @ w))) / total
        gap = max(0.0, float(total * np.log(factor.max())))
        if gap <= GAP:
            break
        w = w * factor
    reached = float(n @ np.log(p @ w))
    factor = (p.T @ (n / (p @ w))) / total
    return w, reached, reached + max(0.0, float(total * np.log(factor.max())))


def mixture(text: str | None, names: list[str], logs: np.ndarray, probs: np.ndarray) -> tuple[str, float, list[float]]:
    """Top language, score and the weights of all languages.

    The candidate sets are nested, by weight in the mixture of all languages. A set's likelihood is at most the bound
    for all languages, so if even that gains less than one more language costs, the single best one is taken.
    The score is the top language's share of the mixture times its posterior among single languages. Ties go to
    the name that sorts first.
    """
    if not text or not names or not any(map(str.isalpha, text)):
        return UNDETERMINED, 0.0, [0.0] * len(names)
    all_n = counted(text)
    at = np.flatnonzero(all_n)
    n, alone = all_n[at].astype(float), all_n[at] @ logs[at]
    cost = OVERLAP * np.log(max(2.0, n.sum()))
    odds = np.exp((alone - alone.max()) / OVERLAP)
    sure, best = odds / odds.sum(), int(np.argmax(alone))
    weights = np.zeros(len(names))
    weights[best] = 1.0
    if len(names) > 1:
        p = probs[at]
        full, top, bound = proportions(n, p)
        if bound - alone[best] > cost:
            order, value, value_of = np.argsort(-full, kind="stable"), alone[best], 0.0
            for size in range(2, len(names) + 1):
                part, reached = proportions(n, p[:, order[:size]])[:2] if size < len(names) else (full[order], top)
                if reached - cost * (size - 1) > value - value_of:
                    value, value_of, weights = reached, cost * (size - 1), np.zeros(len(names))
                    weights[order[:size]] = part
                elif full[order[size - 1]] < 1e-3:
                    break
    k = int(np.argmax(weights))
    return names[k], float(min(1.0, weights[k] * (sure[k] if weights[k] == 1.0 else 1.0))), weights.tolist()


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, lang_pred, score (0 to 1), weights (map of language to proportion).

    A NULL text or one without a letter has lang_pred `und`, score 0 and no weights; so has every text if the
    model has no language. Repeated rows and NULL ids stay; other columns are ignored. No shuffle.
    """
    names, logs = model
    shipped = docs.sparkSession.sparkContext.broadcast((names, logs, np.exp(logs)))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [mixture(t, *shipped.value) for t in rows.column(1).to_pylist()]
        maps = [[(name, w) for name, w in zip(names, x[2]) if w > 0] for x in found]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array([x[0] for x in found]), pa.array([x[1] for x in found], pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=[id_col, "lang_pred", "score", "weights"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), batch, f"`{id_col}` {kind}, lang_pred string, score double, weights map<string,double>")


def with_language(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """The rows that `identify` names a language for, with all their columns; `und` ones go. No shuffle."""
    names, logs = model
    shipped = docs.sparkSession.sparkContext.broadcast((names, logs, np.exp(logs)))
    return arrow_filter(docs, text_col, lambda texts: [mixture(t, *shipped.value)[0] != UNDETERMINED for t in texts])

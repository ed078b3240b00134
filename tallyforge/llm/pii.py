"""PII (operator 9): proposed spans, boosted trees, calibrated thresholds.

Base spans (e-mail address, IPv4 address, card number, telephone number) follow fixed formats and always stay.
High-recall generators propose further, overlapping spans; gradient-boosted trees score them by format and
context, and a calibrated threshold per kind decides which are added.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shared import arrow_map

#: The base formats and the order of kinds.
KINDS = ("email", "ip", "card", "phone", "contact", "number", "secret")
BASE_KINDS = KINDS[:4]
EMAIL_LOCAL, EMAIL_DOMAIN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"), re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "contact": "[CONTACT]", "number": "[NUMBER]", "secret": "[SECRET]"}

#: Generators of further candidates: anything around an @ (see around_at), runs of digits with separators, long unbroken strings. None
#: has an end of its own: a candidate is as long as its characters go on, or a part of it would stay in a redacted text.
SPELLED_OUT = re.compile(r"[\[(]at[\])] ?\w{2,} ?[\[(]dot[\])] ?\w{2,}")
NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9]){6,}")
SECRET = re.compile(r"[A-Za-z0-9_/+=-]{12,}")
ASSIGNED = re.compile(r"(?i)(?:passw(?:or)?d|pwd|token|secret|api[_-]?key|key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?$")

#: Words that announce a person's number or contact just before it.
NEAR = re.compile(r"(?i)\b(?:tele(?:fon|phone)|tel|phone|call|mobile|cell|fax|whatsapp|card|account|iban|ssn|e-?mail|mail|contact|reach|write)\b[^0-9\n]{0,12}$")
SPELLED = re.compile(r"[\[(]at[\])]")

#: Candidates of each kind and label that the trees are grown on, about, chosen from all texts by a hash; score bins.
FIT_ROWS, SCORE_BINS = 6000, 1000
TREES, DEPTH, RATE, BINS = 30, 3, 0.3, 16
#: Least precision on the labelled candidates of all texts that the trees were not grown on that a threshold must reach.
PRECISION = 0.99


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(2 * int(c) - 9 * (c > "4") for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """As the leftmost non-overlapping matches of the local part, @ and the domain, in linear time: the local part
    reaches back from the @ as far as its characters do, at most to the end of the match before."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        done = at + 1
        if m:
            found.append((start, m.end()))
            done = m.end()
        at = text.find("@", done)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then by start; code points, end exclusive. A match that fails its check is dropped."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


class Taken:
    """Spans in order of their starts, to ask which of them a span touches."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.spans = sorted(spans)
        self.reach = list(itertools.accumulate((e for _, e in self.spans), max))

    def shared(self, start: int, end: int) -> int:
        """The most characters that one of the spans has in common with this one."""
        most, i = 0, bisect_left(self.spans, (end,)) - 1
        while i >= 0 and self.reach[i] > start:
            most = max(most, min(end, self.spans[i][1]) - max(start, self.spans[i][0]))
            i -= 1
        return most


def around_at(text: str) -> list[tuple[int, int]]:
    """The runs without white space and @ on both sides of an @, and `name [at] host [dot] end`, each from left to right without overlaps
    among its own, in linear time."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start, end = at, at + 1
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and text[end] != "@" and not text[end].isspace():
            end += 1
        done = at + 1
        if start < at and end > at + 1:
            found.append((start, end))
            done = end
        at = text.find("@", done)
    done = 0
    for m in SPELLED_OUT.finditer(text) if "at]" in text or "at)" in text else ():
        start = stop = m.start() - (text[m.start() - 1 : m.start()] == " ")
        while start > done and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        if stop - start >= 2:
            found.append((start, m.end()))
            done = m.end()
    return found


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidates of all generators."""
    out = [("contact", *s) for s in around_at(text)]
    out += [("number", m.start(), m.end()) for m in NUMBER.finditer(text)]
    return out + [("secret", m.start(), m.end()) for m in SECRET.finditer(text)]


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format of the span and its context; whether it passes a base check is not among them."""
    kind, start, end = span
    body, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 1]
    digits, letters = sum(map(str.isdigit, body)), sum(map(str.isalpha, body))
    upper, other = sum(map(str.isupper, body)), len(body) - digits - letters
    runs = sum(a.isdigit() != b.isdigit() for a, b in zip(body, body[1:]))
    return [
        float(KINDS.index(kind)), float(len(body)), float(digits), digits / len(body), letters / len(body), upper / len(body), float(other), float(runs), float(body.count(".")), float("@" in body),
        len(set(body.lower())) / min(len(body), 36), float(before[-1:] == "+"), float(bool(ASSIGNED.search(before))), float(bool(NEAR.search(before))), float(bool(SPELLED.search(body))), float(before[-1:].isalnum()), float(after.isalnum()), float(before[-1:] in "\"'(<"), float(set(body.lower()) <= set("0123456789abcdef")),
    ]


def labelled(text: str) -> list[tuple[tuple[str, int, int], int]]:
    """Candidates of a text with labels from strong signs only. 1: it covers the better part of a base span, is a long
    value that is assigned to a password or key, a spelled-out contact, or a number of a telephone's length that its
    context announces. 0: a number or contact that touches no base span and that no context announces; another secret
    without a digit, or with digits only that touch no base span. All others are left out."""
    base, out = Taken([s[1:] for s in base_spans(text)]), []
    for kind, start, end in proposals(text):
        body, before = text[start:end], text[max(0, start - 24) : start]
        shared = base.shared(start, end)
        digits = 0 if body.isalpha() else sum(map(str.isdigit, body))
        near = kind != "secret" and bool(NEAR.search(before))
        if shared >= 0.8 * (end - start):
            y = 1
        elif kind == "secret":
            y = 1 if ASSIGNED.search(before) else 0 if digits == 0 or shared <= 0 and not any(map(str.isalpha, body)) else None
        elif kind == "contact":
            y = 1 if SPELLED.search(body) else 0 if shared <= 0 and not near else None
        else:
            y = None if shared > 0 else 1 if near and 9 <= digits <= 15 else None if near else 0
        if y is not None:
            out.append(((kind, start, end), y))
    return out


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int) -> tuple:
    """A regression tree as nested tuples (feature, cut, left, right) or (value,)."""
    leaf = (float(-RATE * g.sum() / (h.sum() + 1.0)),)
    if depth == 0 or len(g) < 20:
        return leaf
    gain, pick = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f, at in enumerate(cuts):
        for c in at:
            left = x[:, f] <= c
            gl, hl = g[left].sum(), h[left].sum()
            now = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - whole
            if now > gain:
                gain, pick = now, (f, float(c), left)
    if pick is None:
        return leaf
    f, c, left = pick
    return (f, c, _tree(x[left], g[left], h[left], cuts, depth - 1), _tree(x[~left], g[~left], h[~left], cuts, depth - 1))


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, c, low, high = tree
    return np.where(x[:, f] <= c, _value(low, x), _value(high, x))


def probability(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(sum((_value(t, x) for t in trees), np.zeros(len(x))), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray) -> list[tuple]:
    """Trees for the log loss by gradient boosting with second-order leaf values."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[:-1], method="lower")) for f in range(x.shape[1])]
    trees, z = [], np.zeros(len(y))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        trees.append(_tree(x, p - y, p * (1 - p), cuts, DEPTH))
        z = z + _value(trees[-1], x)
    return trees


def place(text: str, span: tuple[str, int, int]) -> float:
    """A number in [0, 1) that is fixed for a candidate and its context."""
    kind, start, end = span
    return zlib.crc32((kind + text[max(0, start - 24) : end + 1]).encode("utf-8", "replace")) / 2**32


def tallies(docs: DataFrame, fn, keys: str) -> list:
    """The sums over all texts of the Counter that fn gives for some of them; keys are its names and types."""
    names = [k.split()[0] for k in keys.split(",")]

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = fn(rows.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in found], pa.string() if i == 0 else pa.int32()) for i in range(len(names))), pa.array(list(found.values()), pa.int64())], names=[*names, "n"])

    return arrow_map(docs, batch, f"{keys}, n long").groupBy(*names).agg(F.sum("n").alias("n")).collect()


def learn(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> dict:
    """Trees and thresholds. The trees grow on about fit_rows candidates of each kind and label, at most half of them,
    chosen from all texts. Each kind's threshold is set on the labelled candidates of all texts that the trees did not
    grow on, as counts by score: the lowest score from which at least PRECISION are positive, and no less than 0.5. A
    kind whose positives were all grown on is set on these; one without positives in any text adds nothing."""
    texts = docs.select(F.col(text_col).alias("text")).where("text is not null")
    sizes = {(r["kind"], r["y"]): r["n"] for r in tallies(texts, lambda some: Counter((s[0], y) for t in some for s, y in labelled(t)), "kind string, y int")}
    none = {"trees": [], "cut": {}}
    if len({y for _, y in sizes}) < 2:
        return none
    part = {k: min(0.5, fit_rows / n) for k, n in sizes.items()}

    def cases(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [(features(t, s), y) for t in rows.column(0).to_pylist() for s, y in labelled(t) if place(t, s) < part.get((s[0], y), 0)]
        return pa.RecordBatch.from_arrays([pa.array([c[0] for c in found], pa.list_(pa.float64())), pa.array([c[1] for c in found], pa.int32())], names=["x", "y"])

    got = arrow_map(texts, cases, "x array<double>, y int").distinct().orderBy(F.xxhash64("x"), "y").toPandas()
    if got["y"].nunique() < 2:
        return none
    trees = boost(np.array(got["x"].tolist()), got["y"].to_numpy(float))
    shipped = docs.sparkSession.sparkContext.broadcast(trees)

    def scored(some: list[str]) -> Counter:
        found = [(s[0], y, place(t, s) < part.get((s[0], y), 0), features(t, s)) for t in some for s, y in labelled(t)]
        bins = np.floor(probability(shipped.value, np.array([f[3] for f in found])) * SCORE_BINS).astype(int).tolist() if found else []
        return Counter((k, int(grown), b, y) for (k, y, grown, _), b in zip(found, bins))

    counts: dict = {}
    for r in tallies(texts, scored, "kind string, grown int, bin int, y int"):
        counts.setdefault((r["kind"], r["grown"]), np.zeros((SCORE_BINS + 1, 2)))[r["bin"], r["y"]] += r["n"]
    cut, nothing = {}, np.zeros((SCORE_BINS + 1, 2))
    for k in KINDS[4:]:
        seen = counts.get((k, 0), nothing)
        if not seen[:, 1].sum():
            seen = seen + counts.get((k, 1), nothing)
        good, bad = np.cumsum(seen[::-1, 1]), np.cumsum(seen[::-1, 0])
        if len(fine := np.flatnonzero((seen[::-1, 1] > 0) & (good >= PRECISION * (good + bad)))):
            cut[k] = max(0.5, float(SCORE_BINS - fine[-1]) / SCORE_BINS)
    return {"trees": trees, "cut": cut}


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], model: dict) -> list[list[tuple[str, int, int]]]:
    """Of each text the candidates over their kind's threshold that touch none of its base spans, the likeliest first; a
    candidate that overlaps one taken before is left out (ties: the earlier, then the longer one). The trees are asked
    once for the candidates of all texts."""
    some: list[list[tuple[str, int, int]]] = []
    for text, base in zip(texts, bases):
        fixed = Taken([s[1:] for s in base])
        some.append([s for s in proposals(text) if s[0] in model["cut"] and not fixed.shared(s[1], s[2])] if model["cut"] else [])
    if not any(some):
        return some
    scores, at, out = probability(model["trees"], np.array([features(t, s) for t, mine in zip(texts, some) for s in mine])), 0, []
    for mine in some:
        p = scores[at : at + len(mine)]
        at += len(mine)
        taken: list[tuple[str, int, int]] = []
        order: list[tuple[int, int]] = []  # of taken spans, which are apart from each other
        for i in sorted((i for i in range(len(mine)) if p[i] >= model["cut"][mine[i][0]]), key=lambda i: (-p[i], mine[i][1], -mine[i][2])):
            _, start, end = mine[i]
            k = bisect_left(order, (start, end))
            if (k == 0 or order[k - 1][1] <= start) and (k == len(order) or order[k][0] >= end):
                taken.append(mine[i])
                order.insert(k, (start, end))
        out.append(sorted(taken, key=lambda s: (KINDS.index(s[0]), s[1])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping ones, replaced by the mark of the first."""
    out, done = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= done:
            out += [text[done:start], MARKS[kind]]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added, as
    kind:start:end joined by commas) and redacted (the text with marks in place of all spans; NULL stays NULL).

    A NULL text has no spans, like the empty one. Repeated rows and NULL ids stay; other columns are ignored.
    No shuffle; each text is handled whole.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        cols = [[] for _ in range(7)]
        texts = rows.column(1).to_pylist()
        bases = [base_spans(t or "") for t in texts]
        for text, base, more in zip(texts, bases, added_spans([t or "" for t in texts], bases, shipped.value)):
            spans = base + more
            for col, k in zip(cols, BASE_KINDS):
                col.append(sum(s[0] == k for s in base))
            cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            cols[5].append(joined(spans))
            cols[6].append(None if text is None else redacted(text, spans))
        return pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], names=[id_col, *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "redacted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), batch, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string", rows=256)


def redact(docs: DataFrame, model: dict, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """All rows and columns of docs, with marks in place of personal data in the text and, where there is such a
    column, the new text's length in size_col. NULL texts stay NULL with their size. No shuffle."""
    shipped, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)
    size = docs.columns.index(size_col) if size_col in docs.columns else None

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        before, cols = rows.column(at).to_pylist(), list(rows.columns)
        bases = [base_spans(t or "") for t in before]
        added = added_spans([t or "" for t in before], bases, shipped.value)
        texts = [redacted(t, base + more) if t else t for t, base, more in zip(before, bases, added)]
        if size is not None:
            was = cols[size].to_pylist()
            cols[size] = pa.array([w if t is None else len(t) for w, t in zip(was, texts)], cols[size].type)
        cols[at] = pa.array(texts, cols[at].type)
        return pa.RecordBatch.from_arrays(cols, names=rows.schema.names)

    return arrow_map(docs, batch, docs.schema, rows=256)

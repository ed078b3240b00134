"""Spelling variants, packing and collocations against brute force and the library, with the awkward cases of each."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyforge.llm import packing, phrases, spelling
from tallyforge.llm.shared import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat", "en", "s", 7), (2, "", "en", "s", 0), (3, "  \n ", "en", None, 4), (4, "ünï Lettering " * 30000, "de", "s", 1), (5, "123 %%%", "en", "s", 7)]
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).select("*", *[F.lit("x").alias(c) for c in ("word", "n", "length", "phrase", "Rank", "cut_task", "cell")])


def near(words):
    """All near pairs, by all edits of each word."""
    known, letters, out = set(words), sorted(set("".join(words))), set()
    for w in words:
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + a + w[i + 1 :] for i in range(len(w)) for a in letters} | {w[:i] + a + w[i:] for i in range(len(w) + 1) for a in letters}
        out |= {(w, x) for x in edits & known if x != w}
    return out


def alike(seed, n=300, letters="abé"):
    rng = random.Random(seed)
    return sorted({"".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(n)})


# spelling variants
@pytest.mark.parametrize("letters", ["a", "ab", "abé"])
def test_both_searches_find_all_near_words(letters):
    words = alike(len(letters), 150, letters)
    held = spelling.Vocabulary(words)
    assert set(held.near(words, 1)) | set(held.near(words, -1)) == near(words)
    assert set(held.near(["zzzzzz", "zbabab"], 1)) | set(held.near(["zbabab"], -1)) == {("zbabab", w) for w in words if w[1:] == "babab" and len(w) == 6 or w == "babab"}


def test_long_words_and_repeated_letters():
    a, b = "x" * 3000 + "ab", "x" * 3001 + "ab"
    held = spelling.Vocabulary([a, b])
    assert set(held.near([a, b], 1)) == {(a, b), (b, a)}


@pytest.mark.parametrize("sizes", [(1 << 16, 1 << 18, 1 << 16), (7, 5, 20)])
def test_near_words_of_hot_cells_are_found_in_blocks(spark, sizes):
    words = alike(9)
    df = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    got = [tuple(r) for r in spelling.near_words(df, *sizes).collect()]
    n = {w: i + 1 for i, w in enumerate(words)}
    assert len(got) == len(set(got)) and set(got) == {(w, x, n[x]) for w, x in near(words)}


def by_hand(rows, thin):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if thin and h % thin == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    to = defaultdict(set)
    for w, x in near(list(n)):
        to[w].add(x)
    form = {w: x for w in to if n[x := min(to[w], key=lambda v: (-n[v], v))] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(to[w]), n[form[w]] if w in form else None))
    return out


def test_variants_by_hand(spark, awkward):
    rng = random.Random(4)
    base = {"colour": 200, "coloür": 30, "colours": 39, "colouré": 6, "Colours": 1, "abcdefg": 5, "abcdef": 25, "bcdefg": 25, "éabcdeÿ": 4, "short": 90, "x" * 4000: 5, "x" * 4001: 30}
    texts = [w for w, k in base.items() for _ in range(k)]
    rng.shuffle(texts)
    rows = [(i // 3 if i else None, " ".join(texts[k : k + 7]) + "\t9", None, None, None) for i, k in enumerate(range(0, len(texts), 7))]
    for thin in (None, 3):
        got = [tuple(r) for r in spelling.variants(spark.createDataFrame(rows, DOCS), thin=thin).collect()]
        assert len(got) == len(set(got)) and set(got) == by_hand(rows, thin)
    roots = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(rows, DOCS)).collect()}
    assert roots["colouré"] == "colour" and roots["x" * 4000] == "x" * 4001
    assert [tuple(r) for r in spelling.variants(awkward).collect()] == [("lettering", None, "lettering", 30000, 0, None)]
    assert spelling.variants(awkward.limit(0)).count() == 0


# packing
def checked(pieces, limit=2048):
    """Every sequence is gapless from 0 and within the limit; their number."""
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for rows in by.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_packing_keeps_the_library_s_ids(spark, sf_dir, awkward):
    tok = Tokenizer.from_file(PATH)
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(["a<|endoftext|>b", "ΣΑΣ İstanbul é ​½²ªº中文😀 ́x", "it's'sWE'VE", "x" * 70000, "a\x1cb\u0085c", "ß×÷ÀÉ  12345", None, ""])], DOCS)
    docs = table(spark, sf_dir, "documents")
    for df in (docs.select(odd.columns), odd, awkward.select(odd.columns), odd.limit(0)):
        rows = packing.packed(df, PATH).collect()
        want = Counter()
        for r in df.collect():
            ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            for p, at in enumerate(range(0, len(ids), 2048)):
                want[r["doc_id"], p, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        total = sum(k[3] * n for k, n in want.items())
        assert -(-total // 2048) <= checked(rows) <= -(-total // 2048) * 1.01 + 2


def best_fit(lengths, limit):
    gaps = []
    for size in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= size]
        gap = min(fits, default=limit)
        if fits:
            gaps.remove(gap)
        gaps.append(gap - size)
    return len(gaps)


@pytest.mark.parametrize("kind", ["third", "mixed", "ones", "whole"])
def test_rounds_come_close_to_best_fit(spark, kind):
    rng = random.Random(1)
    lengths = {"third": [34] * 500, "mixed": [rng.randint(10, 70) for _ in range(400)], "ones": [1] * 1000, "whole": [100] * 20 + [51] * 7}[kind]
    plan = packing.plan_of(spark, dict(Counter(lengths)), 100)
    rows = [{"sequence_id": q + i // each, "offset": 100 - gap + i % each * size, "length": size} for size, _, count, q, each, gap in plan for i in range(count)]
    assert Counter(r["length"] for r in rows) == Counter(lengths)
    ranks = defaultdict(list)
    for size, first, count, *_ in plan:
        ranks[size] += range(first, first + count)
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    assert checked(rows, 100) <= best_fit(lengths, 100) * 1.01 + 1


def test_a_sweep_gives_each_piece_the_smallest_free_gap():
    placed, left = packing.swept([(packing.GAP, 9, 0, 1), (packing.PIECE, 8, 0, 2), (packing.GAP, 7, 1, 2), (packing.PIECE, 3, 0, 5)])
    assert placed == [(8, 0, 1, 0, 1, 9), (3, 0, 4, 1, 2, 7)] and left == [(packing.PIECE, 8, 1, 1), (packing.PIECE, 3, 4, 1)]
    assert packing.updated([(3, 0, 3, 1, 2, 7)]) == [(packing.GAP, 1, 1, 1), (packing.GAP, 4, 2, 1)]


# collocations
def counted(rows, least, top):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    found = defaultdict(list)
    for (lang, *p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if len(p) == 2 and any(len(q) == 4 and q[0] == lang and b >= least and 100 * b >= 50 * a and (list(q[1:3]) == p or list(q[2:]) == p) for q, b in f.items()):
            continue
        score, _, left, right = min((10**6 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k, f[lang, *p[:k]], f[lang, *p[k:]]) for k in range(1, len(p)))
        found[lang].append((-score, -a, " ".join(p).encode(), left, right))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, all_of in found.items() for i, (s, a, p, left, right) in enumerate(sorted(all_of)[:top])}


@pytest.mark.parametrize("budget", [10**6, 60, 5])
def test_collocations_by_hand(spark, budget):
    rng = random.Random(2)
    words = ["The", "a", "é\u0085b", "x\xa0", "…", "longer", "of", "Ω"]
    rows = [(i, "".join(rng.choice(words[: 2 + i % 7]) + rng.choice([" ", " ", "\t", ", ", "\n", "  "]) for _ in range(40)), rng.choice(["en", "en", "de", None]), None, None) for i in range(60)]
    rows += [(None, "the same line again", "en", None, None)] * 40 + [(1, "a a a a a a", "de", None, None)] * 9
    got = [tuple(r) for r in phrases.collocations(spark.createDataFrame(rows, DOCS), least=4, top=50, budget=budget).collect()]
    assert len(got) == len(set(got)) and set(got) == counted(rows, 4, 50)


def test_collocations_of_awkward_texts(spark, awkward):
    got = {tuple(r) for r in phrases.collocations(awkward).collect()}
    assert got == counted(AWKWARD, 10, 2000)
    assert phrases.collocations(awkward.limit(0)).count() == 0


def test_a_text_may_be_cut_anywhere(monkeypatch):
    monkeypatch.setattr(phrases, "AT_ONCE", 3)
    held, whole = phrases.Leaves(), phrases.Leaves()
    held.add("one two, three  four\nfive six seven")
    monkeypatch.setattr(phrases, "AT_ONCE", 1 << 20)
    whole.add("one two, three  four\nfive six seven")
    assert [x for x in held.leaves()[0].T.tolist()] == [x for x in whole.leaves()[0].T.tolist()]


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(999_999_999_989, 999_999_999_999, 999_999_999_990)], "a long, l long, r long")
    assert row.select(phrases._score(F.col("l"), F.col("r"))).first()[0] == 10**6 * 999_999_999_989**2 // (999_999_999_999 * 999_999_999_990)


# cuts, clashes and memory of the other operators
def test_mixture_gives_way_to_names_in_any_case(spark):
    from tallyforge.llm import mixing, queries

    rows = spark.createDataFrame([(1, "a b c", "en", "src1", 5), (2, "d e", "de", "src0", 3)], DOCS).select("*", F.lit(9).alias("Epoch"), F.lit(8).alias("N_Tokens"), F.lit(7).alias("MIX_lang"))
    got = mixing.mixed(rows, queries.mixing_levels(), queries.WEIGHTS, share=(1, 1))
    assert [c.lower() for c in got.columns].count("epoch") == [c.lower() for c in got.columns].count("mix_lang") == 1
    found = got.collect()
    assert found and all(r["n_tokens"] in (2, 3) and r["epoch"] < 4 and r["mix_lang"] in ("en", "de") for r in found)


def test_long_candidates_stay_whole():
    from tallyforge.llm import pii

    secret, number = "aB3" * 4000, "12 " * 300 + "1"
    text = f"password = {secret}; call {number} or {'n' * 5000}@{'h' * 5000}.org or {'n' * 90} [at] {'h' * 90} [dot] {'o' * 90}"
    found = {(k, text[s:e]) for k, s, e in pii.proposals(text)}
    assert ("secret", secret) in found and ("number", number) in found
    assert ("contact", f"{'n' * 5000}@{'h' * 5000}.org") in found and ("contact", f"{'n' * 90} [at] {'h' * 90} [dot] {'o' * 90}") in found
    assert pii.around_at("@ a@ @b a@b@c x[at]y[dot]z xx(at)yy(dot)zz xx [at]yy [dot]zz") == [(8, 11), (27, 42), (43, 60)]
    pii.proposals("x" * 3_000_000 + "@" * 1000 + "[at]" * 100_000)  # linear


def test_languages_of_long_texts_have_no_cuts(monkeypatch):
    from tallyforge.llm import langid

    text = "Ünder the öak, 12 women. " * 50
    whole = langid.counted(text)
    monkeypatch.setattr(langid, "STRETCH", 7)
    assert (langid.counted(text) == whole).all() and langid.counted("").sum() == 0


def test_long_benchmark_items_take_little_room():
    import tracemalloc

    from tallyforge.llm import decontam

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(4000)]
    item = [rng.choice(words) for _ in range(20_000)]
    short = [rng.choice(words) for _ in range(12)]
    items = decontam.prepared(["long", "short"], [" ".join(item), " ".join(short)])
    texts = [" ".join(rng.choices(words, k=6)) for _ in range(511)] + ["x y " + " ".join(short[:5] + short[6:]) + " z"]
    tracemalloc.start()
    found = decontam.matches(texts, items)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(511, 0, 1)] and items.names[0] == "short" and peak < 100e6


def test_items_are_not_matched_across_texts():
    from tallyforge.llm import decontam

    rng = random.Random(9)
    item = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(200)]
    items = decontam.prepared(["i"], [" ".join(item)])
    halves = [" ".join(item[:100]), " ".join(item[100:]), " ".join(item[:3] + item[5:])]
    assert decontam.matches(halves, items) == [(2, 0, 2)]


# license templates of few words
def test_short_license_templates_are_found(spark, awkward):
    from tallyforge.llm import license_scan

    templates = {"one": "WTFPL", "two": "public domain", "four": "All rights reserved, 2020", "none": "...", "long": license_scan.TEMPLATES["CC-BY-4.0"]}
    texts = ["wtfpl", "In the PUBLIC--domain; public domain", "x all rights reserved 2020 y", "all rights reserved 2021", license_scan.TEMPLATES["CC-BY-4.0"] + " WTFPL", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["license_id"], r["first_word"], r["containment"]) for r in license_scan.scan(df, templates).collect()}
    assert got == {(0, "one", 0, 1.0), (1, "two", 2, 1.0), (2, "four", 1, 1.0), (4, "long", 0, 1.0), (4, "one", 13, 1.0)}
    assert license_scan.scan(awkward, {"s": "cat"}).select("doc_id").collect() == [(None,)]


def test_license_bands_hold_their_miss_at_the_least_containment():
    from tallyforge.llm import license_scan

    rng, missed, cases = np.random.default_rng(3), 0, 4000
    masks = np.array(license_scan._MASKS, np.int64)
    for piece in (5, 6, 7):
        kept = -(-4 * piece // 5)
        own, seen = rng.integers(-(2**63), 2**63, (cases, 9 - kept)), rng.integers(-(2**63), 2**63, (cases, piece))
        window = np.concatenate([own, seen[:, :kept]], axis=1)
        of = masks[: license_scan.bands_for(piece)]
        hit = ((window[:, :, None] ^ of).min(1) == (seen[:, :, None] ^ of).min(1)).any(1)
        missed += int((~hit).sum())
    assert missed <= 3 * cases * license_scan.MISS

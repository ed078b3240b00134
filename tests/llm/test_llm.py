"""The corpus operators against brute force, round trips and held-out accuracy, with the awkward cases of each."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyforge.llm import components, decontam, langid, license_scan, media, mixing, ngram_join, pii, quality, queries, shared, tokens, warc
from tallyforge.llm.shared import BATCH, BATCH_BYTES, CLEANUP, arrow_map, id_bucket, table, written

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "the cat", "en", "s", 7), (2, "", "en", "s", 0), (3, "  \n ", "en", None, 4), (4, "ünï " * 30000, "de", "s", 1), (5, "123 %%%", "en", "s", 7)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, DOCS).select("*", F.lit(1).alias("n"), F.lit("x").alias("id"), F.lit(2).alias("score"))


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").cache()


def vocabulary(seed=0, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n)]


# token counts
def test_tokens_equal_the_library(spark, docs, awkward):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(["a<|endoftext|>b", "ΣΑΣ İstanbul é ​½²ªº中文😀", "it's'sWE'VE", "x" * 70000, "a\x1cb\u0085c", "<|startoftext|><|endoftext|", "ß×÷ÀÉ  12345"])], DOCS)
    for df in (docs, odd, awkward.select(*docs.columns)):
        for r in tokens.token_counts(df, path).withColumnRenamed("doc_id", "i").join(df, F.col("i").eqNullSafe(F.col("doc_id"))).select("text", "n_tokens", "n_bytes", "over_limit").collect():
            text = r["text"] or ""
            n = len(tok.encode(text, add_special_tokens=False).ids)
            assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 2048)


# language ID
def test_languages(spark, docs, awkward):
    model = langid.learn(docs, id_bucket(F.col("doc_id"), 4) != 2)
    r = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(id_bucket(F.col("doc_id"), 4) == 2)
    assert r.where("lang = lang_pred").count() >= 0.95 * r.count()
    got = {(x["doc_id"], x["lang_pred"]) for x in langid.identify(awkward, model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (5, "und"), (None, "en")} <= got
    assert langid.identify(awkward, langid.learn(docs.limit(0), F.lit(True))).where("lang_pred <> 'und'").count() == 0
    assert langid.with_language(awkward, model).columns == awkward.columns


def test_mixture_finds_both_languages(spark, docs):
    names, logs = langid.learn(docs, F.lit(True))
    part = {k: " ".join(r["text"] for r in docs.where(F.col("lang") == k).orderBy("doc_id").limit(4).collect())[:6000] for k in ("de", "fr")}
    _, _, weights = langid.mixture(part["de"] + " " + part["fr"], names, logs, np.exp(logs))
    got = dict(zip(names, weights))
    assert 0.3 < got["de"] < 0.7 and 0.3 < got["fr"] < 0.7 and got["de"] + got["fr"] > 0.95


def test_pipeline_keeps_texts_in_three_languages(spark, sf_dir, docs):
    parts = [" ".join(r["text"] for r in docs.where(F.col("lang") == k).orderBy("doc_id").limit(4).collect())[:6000] for k in ("de", "fr", "en")]
    text = " ".join(parts)
    assert max(langid.mixture(text, *(m := langid.learn(docs, F.lit(True))), np.exp(m[1]))[2]) < 0.5
    now = docs.unionByName(spark.createDataFrame([(10**9, text, None, None, len(text))], DOCS))
    assert corpus_pipeline.language(spark, now, sf_dir).where(F.col("doc_id") == 10**9).count() == 1


def test_em_reaches_the_best_likelihood_within_its_bound():
    rng = np.random.default_rng(4)
    grid = np.array([(i, j, 40 - i - j) for i in range(41) for j in range(41 - i)]) / 40
    for _ in range(20):
        p = rng.dirichlet(np.full(60, 0.3), 3).T + 1e-6
        n = rng.multinomial(400, (p / p.sum(0)) @ rng.dirichlet(np.full(3, 0.4))).astype(float)
        _, reached, bound = langid.proportions(n, p)
        best = max(float(n @ np.log(p @ w)) for w in grid)
        assert reached <= bound <= reached + 1 and best <= bound + 1e-6


def test_language_sets_equal_an_exhaustive_search(spark, docs):
    names, logs = langid.learn(docs, F.lit(True))
    probs = np.exp(logs)
    pure = {k: " ".join(r["text"] for r in docs.where(F.col("lang") == k).orderBy("doc_id").limit(3).collect())[:3000] for k in names}
    for mine in [c for size in (1, 2, 3) for c in itertools.combinations(names, size)]:
        text = " ".join(pure[k] for k in mine)
        n = langid.counted(text)
        at = np.flatnonzero(n)
        cost = langid.OVERLAP * np.log(n.sum())
        value = {c: langid.proportions(n[at].astype(float), probs[at][:, [names.index(k) for k in c]])[1] - cost * (len(c) - 1) for size in range(1, len(names) + 1) for c in itertools.combinations(names, size)}
        top = max(value, key=value.get)
        assert {k for k, w in zip(names, langid.mixture(text, names, logs, probs)[2]) if w > 0} == set(top) == set(mine)


def test_more_labels_than_the_model_holds(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    names, _ = langid.learn(docs, F.lit(True))
    sizes = sorted(((-r["count"], r["lang"]) for r in docs.where("lang is not null").groupBy("lang").count().collect()))
    assert names == sorted(k for _, k in sizes[:2])


# quality
def test_quality(spark, sf_dir, docs, awkward):
    """Accuracy on labelled rows that were not learned from."""
    labels = table(spark, sf_dir, "labels")
    model = quality.learn(docs, labels, id_bucket(F.col("doc_id"), 3) != 1)
    r = quality.score(docs, model).join(labels, "doc_id").where(id_bucket(F.col("doc_id"), 3) == 1)
    assert r.count() > 20 and r.where("predicted = quality").count() >= 0.9 * r.count()
    got = quality.score(awkward, model)
    assert got.count() == len(AWKWARD) and got.where("score between 0 and 1 and predicted = (case when score >= 0.5 then 1 else 0 end)").count() == len(AWKWARD)
    assert quality.score(docs.limit(0), quality.learn(docs.limit(0), labels, F.lit(True))).count() == 0


def test_quality_is_fitted_on_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append(sorted(texts)))
    texts = ["word %d " % i * (4000 if i % 3 == 0 else 40) for i in range(12)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    quality.learn(docs, labels, F.lit(True))
    monkeypatch.setattr(quality, "FIT_BYTES", 1)
    quality.learn(docs, labels, F.lit(True))
    whole = [t.encode() for t in texts]
    assert seen[0] == sorted(whole) and len(seen[1]) == 2 and set(seen[1]) <= set(whole)


def test_slabs_give_the_same_maxima():
    table_ = np.random.default_rng(0).normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32)
    raw = quality.as_bytes("abc déf " * 20000)
    whole = quality.responses(raw, table_).reshape(-1, quality.BLOCK, quality.FILTERS).max(1)
    assert np.array_equal(whole, quality.block_maxima(raw, table_))


# media
def test_media_round_trip(spark, docs, awkward):
    for df in (docs, awkward):
        got = media.media_columns(df)
        assert got.count() == df.count()
        for r in got.withColumnRenamed("doc_id", "i").join(df.select("doc_id", "text"), F.col("i").eqNullSafe(F.col("doc_id"))).collect():
            p = media.payload_of(r["text"])
            assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
            assert len(p) % 576 == 0 and p and r["media_sha256"] == hashlib.sha256(media.encode(p)).hexdigest() and media.decode(media.encode(p)) == p


def test_shards_are_tar_files_and_headers_suffice(spark, docs, tmp_path):
    index = media.store(docs, where=f"file://{tmp_path}")
    rows = index.collect()
    assert len({r["text_key"] for r in rows}) == len(rows) == docs.select("text").distinct().count()
    for shard in {r["shard"] for r in rows}:
        raw = (tmp_path / shard).read_bytes()
        names = media.members(raw)
        for r in rows:
            if r["shard"] == shard:
                assert raw[r["offset"] : r["offset"] + r["length"]] == names[f"{r['digest']}.png"]
    head = media.metadata(index).first()
    assert head["width"] == media.ROW and head["bits"] == 8
    assert media.store(docs.limit(0)).count() == 0


# WARC
def test_warc(spark, sf_dir, tmp_path):
    import zstandard

    pages = table(spark, sf_dir, "pages")
    more = pages.union(pages.where("page_id < 30").withColumn("page_id", F.col("page_id") + 10**6)).union(spark.createDataFrame([(None, None, None), (7, None, None), (8, "a\r\nb", ""), (8, "a\r\nb", "")], pages.schema)).withColumn("payload", F.lit(1))
    rows = more.collect()
    top = {}
    for r in rows:
        if r["page_id"] is not None:
            top[r["html"] or ""] = max(top.get(r["html"] or "", -1), r["page_id"])
    want = sorted(str((r["page_id"], len((r["html"] or "").encode()), warc.digest_of((r["html"] or "").encode()), *(("revisit", top[r["html"] or ""]) if r["page_id"] is not None and r["page_id"] < top[r["html"] or ""] else ("response", None)))) for r in rows)
    index = warc.write(more, where=f"file://{tmp_path}")
    assert sorted(str(tuple(r)) for r in warc.read(index).collect()) == want
    for path in tmp_path.glob("*.zst"):  # any reader of the format can decompress the whole
        with zstandard.ZstdDecompressor().stream_reader(path.read_bytes(), read_across_frames=True) as f:
            plain = f.read()
        assert plain.startswith(b"WARC/1.1\r\n") and plain.count(b"WARC-Record-ID") == index.where(F.col("bundle") == path.name).count()
    assert warc.archive(pages.limit(0)).count() == 0


def test_warc_ids_of_any_text(spark):
    ids = ["", "a\r\nb", "c d<>%0D", "é", None, "plain"]
    pages = spark.createDataFrame([(i, None, "same" if i in ("", "plain") else f"html {i}") for i in ids], "page_id string, url string, html string")
    got = {(r["page_id"], r["record_type"], r["refers_to"]) for r in warc.archive(pages).collect()}
    assert got == {(i, "revisit", "plain") if i == "" else (i, "response", None) for i in ids}


# PII
def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_spans_equal_the_plain_patterns(docs):
    rng = random.Random(2)
    texts = [r["text"] for r in docs.select("text").collect()] + ["".join(rng.choices("ab1290.@+-() %_é\n", k=rng.randint(0, 60))) for _ in range(20000)] + ["a@b@c.d@e.f 1.2.3.4.5.6.7.8 001.2.3.4 0000000001.1.1.1 256.1.1.1", "4111 1111-1111 1111", "+1 (234) 567-8901x"]
    for t in texts:
        assert pii.base_spans(t) == brute_base(t), t


def test_pii(spark, docs, awkward):
    model = pii.learn(docs)
    text = 'mail a.b@c.example.com token = "3f786850e387550fdab836ed7e6dc881de23001b" card 4111111111111111 end'
    one = spark.createDataFrame([(9, text, "en", "s", len(text))], DOCS)
    r = pii.find(one, model).first()
    assert (r["n_email"], r["n_card"]) == (1, 1) and "c.example" not in r["redacted"] and "4111" not in r["redacted"] and r["redacted"].endswith("end")
    got = pii.find(awkward, model)
    assert got.count() == len(AWKWARD) and got.where("doc_id = 1").first()["redacted"] is None and got.where("doc_id = 1").first()["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = pii.redact(awkward, model)
    assert clean.columns == awkward.columns and clean.where("doc_id = 4").first()["text"] == AWKWARD[5][1]
    assert pii.learn(docs.limit(0)) == {"trees": [], "cut": {}}


def pii_texts(rng, n):
    """Texts with their spans to find, and clean numbers, addresses without a domain and long words between them."""
    for i in range(n):
        digits = lambda k: "".join(rng.choices("0123456789", k=k))
        name = lambda k: "".join(rng.choices("abcdefghijklmnop", k=k))
        secret = "".join(rng.choices("ABCDEFGHabcdefgh" + "23456789" * (i % 2), k=24))
        contact, phone = f"{name(6)} [at] {name(7)} [dot] org", f"0{digits(3)} {digits(7)}"
        yield f"see {contact} or tel {phone} with password = {secret} end", [contact, phone, secret]
        yield f"isbn {digits(13)} at {digits(10)} of {name(5)}@{name(4)} and {name(20)} {name(16)} end", []
        yield f"{name(5)}@{name(5)}.com and +1 {digits(10)} end", []


def test_pii_precision_and_recall_by_kind(spark):
    """On texts that were not learned from; clean numbers and long words stay."""
    rows = [(i, t, None, None, None) for i, (t, _) in enumerate(pii_texts(random.Random(1), 300))]
    model = pii.learn(spark.createDataFrame(rows, DOCS))
    assert set(model["cut"]) == {"contact", "number", "secret"}
    found, want = set(), set()
    for i, (t, spans) in enumerate(pii_texts(random.Random(2), 300)):
        kinds = dict(zip(spans, ("contact", "number", "secret")))
        want |= {(i, kinds[s], s) for s in spans}
        found |= {(i, k, t[a:b]) for k, a, b in pii.added_spans([t], [pii.base_spans(t)], model)[0]}
    for kind in ("contact", "number", "secret"):
        f, w = {x for x in found if x[1] == kind}, {x for x in want if x[1] == kind}
        assert len(f & w) >= 0.97 * len(w) and len(f & w) >= 0.97 * len(f), kind


def test_spans_by_order_equal_all_comparisons():
    rng = random.Random(6)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 30)) for a in (rng.randrange(200) for _ in range(rng.randrange(12)))]
        taken = pii.Taken(spans)
        for start in range(0, 200, 7):
            end = start + rng.randint(1, 25)
            assert taken.shared(start, end) == max((min(end, e) - max(start, s) for s, e in spans if s < end and e > start), default=0)


def test_added_spans_of_a_long_text_are_apart_and_quick(spark):
    model = pii.learn(spark.createDataFrame([(i, t, None, None, None) for i, (t, _) in enumerate(pii_texts(random.Random(1), 100))], DOCS))
    text = " ".join(t for t, _ in pii_texts(random.Random(4), 8000))
    base = pii.base_spans(text)
    spans = sorted(s[1:] for s in pii.added_spans(["see a@b ", text], [[], base], model)[1])
    assert len(spans) > 10000 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    apart = pii.Taken(spans)
    assert not any(apart.shared(s, e) for _, s, e in base)


def test_pii_thresholds_see_all_texts(spark):
    """A kind in two of many texts, with a sample that is far smaller, is still found."""
    rows = [(i, t, None, None, None) for i, (t, spans) in enumerate(pii_texts(random.Random(3), 900)) if not spans]
    for i in (1, 2):
        rows.append((10**6 + i, f'token = "{"3f786850e387550f" * 2}{i}" end', None, None, None))
    assert "secret" in pii.learn(spark.createDataFrame(rows, DOCS), fit_rows=40)["cut"]


# n-gram join
def brute_groups(texts, size, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    have = defaultdict(list)
    for i, s in sets.items():
        count = defaultdict(int)
        for g in s:
            for j in have[g]:
                count[j] += 1
            have[g].append(i)
        for j, o in count.items():
            if 100 * o >= percent * (len(s) + len(sets[j]) - o):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize("size,percent", [(3, 90), (5, 80), (1, 50)])
def test_groups_equal_brute_force(spark, size, percent, monkeypatch):
    """Clouds of copies with one to many changed words, so that similarities fall on both sides of the threshold; small groups
    are forced through the block comparison too."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 7)
    rng, words, texts = random.Random(size), vocabulary(), []
    for base in range(25):
        w = rng.choices(words, k=rng.choice([1, 2, 4, 9, 20, 45, 150, 400]))
        for _ in range(rng.choice([1, 3, 12, 40])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12])):
                at = rng.randrange(len(v) + 1)
                v[at : at + rng.choice([0, 1])] = rng.choices(words, k=rng.choice([0, 1]))
            texts.append((len(texts) * 7 % 9973, " ".join(v)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in texts], DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df, size, percent).collect()}
    assert got == brute_groups(texts, size, percent)


def test_groups_of_awkward_rows(spark, awkward):
    got = sorted(str(tuple(r)) for r in ngram_join.similar_groups(awkward).collect())
    assert got == sorted(map(str, [(1, 0, 1), (2, 0, 2), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 5), (None, 1, None)]))
    assert ngram_join.similar_groups(awkward.limit(0)).count() == 0


def test_written_tables_leave_the_setting_and_the_frame_usable(spark):
    before = spark.conf.get(CLEANUP)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    assert df.count() == 7
    first, second = written(df, "t"), written(df, "t")
    assert spark.conf.get(CLEANUP) == before
    assert sorted(first.collect()) == sorted(second.collect()) == sorted(df.collect())
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        written(df.select(F.expr("raise_error('DIVIDE_BY_ZERO')").alias("x")), "t")
    assert spark.conf.get(CLEANUP) == before


def test_texts_under_one_id_are_different_documents(spark, sf_dir):
    rng, words = random.Random(8), vocabulary(8)
    a, b, c = (" ".join(rng.choices(words, k=60)) for _ in range(3))
    rows = [(2, a, None, None, 1), (2, b, None, None, 2), (2, a, None, None, 3), (1, b + " more", None, None, 4), (None, c, None, None, 5), (None, c, None, None, 6), (None, a, None, None, 7), (None, None, None, None, 8)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("row_key", "Mark_0", "mark_1")})
    out = corpus_pipeline.near_duplicates(spark, df, sf_dir)
    assert out.columns == df.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in out.collect()) == sorted(map(str, [(2, a), (1, b + " more"), (None, c), (None, None)]))


def test_sets_that_share_half_a_digest_are_told_apart(spark):
    sets = spark.createDataFrame([(1, 7, 70), (2, 7, 70), (3, 8, 80), (4, 7, 71), (5, None, None)], "id long, node long, rest long")
    assert ngram_join._shared_halves(sets) == {7}
    a = np.arange(5, dtype=np.uint64)
    first, second = ngram_join._digest(a)
    assert ngram_join._node(a, frozenset()) == first and ngram_join._node(a, frozenset([first])) == second != first


def test_groups_of_equal_members_become_one(spark):
    rows = [(g, n, 5) for g in (1, 2, 3) for n in (10, 11)] + [(4, 10, 5), (4, 12, 5), (5, 10, 5), (5, 11, 5), (5, 12, 5)]
    got = ngram_join._distinct_groups(spark.createDataFrame(rows, "g long, node long, n long")).collect()
    assert sorted((r["g"], r["node"], r["w"]) for r in got) == [(1, 10, 3), (1, 11, 3), (4, 10, 1), (4, 12, 1), (5, 10, 1), (5, 11, 1), (5, 12, 1)]


def test_linked_pairs_share_half_of_the_sure_segments():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90):
        for _ in range(400):
            n = int(rng.integers(2, 600))
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            n, d = len(a), int(rng.integers(0, ngram_join.differing(len(a), percent) + 1))
            drop = int(rng.integers(0, d + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 2**64, d - drop, np.uint64)]))
            both = len(np.intersect1d(a, b))
            if not d or 100 * both < percent * (len(a) + len(b) - both):
                continue
            ka, kb = ngram_join.segment_keys(a, percent), ngram_join.segment_keys(b, percent)
            cut = ngram_join.level(min(len(a), len(b)), percent)
            shared = np.sum((np.intersect1d(ka, kb) & np.uint64(63)) == cut)
            assert shared >= max(1, -(-max(ngram_join.sure(len(x), cut, percent) for x in (a, b)) // 2))


def test_the_driver_gets_no_row_for_each_text(spark, monkeypatch):
    """Which texts are compared reaches the driver as bits, not as rows."""
    rng, words = random.Random(5), vocabulary()
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(200)]
    df = spark.createDataFrame([(2 * i + j, t + " again" * j, None, None, None) for i, t in enumerate(texts) for j in (0, 1)], DOCS)
    kind, sizes = type(df), []
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: sizes.append(len(rows := collect(self))) or rows)
    found = ngram_join.similar_groups(df, 3, 90)
    assert sizes and max(sizes) <= ngram_join.RESIDUES // 32768
    monkeypatch.undo()
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {i: i - i % 2 for i in range(400)}


def test_residues_as_bits(spark):
    want = [0, 1, 7, 8, 32767, 32768, 65535, 65536, ngram_join.RESIDUES - 1, 7]
    got = ngram_join._bits(spark.createDataFrame([(r,) for r in want], "r int"))
    assert np.flatnonzero(np.unpackbits(got, bitorder="little")).tolist() == sorted(set(want))
    assert len(got) * 8 == ngram_join.RESIDUES
    assert not ngram_join._bits(spark.createDataFrame([], "r int")).any()


def test_sets_are_not_repeated_in_a_broadcast(spark, monkeypatch):
    """Sets that are repeated for each block look small to Spark; they must not go through the driver."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    now = spark.createDataFrame([(1, s, 8, 1, s) for s in range(40)], "g long, node long, n long, w long, comp long")
    segments = spark.createDataFrame([(s, f, [f * 10 + (s // 2 if f == 7 else 0)]) for s in range(40) for f in range(8)], "node long, fragment int, segment array<long>")
    links = ngram_join._block_links(now, written(segments, "segments"), 90)
    plan = links._jdf.queryExecution().sparkPlan().toString()
    assert "explode" not in plan and plan.count("Join") >= 2
    assert {tuple(sorted(r)) for r in links.collect()} == {(s, s + 1) for s in range(0, 40, 2)}


def test_blocks_cover_all_pairs_and_follow_no_chains(spark, monkeypatch):
    """Pairs of sets in one group and different components are compared; blocks that only a chain of groups joins are not."""
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 10)
    rng = random.Random(3)
    chain = [(g, 19 * g + s) for g in range(40) for s in range(20)]
    some = [(1000 + g, s) for g in range(12) for s in rng.sample(range(2000, 2060), rng.choice([5, 18, 40]))]
    comp = {s: s if s < 2000 else s % 7 for _, s in chain + some}
    now = spark.createDataFrame([(g, s, 30, 1, comp[s]) for g, s in chain + some], "g long, node long, n long, w long, comp long")
    sets, parts = ngram_join._blocks(now)
    block, pairs = {r["node"]: r["block"] for r in sets.collect()}, [(r["a"], r["b"]) for r in parts.collect()]
    assert len(set(pairs)) == len(pairs) and set(block) == set(comp)
    groups = defaultdict(list)
    for g, s in chain + some:
        groups[g].append(s)
    for own in groups.values():
        for x, y in itertools.combinations(own, 2):
            assert comp[x] == comp[y] or {(block[x], block[y]), (block[y], block[x])} & set(pairs)
    long = {block[s] for _, s in chain}
    assert len([p for p in pairs if p[0] in long]) <= 8 * len(long)
    in_part = Counter((r["a"], r["part"]) for r in parts.collect())
    held = Counter(block.values())
    assert all(sum(held[r["b"]] for r in parts.collect() if (r["a"], r["part"]) == key) <= 10 + max(held.values()) for key in list(in_part)[:40])


def test_written_tables_broadcast_small_tables_only(spark, monkeypatch):
    """A side of a join goes through the driver up to BROADCAST_BYTES of files, unless the caller has set a size."""
    few = written(spark.range(3000).select(F.xxhash64("id").alias("id")), "few")

    def joined() -> str:
        written(spark.range(10**6).select(F.xxhash64("id").alias("id")).join(few, "id"), "joined")
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return str(spark._jsparkSession.sharedState().statusStore().executionsList().last().physicalPlanDescription())

    assert "BroadcastExchange" in joined()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 10000)
    assert shared.BROADCAST not in spark.conf.getAll and "BroadcastExchange" not in joined()
    assert shared.BROADCAST not in spark.conf.getAll
    spark.conf.set(shared.BROADCAST, "1m")
    try:
        assert "BroadcastExchange" in joined() and spark.conf.get(shared.BROADCAST) == "1m"
    finally:
        spark.conf.unset(shared.BROADCAST)


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(50, 51), (60, 60)], "a long, b long")
    got = {r["id"]: r["comp"] for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 1), 50: 50, 51: 50, 60: 60}


# decontamination
def test_decontamination_recall_and_precision(spark, sf_dir):
    bench = table(spark, sf_dir, "benchmark").collect()
    items = decontam.prepared([r["item_id"] for r in bench], [r["text"] for r in bench])
    rng, words = random.Random(5), vocabulary(1, 3000)
    for rate, least in ((0.0, 1.0), (0.1, 0.99), (0.2, 0.9)):
        texts, want = [], []
        for r in bench * (1 if rate == 0 else 3):
            w = r["text"].split()
            for _ in range(decontam.allowed(len(decontam.words_of(r["text"])) * rate / decontam.EDITS if rate else 0)):
                at = rng.randrange(len(w))
                w[at : at + rng.choice([0, 1, 1])] = rng.choices(words, k=rng.choice([0, 1]))
            texts.append(" ".join(rng.choices(words, k=40) + w + rng.choices(words, k=40)))
            want.append(r["item_id"])
        found = {(t, items.names[i]) for t, i, _ in decontam.matches(texts, items)}
        assert sum((t, i) in found for t, i in enumerate(want)) >= least * len(want)
    assert decontam.matches([" ".join(rng.choices(words, k=300)) for _ in range(200)], items) == []


@pytest.mark.parametrize("kind", ["insertions", "deletions"])
@pytest.mark.parametrize("n", [100, 200, 400])
def test_decontamination_recall_of_long_items(n, kind):
    """Edits of one kind, as many as are allowed, anywhere in long items."""
    rng, words = random.Random(n), vocabulary(1, 3000)
    known = [rng.choices(words, k=n) for _ in range(40)]
    items, texts = decontam.prepared(list(range(40)), [" ".join(w) for w in known]), []
    for w in map(list, known):
        for _ in range(decontam.allowed(n)):
            at = rng.randrange(len(w))
            w[at : at + (kind == "deletions")] = rng.choices(words, k=1) if kind == "insertions" else []
        texts.append(" ".join(rng.choices(words, k=40) + w + rng.choices(words, k=40)))
    found = {(t, items.names[i]) for t, i, _ in decontam.matches(texts, items)}
    assert found == {(t, t) for t in range(40)}


def test_decontamination_names_the_text_that_holds_the_item():
    """An item at the very start of a text is not laid to the text before it."""
    rng, words = random.Random(9), vocabulary(1, 3000)
    known = [" ".join(rng.choices(words, k=n)) for n in range(20, 100)]
    items = decontam.prepared(list(range(80)), known)
    texts = [t for w in known for t in ("a clean text", w)]
    assert [(t, items.names[i], d) for t, i, d in decontam.matches(texts, items)] == [(2 * i + 1, i, 0) for i in range(80)]


def brute_distance(text, item):
    best = [0] * (len(text) + 1)
    for i, w in enumerate(item):
        row = [i + 1]
        for j, v in enumerate(text):
            row.append(min(best[j] + (w != v), best[j + 1] + 1, row[j] + 1))
        best = row
    return min(best)


def test_decontamination_equals_brute_force(spark, sf_dir, docs, awkward):
    bench = table(spark, sf_dir, "benchmark")
    items = [(r["item_id"], decontam.words_of(r["text"]).tolist()) for r in bench.collect()]
    some = docs.where(F.length("text") < 2500)
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in decontam.contaminated(some, bench).collect()}
    want = {}
    for r in some.collect():
        words = decontam.words_of(r["text"]).tolist()
        known = set(words)
        for i, item in items:
            if sum(w in known for w in item) >= len(item) - decontam.allowed(len(item)) and (d := brute_distance(words, item)) <= decontam.allowed(len(item)):
                want[r["doc_id"], i] = d
    assert got == want
    assert decontam.contaminated(awkward, bench).count() == 0 and decontam.clean(awkward, bench.limit(0)).count() == len(AWKWARD)
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_of_short_items_and_whole_number_ids(spark, monkeypatch):
    bench = spark.createDataFrame([(1, "Alpha beta, gamma delta"), (2, "omega"), (3, ""), (4, None), (5, "one two three four five six seven")], "item_id int, text string")
    df = spark.createDataFrame([(1, "x alpha BETA gamma delta y", None, None, 0), (2, "alpha beta gamma", None, None, 0), (3, "omega", None, None, 0), (4, "one two three five six seven", None, None, 0), (5, None, None, None, 0)], DOCS)
    want = [(1, 1, 0, 4), (3, 2, 0, 1), (4, 5, 1, 7)]
    assert sorted(map(tuple, decontam.contaminated(df, bench).collect())) == want
    monkeypatch.setattr(decontam, "ITEM_CHARS", 10)  # a pass for each few items
    assert sorted(map(tuple, decontam.contaminated(df, bench).collect())) == want
    assert sorted(r["doc_id"] for r in decontam.clean(df, bench).collect()) == [2, 5]


# license scan
def test_license_scan_equals_brute_force(spark, monkeypatch):
    """All containments of 0.8 or more of templates with gaps and edits, in several parts."""
    rng, words = random.Random(11), vocabulary(3, 2000)
    templates = {f"t{i}": " ".join(rng.choices(words, k=rng.choice([5, 7, 9, 12, 30, 90, 400]))) for i in range(60)}
    texts = []
    for i in range(400):
        w = templates[f"t{rng.randrange(60)}"].split()
        for _ in range(rng.choice([0, 1, 2, len(w) // 30, len(w) // 15])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1, 2])] = rng.choices(words, k=rng.choice([0, 1, 3]))
        texts.append(" ".join(rng.choices(words, k=rng.randrange(60)) + w * rng.choice([1, 1, 2]) + rng.choices(words, k=rng.randrange(60))))
    shingled = lambda t: [tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)]
    known, want = {k: set(shingled(t)) for k, t in templates.items()}, {}
    for i, t in enumerate(texts):
        have = shingled(t)
        for k, s in known.items():
            if s and len(m := s & set(have)) >= 0.8 * len(s):
                want[i, k] = (len(m), next(j for j, x in enumerate(have) if x in s))
    monkeypatch.setattr(license_scan, "PART_CHARS", 10_000)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {(r["doc_id"], r["license_id"]): (r["matched"], r["first_word"]) for r in license_scan.scan(df, templates).collect()}
    assert set(got) <= set(want) and all(want[k] == v for k, v in got.items())
    assert len(got) >= 0.998 * len(want)


def test_license_scan(spark, awkward):
    rng, words = random.Random(4), vocabulary(2, 2000)
    texts, want = [], set()
    for i in range(120):
        name, notice = rng.choice(sorted(license_scan.TEMPLATES.items()))
        w = notice.split()
        if len(w) > 30 and i % 2:
            at = rng.randrange(len(w))
            w[at] = "changed"
        texts.append((i, " ".join(rng.choices(words, k=50) + w + rng.choices(words, k=50)).upper() if i % 3 else notice, None, None, None))
        want.add((i, name))
    df = spark.createDataFrame(texts, DOCS)
    got = {(r["doc_id"], r["license_id"]) for r in license_scan.scan(df).collect()}
    assert want <= got
    plan = license_scan.scan(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert license_scan.scan(awkward).count() == 0 and license_scan.scan(df, {}).count() == 0 and license_scan.scan(df, {"short": "too few words"}).count() == 0


@pytest.mark.parametrize("n", range(5, 11))
def test_license_bands_miss_few_verbatim_templates(n):
    """Random templates in random contexts: a window's minimum is the key of one of the template's pieces in some band."""
    rng, missed, block = random.Random(n), 0, license_scan.BLOCK
    piece = min(license_scan.PIECE, n)
    masks = license_scan._MASKS[: license_scan.bands_for(piece)]
    for _ in range(2000):
        row = [rng.randrange(-(2**63), 2**63) for _ in range(n + 24)]
        at = rng.randrange(9, 12)
        pieces = [row[at + s : at + s + piece] for s in {*range(0, n - piece + 1, piece), n - piece}]
        windows = [row[s : s + block * license_scan.SPAN] for s in range(0, len(row), block)]
        missed += not any({min(v ^ m for v in w) for w in windows} & {min(v ^ m for v in p) for p in pieces} for m in masks)
    assert missed <= 4


# mixing
def test_budgets_redistribute_among_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "x", 1000), ("b", "y", 1000)], "d string, s string, have long")
    got = {(r["d"], r["s"]): r["give"] for r in mixing.budgets(leaves, ["d", "s"], {}, 800, epochs=1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 390, ("b", "x"): 200, ("b", "y"): 200}
    got = {(r["d"], r["s"]): r["give"] for r in mixing.budgets(leaves.where("not (d = 'a' and s = 'y')"), ["d", "s"], {("b", "x"): 3}, 800, epochs=2).collect()}
    assert got == {("a", "x"): 20, ("b", "x"): 585, ("b", "y"): 195}
    assert sum(r["give"] for r in mixing.budgets(leaves, ["d", "s"], {("a",): 0}, 800).collect()) == 800


def test_mixing_awkward_rows(spark, awkward):
    rows = mixing.mixed(awkward, {"source": F.col("source")}, {}, share=(1, 1))
    assert rows.columns[: len(awkward.columns)] == awkward.columns and rows.agg(F.sum("n_tokens")).first()[0] <= 30004
    assert mixing.mixed(awkward.limit(0), {"source": F.col("source")}, {}).count() == 0
    own = ["rest", "whole", "have", "doc", "doc_key", "mix_key", "mix_n", "epoch", "n_tokens"]
    rows = mixing.mixed(awkward.select("*", *[F.lit(i).alias(c) for i, c in enumerate(own)]), {"source": F.col("source")}, {}, share=(1, 1))
    assert rows.columns == [*awkward.columns, *own[:-2], "mix_source", "n_tokens", "epoch"]
    assert all(r["rest"] == 0 and r["whole"] == 1 for r in rows.collect())


def test_mixing_equals_brute_force(spark, docs):
    """Budgets by repeated sharing, then whole epochs and a prefix of the seeded order."""
    weights = {("a",): 3, ("a", "src1"): 2}
    levels = {"half": F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"), "source": F.col("source")}
    rows = [(r["doc_id"], "a" if r["doc_id"] % 2 == 0 else "b", r["source"] or "", len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")), r["text"] or "") for r in docs.collect()]
    have = defaultdict(int)
    for _, d, s_, n, _ in rows:
        have[d, s_] += n

    def shared(budget, children):
        """children: name to (weight, most)."""
        give, open_ = {}, dict(children)
        while open_:
            total = sum(w for w, _ in open_.values())
            full = {k for k, (w, most) in open_.items() if most * total <= w * budget}
            if not full:
                return give | {k: w * budget // total for k, (w, _) in open_.items()}
            k = min(full, key=lambda k: (open_[k][1] / open_[k][0], k))
            give[k] = open_.pop(k)[1]
            budget -= give[k]
        return give

    budget = sum(have.values()) * 6 // 10
    top = shared(budget, {d: (weights.get((d,), 1), 4 * sum(n for (x, _), n in have.items() if x == d)) for d in "ab"})
    want = []
    for d in "ab":
        for s_, give in shared(top[d], {x: (weights.get((d, x), 1), 4 * n) for (y, x), n in have.items() if y == d}).items():
            if not give or not have[d, s_]:
                continue
            whole, rest, total = give // have[d, s_], give % have[d, s_], 0
            leaf = [(hashlib.md5(f"2:{whole}:{r[0]}".encode()).hexdigest(), r) for r in rows if r[1:3] == (d, s_)]
            for _, r in sorted(leaf, key=lambda x: (x[0], x[1][0])):
                total += r[3]
                want += [(r[0], e) for e in range(whole + (total <= rest))]
    got = [(r["doc_id"], r["epoch"]) for r in mixing.mixed(docs, levels, weights).collect()]
    assert sorted(got) == sorted(want)


# queries and pipeline
def test_held_out_rows_and_columns_of_queries(spark, sf_dir, docs):
    """The queries that have no SQL, against plain Python on all rows."""
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    crc = {i: zlib.crc32(str(i).encode()) for i in texts}
    for name, mod, out in (("op3_language_id", 4, 2), ("op8_quality", 3, 1)):
        got = queries.QUERIES[name](spark, sf_dir).collect()
        assert {r["doc_id"]: r["held_out"] for r in got} == {i: c % mod == out for i, c in crc.items()} and len(got) == len(texts)
        assert all(0 <= r["score"] <= 1 for r in got)
    for r in queries.QUERIES["op4_media_columns"](spark, sf_dir).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\xff" * (576 * max(1, -(-len(raw) // 576)) - len(raw))
        x = list(payload)
        mean = sum(x) / len(x)
        dev = (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5
        parts = dict(p.split("=") for p in r["feature"].split(";"))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["width"], r["height"], parts["rows"]) == (576, len(payload) // 576, str(len(payload) // 576))
        assert abs(float(parts["mean"]) - mean) < 1e-3 and abs(float(parts["dev"]) - dev) < 1e-3 and parts["bands"].count("/") == 7
    for r in queries.QUERIES["op9_pii"](spark, sf_dir).collect():
        base = brute_base(texts[r["doc_id"]] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, out = queries.QUERIES[name](spark, sf_dir), con.sql(queries.SQL[name])
    order = sorted(df.columns)
    assert order == sorted(out.columns)
    want = [dict(zip(out.columns, r)) for r in out.fetchall()]
    assert sorted(str([r[c] for c in order]) for r in df.collect()) == sorted(str([r[c] for c in order]) for r in want)


def test_pipeline_stages(spark, sf_dir, docs, awkward):
    """Each stage's rows against what its operator says about its own input; then with awkward rows added."""
    now = docs.unionByName(awkward.select(*docs.columns))
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, now, sf_dir), name)
        before, after = now.select("doc_id", "text").collect(), out.select("doc_id", "text").collect()
        if name == "near_duplicates":
            known = [((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""), r["text"]) for r in before]
            want = [i for i, (_, c) in brute_groups(known, 5, 80).items() if i == c]
            assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in after) == sorted(want)
        elif name == "language":
            kept = {r["doc_id"] for r in after}
            assert {1, 2, 3, 5} & kept == {i for i in (1, 2, 3, 5) if docs.where(F.col("doc_id") == i).count()} and len(kept) >= 0.99 * docs.count()
        elif name == "decontamination":
            hit = {r["doc_id"] for r in decontam.contaminated(now, table(spark, sf_dir, "benchmark")).collect()}
            assert {r["doc_id"] for r in before} - hit == {r["doc_id"] for r in after}
        elif name == "personal_data":
            assert len(after) == len(before) and not any(brute_base(r["text"] or "") for r in after)
        if name != "mixture":
            assert out.columns == docs.columns
        now = out
    assert now.count() > 0


def test_texts_go_to_python_in_small_batches(spark):
    """A batch of Spark's own size held all 24 MB of these texts at once, in the executor and in its Python worker."""
    own = spark.newSession()
    docs = own.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("word "), 1600).alias("text"))
    bytes_of = docs.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in bs), "n long")
    assert arrow_map(docs.select("id"), lambda b: b, "id long").count() == 3000
    sizes = [r["n"] for r in bytes_of.collect()]
    assert max(sizes) < 2 * BATCH_BYTES < sum(sizes)
    own.conf.set(BATCH, "1m")
    written(docs.limit(1), "t")
    assert own.conf.get(BATCH) == "1m"

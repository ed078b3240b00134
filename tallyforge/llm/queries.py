"""The corpus operators as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontam, langid, license_scan, media, mixing, ngram_join, packing, phrases, pii, quality, spelling, tokens, warc
from tallyforge.llm.queries_sql import license_sql, mixing_sql, phrases_sql, spelling_sql
from tallyforge.llm.shared import id_bucket, table

TOKENIZER = "word_bpe_49k.json"


#: The tree of op2_mixing: a domain for each source, and weights; a node without one has weight 1.
WEB, BOOKS = ("src0",), tuple(f"src{i}" for i in range(1, 10))
WEIGHTS = {("web",): 5, ("books",): 3, ("forum",): 2, ("web", "en"): 6, ("web", "de"): 2, ("web", "fr"): 2, ("books", "en"): 4, ("forum", "en"): 3, ("books", "en", "src1"): 3}


def mixing_levels() -> dict:
    domain = F.when(F.col("source").isin(*WEB), "web").when(F.col("source").isin(*BOOKS), "books").otherwise("forum")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in all texts."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights: 60 % of the tokens, at most four epochs."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing_levels(), WEIGHTS).select("doc_id", "mix_domain", "mix_lang", "mix_source", "n_tokens", "epoch")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; learned from those whose remainder modulo 4 is not 2."""
    docs, bucket = table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 4)
    model = langid.learn(docs, bucket != 2)
    return langid.identify(docs, model).select("doc_id", (bucket == 2).alias("held_out"), "lang_pred", "score", "weights")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as stored and read back payloads."""
    return media.media_columns(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all texts."""
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back."""
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, all documents against all items."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; learned from labelled ones whose remainder modulo 3 is not 1."""
    docs, bucket = table(spark, sf_dir, "documents"), id_bucket(F.col("doc_id"), 3)
    model = quality.learn(docs, table(spark, sf_dir, "labels"), bucket != 1)
    return quality.score(docs, model).select("doc_id", (bucket == 1).alias("held_out"), "score", "predicted")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all texts."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.learn(docs)).drop("redacted")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by 3-word shingles and a Jaccard similarity of 0.9."""
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), 3, 90)


#: Of the runs of op11's contract one in so many loses a character.
THIN = 199


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts with their variants."""
    return spelling.variants(table(spark, sf_dir, "documents"), thin=THIN)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's collocations, counted over all texts."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_mixing, op3_language_id, op4_media_columns, op5_token_counts, op6_warc, op7_decontamination, op8_quality, op9_pii, op10_ngram_jaccard, op11_spelling_variants, op12_best_fit_packing, op13_phrase_collocations)}

SQL = {
    "op1_license_scan": license_sql(license_scan.TEMPLATES),
    "op2_mixing": mixing_sql("CASE WHEN source = 'src0' THEN 'web' WHEN source IN ('" + "', '".join(BOOKS) + "') THEN 'books' ELSE 'forum' END", WEIGHTS, (6, 10), mixing.EPOCHS, 2),
    "op11_spelling_variants": spelling_sql(THIN),
    "op13_phrase_collocations": phrases_sql(),
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        t AS (SELECT html AS g, max(page_id) AS top FROM p GROUP BY html),
        d AS (SELECT p.*, top, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT) AS fives
              FROM p JOIN t ON p.html = t.g)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
               list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((fives[(i // 4 + 1)::INT] >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to
        FROM d
    """,
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS g FROM w),
        e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        r AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, p.y FROM r JOIN p ON r.y = p.x)
        SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.y) AS component_id FROM s JOIN r ON s.doc_id = r.x GROUP BY s.doc_id, len(s.g)
    """,
}

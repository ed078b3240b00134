"""Token counts (operator 5) by the whole-token shortcut.

A vocabulary string that the tokenizer is proven to encode alone as one token needs no merges: a pre-token
equal to it counts as one, whatever its characters. Only the other pre-tokens go through the merge model, once for
each distinct one that a Python worker meets.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tallyforge.llm.shared import arrow_map

#: The characters on which the fast pre-tokenizer is known to agree with the library's, and its
#: pattern on them after lower-casing (the file's own pattern with its Unicode classes written out).
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-zß-öø-ÿ0-9]+")
#: Distinct merged pre-tokens that a worker remembers, and characters that it splits at once.
REMEMBERED, AT_ONCE = 500_000, 1 << 20


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def proven_whole_tokens(path: str) -> list[tuple[str, str]]:
    """Pre-tokens that are one token whole, as the library writes them (a character a byte), each with its plain text where
    that has PLAIN characters only and is one of PIECES, else an empty one.

    This is the offline proof: each string of the vocabulary runs through the tokenizer's own normalizer, pre-tokenizer
    and merge model. At most as many as the vocabulary has, so it is safe to ship to every task.
    """
    from tokenizers import decoders

    tok, plain, suffix = _tokenizer(path), decoders.ByteLevel(), "</w>"
    whole = []
    for entry in tok.get_vocab(with_added_tokens=False):
        raw = entry.removesuffix(suffix)
        text = plain.decode([raw])
        if not entry.endswith(suffix) or tok.normalizer.normalize_str(text) != text:
            continue
        pieces = tok.pre_tokenizer.pre_tokenize_str(text)
        if len(pieces) == 1 and pieces[0][0] == raw and len(tok.model.tokenize(raw)) == 1:
            whole.append((raw, text if PLAIN.fullmatch(text) and PIECES.findall(text) == [text] else ""))
    return sorted(whole)


class Remembered(dict):
    """Tokens of a pre-token by name: 1 for the proven ones, which are there from the start; another is merged when first
    asked for."""

    def __init__(self, proven: list[str], merge):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.merge = proven, merge

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.proven) + REMEMBERED:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = self[piece] = self.merge(piece)
        return n


class PieceCounts:
    """Counts of texts: pre-tokens are found by the fast pattern where all characters are PLAIN, else by the library."""

    def __init__(self, path: str, whole: list[tuple[str, str]]):
        from tokenizers import pre_tokenizers

        self.tok = _tokenizer(path)
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.by_raw = Remembered([raw for raw, _ in whole], lambda raw: len(self.tok.model.tokenize(raw)))
        self.by_text = Remembered([text for _, text in whole if text], lambda text: sum(self.by_raw[p] for p, _ in bytes_of.pre_tokenize_str(text)))
        self.specials = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, self.specials)) or "(?!)")

    def plain(self, text: str) -> int:
        """Of a text of PLAIN characters; no pre-token holds white space, so it may be cut there."""
        total, at = 0, 0
        while at < len(text):
            end = at + AT_ONCE
            while end < len(text) and not text[end].isspace():
                end += 1
            total += sum(map(self.by_text.__getitem__, PIECES.findall(text[at:end].lower())))
            at = end
        return total

    def segment(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            return self.plain(text)
        pieces = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(text))
        return sum(self.by_raw[p] for p, _ in pieces)

    def count(self, text: str) -> int:
        """Special strings inside a text are one token each, as the library has it by default."""
        if not any(s in text for s in self.specials):
            return self.segment(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.segment, parts))


@lru_cache(maxsize=1)
def _counts(path: str, whole: tuple[tuple[str, str], ...]) -> PieceCounts:
    return PieceCounts(path, list(whole))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A NULL text counts as the empty one (0 bytes, 0 tokens); repeated rows and NULL ids are kept as they are;
    other columns are ignored. No shuffle: each task reads its rows once.
    """
    whole = docs.sparkSession.sparkContext.broadcast(tuple(proven_whole_tokens(tokenizer_path)))

    def batch(rows: pa.RecordBatch) -> pa.RecordBatch:
        counts = _counts(tokenizer_path, whole.value)
        texts = pc.fill_null(rows.column(1), "")
        n = [counts.count(t) for t in texts.to_pylist()]
        size = pc.cast(pc.binary_length(pc.cast(texts, texts.type)), pa.int64())
        return pa.RecordBatch.from_arrays([rows.column(0), size, pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), batch, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")

"""Token counts by a two-tier lookup of pre-token lengths.

The byte-level tokenizer parts a text into pre-tokens and encodes each by itself, so a text's count
is the sum over its pre-tokens. The lengths of frequent ones travel as one bounded table; a worker
encodes what is missing there once and keeps it in a bounded cache. No pre-token is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortwise.llm.arrow import map_columns

# The published pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# In these spans Python's classes of letters, digits and blanks were compared with the library's one by one.
_RARE = re.compile("[^\u0000-\u0557\u0590-\u087f\u2010-\u207f\u20a0-\ua7cd\uac00-\ud7a3\uff00-\uffef]")
LONGEST = 48  # characters of a pre-token that a table or a cache keeps


class PreTokenLengths(dict):
    """Pre-token to number of tokens; a miss is encoded, and kept if short while there is room."""

    def __init__(self, tokenizer: Tokenizer, frequent: dict[str, int], room: int) -> None:
        super().__init__(frequent)
        self.tokenizer, self.frequent, self.limit = tokenizer, frequent, len(frequent) + room

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        if len(piece) <= LONGEST:
            if len(self) >= self.limit:
                self.clear()
                self.update(self.frequent)
            self[piece] = n
        return n


def open_tokenizer(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _specials(tokenizer: Tokenizer) -> list[str]:
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def count_text(text: str, pattern, lengths: PreTokenLengths, specials: list[str]) -> int:
    """Tokens of one text; a text with special strings or rare characters goes to the library whole."""
    if any(s in text for s in specials) or _RARE.search(text):
        return len(lengths.tokenizer.encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, pattern.findall(text)))


def frequent_pretokens(
    docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, entries: int, sample_rows: int, seed: int
) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of about ``sample_rows`` seeded rows.

    Each sampled partition sends its ``entries`` most frequent at most. Which ones are found only
    decides what is a cache hit, never a count. ``entries`` pre-tokens of ``LONGEST`` characters bound the table.
    """
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(1 << 20))
    sample = docs.filter(draw < int(share * (1 << 20)) + 1).select(F.col(text_col).alias("text"))

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        pattern, counts = regex.compile(PRE_TOKEN), Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(p for p in pattern.findall(text or "") if len(p) <= LONGEST)
            if len(counts) > 4 * entries:
                counts = Counter(dict(counts.most_common(entries)))
        kept = counts.most_common(entries)
        yield {"piece": [p for p, _ in kept], "n": [n for _, n in kept]}

    found = map_columns(sample, kernel, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.col("n").desc(), "piece").limit(entries).collect()
    tokenizer = open_tokenizer(tokenizer_path)
    pieces = [r["piece"] for r in top]
    encoded = tokenizer.encode_batch(pieces, add_special_tokens=False)
    return {p: len(e.ids) for p, e in zip(pieces, encoded)}


def token_counts(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024,
    entries: int = 32_768, sample_rows: int = 4_000, worker_entries: int = 262_144, seed: int = 11,
) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens).

    Counts are those of the library for whole texts, without begin, end or other added tokens,
    truncation or padding; special strings inside a text count as the library takes them by default.
    A null text is empty: 0 bytes, 0 tokens. Null and repeated ids keep their rows. Other columns
    are not read. No rows in, no rows out. The file at ``tokenizer_path`` must be there on every executor.
    """
    lengths = frequent_pretokens(docs, id_col, text_col, tokenizer_path, entries, sample_rows, seed)
    table = docs.sparkSession.sparkContext.broadcast(lengths)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def kernel(batches: Iterator[dict]) -> Iterator[dict]:
        pattern, tokenizer = regex.compile(PRE_TOKEN), open_tokenizer(tokenizer_path)
        held, specials = PreTokenLengths(tokenizer, table.value, worker_entries), _specials(tokenizer)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            yield {
                "doc_id": batch["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                "n_tokens": (n := [count_text(t, pattern, held, specials) for t in texts]),
                "over_limit": [x > limit for x in n],
            }

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_columns(rows, kernel, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")

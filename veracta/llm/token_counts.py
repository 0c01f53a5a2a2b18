"""Token counts of whole texts by a tokeniser file, with very long texts encoded in overlapping chunks.

Chunks of a long text are encoded with offsets apart; each counts the tokens
between the proven stable boundaries that it shares with its neighbours, and
raw text is passed on and widened where there is none (see ``splicing``).

The file's merges and pattern are those of its ranks, so the fast encoder of
the ranks counts texts whose characters both are known to treat alike (all but
rare ones, which are tested); any other text goes to the file's own library.
Special strings in a text are one token, as that library does by default.

A null text reads as empty: no bytes, no tokens. Repeated rows and ids stay,
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splicing import CHUNK, OVERLAP, PARTS, gather, owned, part, spread

#: Texts of these characters only (Latin, Greek, Cyrillic, punctuation, currency, kana, CJK) take the fast encoder;
#: tests hold every one of them against the file's library.
PLAIN = regex.compile("[\\x00-\\x1b\\x20-\\u024f\\u0300-\\u036f\\u0391-\\u03a1\\u03a3-\\u03ff\\u0400-\\u04ff\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20b5\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5]*+")


class Counter:
    """Counts tokens, and gives their offsets, as the tokeniser file at ``path`` does."""

    def __init__(self, path: str, ranks: str | None, pattern: str):
        import base64

        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_padding()
        self.own.no_truncation()
        self.special = {t.content: i for i, t in self.own.get_added_tokens_decoder().items()}
        self.fast = None
        if ranks:
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=self.special)

    def plain(self, text: str) -> bool:
        return self.fast is not None and PLAIN.fullmatch(text) is not None

    def count(self, text: str) -> int:
        if self.plain(text):
            return len(self.fast.encode_to_numpy(text, allowed_special="all"))
        return len(self.own.encode(text, add_special_tokens=False))

    def ends(self, text: str) -> list[int]:
        """For each token, how many characters of ``text`` are begun by its end."""
        if not self.plain(text):
            return [b for _, b in self.own.encode(text, add_special_tokens=False).offsets]
        ids = self.fast.encode_to_numpy(text, allowed_special="all").tolist()
        return list(accumulate(sum((c & 0xC0) != 0x80 for c in b) for b in self.fast.decode_tokens_bytes(ids)))


@lru_cache(maxsize=4)
def counter(path: str, ranks: str | None, pattern: str) -> Counter:
    return Counter(path, ranks, pattern)


def token_counts(docs: DataFrame, path: str, ranks: str | None, pattern: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row. ``path``: a tokeniser file; ``ranks``: its ranks, if there are any."""

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, ranks, pattern).count
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                n = [count(t) if t else 0 for t in some.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = counter(path, ranks, pattern).ends
        for batch in batches:
            for row in range(batch.num_rows):
                k, ks, text = (batch.column(c)[row].as_py() for c in (2, 3, 4))
                lo, hi, sure = owned(text, k == 0, k == ks - 1, chunk, overlap)
                n = 0
                if sure:
                    found = ends(text)
                    a, b = (bisect_left(found, x + 1) if x else 0 for x in (lo, hi))  # tokens that end by then
                    sure = (not lo or found[a - 1] == lo) and (not hi or found[b - 1] == hi)
                    n = b - a if sure else 0
                keys = [batch.column(0).slice(row, 1), batch.column(1).slice(row, 1)]
                yield part(keys, k, k * chunk + lo, k * chunk + hi, n, text[lo:hi], None, sure)

    def finish(parts: list[dict]) -> tuple:
        count = counter(path, ranks, pattern).count
        return sum(p["size"] for p in parts), sum(p["n"] if p["raw"] is None else count(p["raw"]) for p in parts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk + overlap
    short = rows.where(~long).mapInArrow(direct, "doc_id long, n_bytes long, n_tokens long")
    parts = spread(rows.where(long), chunk, overlap).mapInArrow(pieces, PARTS)
    joined = gather(parts, finish, "doc_id long, n_bytes long, n_tokens long", ["doc_id", "n_bytes", "n_tokens"])
    return short.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)

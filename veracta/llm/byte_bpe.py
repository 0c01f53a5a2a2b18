"""Byte-level BPE by a file of ranks: encoding and decoding of whole texts of any length.

A text longer than a chunk is cut into overlapping chunks, which are
pre-tokenised apart, stitched where their pre-token boundaries agree, and then
encoded; decoding joins the tokens' raw bytes. Shorter texts are encoded where
they are read, without a shuffle. The ids equal those of the whole text at once.

A null text reads as empty: no ids, and the digest of no bytes. Empty texts
likewise. Repeated rows and repeated ids stay. Extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .splicing import CHUNK, OVERLAP, PARTS, WHITE, gather, owned, part, spread

_SPACES = "".join(sorted(WHITE))


@lru_cache(maxsize=4)
def coder(path: str, pattern: str):
    """The tokeniser of the rank file at ``path``, made once in each worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def splitter(pattern: str):
    """``pattern`` with Unicode's white space written out, as this module's \\s has a few more characters."""
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACES}").replace(r"\S", f"[^{_SPACES}]").replace(r"\s", f"[{_SPACES}]"))


def pretokens(text: str, pattern: str) -> set[int]:
    """Where the pre-tokens of ``text`` begin."""
    return {m.start() for m in splitter(pattern).finditer(text)}


def encode(text: str, path: str, pattern: str) -> np.ndarray:
    return coder(path, pattern).encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def decode(ids: np.ndarray, path: str, pattern: str) -> bytes:
    return coder(path, pattern).decode_bytes(ids.tolist())


def _schema(with_ids: bool) -> tuple[str, list[str]]:
    cols = {"doc_id": "long", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "binary", "decoded": "binary"} if with_ids else {})
    return ", ".join(f"{k} {v}" for k, v in cols.items()), list(cols)


def encoded(docs: DataFrame, path: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row; ``with_ids`` adds the ids as little-endian
    unsigned 32-bit integers, and the bytes decoded from them."""
    schema, names = _schema(with_ids)

    def result(ids: np.ndarray) -> tuple:
        raw, back = ids.tobytes(), decode(ids, path, pattern)
        out = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest())
        return (*out, raw, back) if with_ids else out

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                rows = [result(encode(t or "", path, pattern)) for t in some.column(1).to_pylist()]
                cols = [pa.array(c) for c in zip(*rows, strict=True)]
                cols[0] = cols[0].cast(pa.int64())
                if with_ids:
                    cols[3:] = [c.cast(pa.binary()) for c in cols[3:]]
                yield pa.RecordBatch.from_arrays([some.column(0), *cols], names=names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                k, ks, text = (batch.column(c)[row].as_py() for c in (2, 3, 4))
                lo, hi, sure = owned(text, k == 0, k == ks - 1, chunk, overlap)
                if sure:
                    found = pretokens(text, pattern) | {len(text)}
                    sure = lo in found and hi in found
                ids = encode(text[lo:hi], path, pattern).tobytes() if sure else None
                keys = [batch.column(0).slice(row, 1), batch.column(1).slice(row, 1)]
                yield part(keys, k, k * chunk + lo, k * chunk + hi, 0, text[lo:hi], ids, sure)

    def finish(parts: list[dict]) -> tuple:
        return result(np.concatenate([encode(p["raw"], path, pattern) if p["raw"] is not None else np.frombuffer(p["ids"], "<u4") for p in parts]))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk + overlap
    parts = spread(rows.where(long), chunk, overlap).mapInArrow(pieces, PARTS)
    return rows.where(~long).mapInArrow(direct, schema).unionByName(gather(parts, finish, schema, names))

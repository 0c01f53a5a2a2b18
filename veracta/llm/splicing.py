"""Very long texts in overlapping chunks that are tokenised apart and joined where they agree.

A chunk begins at a fixed place, perhaps inside a pre-token, so what it finds
first may be wrong. Between a character that is no white space and one that is,
every tokenisation by the pattern below has a boundary, wherever it began:
no pre-token has white space after another character, nor does a special
string. Both chunks that share an overlap find the first such place there and
cut at it, if their own boundaries confirm it. Where the overlap has none, both
pass on raw text, which is widened to the next cut when the parts are gathered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, OVERLAP = 1 << 15, 512
#: Unicode's White_Space, which the tokenisers' pattern calls \s.
WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0                　")


def stable(text: str, lo: int, hi: int) -> int | None:
    """The first place in (lo, hi) where white space follows another character."""
    hi = min(hi, len(text))
    for p in range(lo + 1, hi):
        if text[p] in WHITE and text[p - 1] not in WHITE:
            return p
    return None


def owned(text: str, first: bool, last: bool, chunk: int, overlap: int) -> tuple[int, int, bool]:
    """What a chunk answers for: from, to, and whether both ends are proven boundaries. Unproven ends stand at the nominal cut."""
    lo, hi, sure = 0, len(text), True
    if not first:
        at = stable(text, 0, overlap)
        lo, sure = at or 0, at is not None
    if not last:
        at = stable(text, chunk, chunk + overlap)
        hi, sure = (chunk if at is None else at), sure and at is not None
    return lo, hi, sure


def spread(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks ``doc_id, md, k, ks, piece`` of ``docs(doc_id, text)``, dealt out so that one text's chunks go to many tasks.

    ``md`` tells apart texts that share an id; rows repeated whole share all
    keys, and are told apart by their number when they are gathered.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "md", "k", "ks", "piece"]
        for batch in batches:
            for row in range(batch.num_rows):
                text, ident = batch.column(2)[row].as_py(), batch.column(0).slice(row, 1)
                ks = max(1, -(-max(0, len(text) - overlap) // chunk))
                for k in range(ks):
                    piece = text[k * chunk :] if k == ks - 1 else text[k * chunk : (k + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_arrays([ident, batch.column(1).slice(row, 1), pa.array([k], pa.int64()), pa.array([ks], pa.int64()), pa.array([piece], pa.string())], names=names)

    rows = docs.select("doc_id", F.md5(F.col("text").cast("binary")).alias("md"), "text")
    return rows.mapInArrow(cut, "doc_id long, md string, k long, ks long, piece string").repartition("md", "k")


PARTS = "doc_id long, md string, k long, start long, stop long, n long, size long, ids binary, raw string"


def part(keys: list[pa.Array], k: int, start: int, stop: int, n: int, text: str, ids: bytes | None, sure: bool) -> pa.RecordBatch:
    """A row of PARTS: ``n`` tokens or their ``ids``, or else the raw text, for the ``text`` that a chunk answers for."""
    numbers = [pa.array([v], pa.int64()) for v in (k, start, stop, n, len(text.encode()))]
    names = ["doc_id", "md", "k", "start", "stop", "n", "size", "ids", "raw"]
    return pa.RecordBatch.from_arrays([*keys, *numbers, pa.array([ids], pa.binary()), pa.array([None if sure else text], pa.string())], names=names)


def gather(parts: DataFrame, finish: Callable[[list[dict]], tuple], schema: str, names: list[str]) -> DataFrame:
    """One row for each text from its parts ``doc_id, md, k, start, stop, n, size, ids, raw``: ``finish`` gets them in order."""
    whole = parts.groupBy("doc_id", "md").agg(F.array_sort(F.collect_list(F.struct("k", "start", "stop", "n", "size", "ids", "raw"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None
        for batch in batches:
            for row in range(batch.num_rows):
                got = batch.column(1)[row].as_py()
                copies = sum(p["k"] == 0 for p in got)
                once = got[::copies]  # equal rows give equal parts, side by side
                if any(a["stop"] != b["start"] for a, b in zip(once[:-1], once[1:], strict=True)):
                    raise RuntimeError("chunks of a text don't meet")
                out = finish(merged(once))
                ident = pa.array([batch.column(0)[row].as_py()] * copies, pa.int64())
                types = types or [pa.array([v]).type for v in out]
                yield pa.RecordBatch.from_arrays([ident, *(pa.array([v] * copies, t) for v, t in zip(out, types, strict=True))], names=names)

    return whole.select("doc_id", "parts").mapInArrow(run, schema)


def merged(parts: list[dict]) -> list[dict]:
    """Neighbouring raw parts as one: the overlap is widened until it has a proven boundary at both ends."""
    out: list[dict] = []
    for p in parts:
        if p["raw"] is not None and out and out[-1]["raw"] is not None:
            out[-1] = {**out[-1], "raw": out[-1]["raw"] + p["raw"], "stop": p["stop"], "size": out[-1]["size"] + p["size"]}
        else:
            out.append(p)
    return out

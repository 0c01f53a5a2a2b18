"""Where the outside plugs in: page readers, models and the registry.

None of them is called unless one is passed in, and the package has no network
code of its own: only a reader that plays recorded answers back, and a sink
that shows what it would send.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Reader(Protocol):
    """A model that answers a prompt about images with text."""

    def chat(self, prompt: str, images: list, system: str | None = None) -> str: ...


class Busy(Exception):
    """A reader has too many requests; ``wait`` is its own hint in seconds, ``spent`` that a day's quota is used up."""

    def __init__(self, wait: float | None = None, spent: bool = False):
        super().__init__("busy")
        self.wait, self.spent = wait, spent


class Recorded:
    """Answers from a table of prompts, in place of a model."""

    def __init__(self, answers: dict[str, str]):
        self.answers = answers

    def chat(self, prompt: str, images: list = (), system: str | None = None) -> str:
        return self.answers.get(prompt, "{}")


def with_retry(call: Callable[[], str], tries: int = 5, sleep: Callable[[float], None] = time.sleep, base: float = 2.0, cap: float = 70.0) -> str:
    """Call again while the reader is busy: after its own hint, at most ``cap`` seconds, or else 2, 4, 8 ... seconds. A spent quota fails at once."""
    for k in range(tries):
        try:
            return call()
        except Busy as e:
            if e.spent or k == tries - 1:
                raise
            sleep(min(cap, e.wait) if e.wait is not None else base * 2**k)
    raise AssertionError


def distinct_keys(keys: DataFrame) -> DataFrame:
    """``keys``: each once, in the order of a comma-separated setting."""
    return keys.select(F.array_distinct(F.filter(F.transform(F.split("keys", ","), lambda k: F.trim(k)), lambda k: k != "")).alias("keys"))


def read_batches(calls: DataFrame, make: Callable[[], Reader], at_once: int = 4) -> DataFrame:
    """``doc_id, batch, answer, error`` for ``calls(doc_id, batch, prompt)``: one reader for each of ``at_once`` partitions,
    which is also the limit on calls at a time. An error becomes a row, so a retried task asks again only for its own rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = make()
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    rows.append((r.doc_id, r.batch, with_retry(lambda r=r: reader.chat(r.prompt, [])), None))
                except Exception as e:  # noqa: BLE001  a failed call degrades to a stub
                    rows.append((r.doc_id, r.batch, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "batch", "answer", "error"])

    return calls.repartition(at_once).mapInPandas(run, "doc_id string, batch int, answer string, error string")


def dry_run(declarations: DataFrame) -> DataFrame:
    """``doc_id, payload``: what would be sent to the registry, as JSON, with the comments as one text."""
    body = F.to_json(F.struct(*(c for c in declarations.columns if c not in ("doc_id", "comments"))))
    return declarations.select("doc_id", body.alias("payload"), F.array_join("comments", "\n").alias("comment"))


def render_pages(scans: DataFrame, render: Callable[[bytes], tuple[bytes, int]]) -> DataFrame:
    """``path, page, n_pages, error`` from ``scans(path, content)``: the first page of each PDF by the ``render`` that is
    passed in; other files as they are; an empty file is an error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    if not r.content:
                        raise ValueError("empty file")
                    page, n = render(r.content) if r.path.lower().endswith(".pdf") else (r.content, 1)
                    rows.append((r.path, page, n, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((r.path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "page", "n_pages", "error"])

    return scans.select("path", "content").mapInPandas(run, "path string, page binary, n_pages int, error string")

import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veracta.llm import textbatch as tb

texts = st.lists(st.one_of(st.none(), st.text(alphabet=" \n\tabé日\x0b\U0001f600", max_size=20)), min_size=1, max_size=8)


def parts(column, size=tb.SLICE_BYTES):
    for lo, hi, t in tb.slices(pa.array(column, pa.string()), size):
        yield lo, hi, t, tb.words(t)


@settings(deadline=None)
@given(texts, st.integers(1, 40))
def test_words_are_those_of_the_pattern(column, size):
    got, rows = [], 0
    for lo, hi, t, w in parts(column, size):
        assert lo == rows
        rows = hi
        got += [(lo + d, bytes(t.data[a:b]).decode()) for a, b, d in zip(w.start, w.end, w.doc, strict=True)]
    assert rows == len(column)
    assert got == [(i, m) for i, x in enumerate(column) for m in re.findall(r"[^\x20\x09-\x0D]+", x or "")]


@settings(deadline=None)
@given(texts)
def test_equal_words_have_equal_hashes_and_others_do_not(column):
    seen = {}
    for _, _, t, w in parts(column, 16):
        for a, b, h in zip(w.start, w.end, tb.hashes(t, w), strict=True):
            assert seen.setdefault(bytes(t.data[a:b]), int(h)) == int(h)
    assert len(set(seen.values())) == len(seen)


def test_sliced_columns_and_ngrams():
    column = pa.array(["zz", "a b c", "a b c d"], pa.string()).slice(1)
    _, _, t = next(tb.slices(column))
    w = tb.words(t)
    grams, at = tb.ngrams(tb.hashes(t, w), w.doc, 3)
    assert list(w.doc[at]) == [0, 1, 1] and grams[0] == grams[1] != grams[2]
    assert tb.characters(t, np.array([len(t.data)]))[0] == 12 and list(tb.totals(np.array([1, 2]), np.array([1, 1]), 2)) == [0, 3]


def test_hashes_and_code_points_are_the_same_across_windows():
    """Spans that begin, end or lie on a window's bounds, and one over several windows, against the bytes themselves."""
    w = tb.WINDOW
    rng = np.random.default_rng(5)
    text = "".join(rng.choice(list("ab é日"), w)) + "x" * (2 * w + 7) + " " + "".join(rng.choice(list("ab é日"), w))
    size = len(text.encode())
    column = [text, "x" * (2 * w + 7), text[: w // 2] + " " * (w - len(text[: w // 2].encode())) + "ab", "b" * w, "b" * (3 * w), text + "b" * (-size % w)]
    seen, points = {}, 0
    for _, _, t, s in parts(column, 1 << 30):
        assert np.array_equal(tb.characters(t, np.arange(0, len(t.data) + 1, 1009)), [len(bytes(t.data[:a]).decode(errors="ignore")) + bool(a < len(t.data) and t.data[a] & 0xC0 == 0x80) for a in range(0, len(t.data) + 1, 1009)])
        for a, b, h in zip(s.start, s.end, tb.hashes(t, s), strict=True):
            assert seen.setdefault(bytes(t.data[a:b]), int(h)) == int(h)
            points += 1
    assert len(set(seen.values())) == len(seen) < points


_PEAK = """
import resource, sys
import numpy as np, pyarrow as pa
from veracta.llm import language_id, near_dedup, repetition, textbatch as tb, toxicity
rng = np.random.default_rng(3)
words = np.pad(rng.choice(np.frombuffer(b"abcdefghij", np.uint8), (20_000, 6)), ((0, 0), (0, 1)), constant_values=32)
text = words[rng.integers(0, 20_000, 7_200_000)].tobytes().decode()
column = pa.array([text])
if "language" == sys.argv[1]:
    del column
    assert language_id.profile(*language_id.counted(text)).size
else:
    del text
    (_, _, t), = tb.slices(column)
    {"repetition": repetition.measures, "toxicity": toxicity.features, "dedup": lambda t: near_dedup.shingles(t, 5)}[sys.argv[1]](t)
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
"""


@pytest.mark.parametrize("what", ["repetition", "toxicity", "dedup", "language"])
def test_a_text_of_50_mb_takes_bounded_memory(what):
    out = subprocess.run([sys.executable, "-c", _PEAK, what], capture_output=True, text=True, timeout=300, check=True)
    assert int(out.stdout) < 1024, out.stdout

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veracta.llm import language_id, repetition, toxicity
from veracta.llm import textbatch as tb
from veracta.llm.folds import held_out

from .cases import none, odd, odd_rows


# --- repetition ------------------------------------------------------------------------------------------------------


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)

    def inside(n):
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, hit = Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                hit.update(range(i, i + n))
        return hit

    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    chars = sum(map(len, words))
    cover = {n: sum(len(words[i]) for i in inside(n)) / max(1, chars) for n in repetition.LIMITS}
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), again, len(inside(8))), cover


def repetitive(seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        words = [rng.choice("ab cd éf g# h| ijk".split()) for _ in range(rng.randint(0, 60))]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words) * rng.randint(1, 3)))
    return rows


def test_counts_and_coverage_by_brute_force(spark):
    rows = repetitive() + [(100 + i, r[1]) for i, r in enumerate(odd_rows())]
    got = {r.doc_id: r for r in repetition.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        counts, cover = brute_counts(text)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert {n: r[f"coverage_{n}"] for n in cover} == pytest.approx(cover)
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r.base_failed and r.kept)


def test_clean_text_is_kept_and_repetitive_text_is_not(spark):
    clean = " ".join(f"w{i}" for i in range(200))
    rows = [(1, clean), (2, f"{clean[:300]}\n" * 4), (3, " ".join(f"w{i}##" for i in range(100)))]
    assert {r.doc_id: r.kept for r in repetition.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1: True, 2: False, 3: False}


def test_repetition_takes_odd_rows(spark):
    got = repetition.quality(odd(spark)).collect()
    assert len(got) == len(odd_rows()) and not any(r.kept for r in got if r.doc_id in (1, 2, 3, 4))
    assert repetition.quality(none(spark)).collect() == []


# --- language --------------------------------------------------------------------------------------------------------

WORDS = {"aa": "the of and with that this from were".split(), "bb": "der die und nicht mit von aber schon".split(), "cc": "que los para con una pero muy".split()}


def labelled(n=240):
    rng = random.Random(2)
    return [(i, " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "en", "s"]) for _ in range(40)), lang) for i in range(n) for lang in [rng.choice(sorted(WORDS))]]


def test_held_out_texts_are_told_apart(spark):
    df = spark.createDataFrame(labelled(), "doc_id long, text string, lang string")
    got = language_id.identify(df, language_id.learn(df.where(~held_out()))).withColumn("out", held_out()).collect()
    for r in got:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r for r in got if r.out]
    assert len(out) > 50 and all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out)


def test_out_of_place_distance_by_its_definition():
    p = language_id.Profiles({"x": np.array([1, 2, 3], np.uint32), "y": np.array([9, 1], np.uint32)}, 3)
    # x: 2 is one off, 1 is one off, 7 isn't there; y: 2 isn't there, 1 in place, 7 isn't there
    assert p.distances(np.array([2, 1, 7], np.uint32)) * 9 == pytest.approx([1 + 1 + 3, 3 + 0 + 3])


def test_profile_by_counting():
    text = "ab ab ba"
    want = Counter()
    padded = " ab ab ba "
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            if n > 1 or padded[i] != " ":
                want[padded[i : i + n]] += 1
    kinds, counts = language_id.counted(text)
    assert counts.sum() == sum(want.values()) and sorted(counts) == sorted(want.values())
    assert list(language_id.profile(kinds, counts, 4)) == list(language_id.profile(kinds, counts))[:4]
    for most in (1, 2, 3, 5):  # windows that cut words and gaps
        for t in (text, " ..ab  ab, ba..", "a", "..", ""):
            assert [list(x) for x in language_id.counted(t, most)] == [list(x) for x in language_id.counted(t)]


def test_language_of_odd_rows(spark):
    p = language_id.learn(odd(spark).where(~held_out()))
    got = language_id.identify(odd(spark), p)
    assert [c for c in got.columns if c == "score"] == ["score"]
    by = {r.doc_id: r.lang_pred for r in got.collect()}
    assert by[1] == by[2] == by[3] == by[10] == "und" and by[4] != "und" and got.count() == len(odd_rows())
    nothing = language_id.learn(none(spark))
    assert {r.lang_pred for r in language_id.identify(odd(spark), nothing).collect()} == {"und"} and language_id.identify(none(spark), p).collect() == []


# --- toxicity --------------------------------------------------------------------------------------------------------


def sentences(n=400):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        bad = i % 4 == 0
        words = [rng.choice(plain) for _ in range(30)]
        if bad:
            words[rng.randrange(30)] = rng.choice(["Scum", "idiot"])
        if bad and i % 3 == 0 or i % 29 == 0:  # abuse names a group more often than other texts do
            words[rng.randrange(30)] = "muslims" if i // 12 % 2 else "immigrants"
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_held_out_toxic_texts_are_found(spark):
    df = spark.createDataFrame(sentences(), "doc_id long, text string, toxic int")
    model = toxicity.learn(df.where(~held_out()))
    got = [r for r in toxicity.scored(df, model).where(held_out()).collect()]
    assert len(got) > 100 and all(r.predicted == r.toxic for r in got)


def model(penalty):
    rows = sentences()
    sets = []
    for _, _, t in tb.slices(pa.array([r[1] for r in rows]), 1 << 30):
        doc, found = toxicity.features(t)
        sets = [found[doc == i] for i in range(len(rows))]
    return toxicity.fit(sets, np.array([r[2] for r in rows]), penalty=penalty)


def score(m, text):
    return float(m.scores(next(tb.slices(pa.array([text])))[2])[0])


@pytest.mark.parametrize("term", ["muslims", "immigrants", "Immigrants"])
def test_the_penalty_makes_a_neutral_mention_count_less(term):
    free, held = model(0.0), model(toxicity.PENALTY)
    base = score(held, "word1 word2")
    assert score(free, f"word1 {term} word2") > score(free, "word1 word2") + 0.03
    assert score(held, f"word1 {term} word2") < min(score(free, f"word1 {term} word2"), base + 0.02)
    assert score(held, "word1 natives word2") < base + 0.02 and score(held, "word1 christians word2") < base + 0.02
    assert score(held, f"word1 idiot word2 {term}") >= 0.7


def test_counterfactuals_swap_a_whole_term():
    known = toxicity.terms((("immigrants", "natives", "guests"),))
    own = set(toxicity.features(next(tb.slices(pa.array(["immigrants came"])))[2])[1].tolist())
    other = toxicity.counterfactuals(own, known)
    want = [set(toxicity.features(next(tb.slices(pa.array([t])))[2])[1].tolist()) for t in ("natives came", "guests came", "came")]
    assert other == want and toxicity.counterfactuals(want[2], known) == []


def test_toxicity_of_odd_rows_and_missing_labels(spark):
    m = model(1.0)
    got = toxicity.scored(odd(spark), m)
    assert got.count() == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got.collect())
    assert toxicity.scored(none(spark), m).collect() == []
    unlabelled = toxicity.learn(odd(spark).withColumn("toxic", F.lit(None).cast("int")))
    assert {r.predicted for r in toxicity.scored(odd(spark), unlabelled).collect()} == {0}
    one_kind = toxicity.learn(odd(spark).withColumn("toxic", F.lit(1)))
    assert {r.predicted for r in toxicity.scored(odd(spark), one_kind).collect()} == {1}


def test_the_sample_of_labels_is_bounded_and_repeats(spark):
    labels = spark.createDataFrame([(i % 50, 1) for i in range(100)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    a, b = (sorted(r.doc_id for r in toxicity.sample(labels.repartition(k), 20).collect()) for k in (1, 7))
    assert a == b and len(a) == 20

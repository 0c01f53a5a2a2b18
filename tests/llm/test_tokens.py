import hashlib

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from veracta.llm import byte_bpe, splicing, token_counts
from veracta.llm.queries import pattern, vocabulary

from .cases import none, odd, odd_rows

RANKS, FILE, FAST = (vocabulary(n) for n in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
mixed = st.text(alphabet="ab é日'st1 \n\t!", max_size=300)


@settings(max_examples=60)
@given(mixed)
def test_stable_places_are_boundaries_wherever_one_begins(text):
    whole = byte_bpe.pretokens(text, pattern())
    for p in range(1, len(text)):
        if splicing.stable(text, p - 1, p + 1) == p:
            assert p in whole
            for begin in range(max(0, p - 5), p):
                assert p - begin in byte_bpe.pretokens(text[begin:], pattern())


@settings(max_examples=60)
@given(mixed, st.integers(8, 40))
def test_owned_pieces_join_to_the_whole(text, chunk):
    overlap = 6
    ks = max(1, -(-max(0, len(text) - overlap) // chunk))
    parts = []
    for k in range(ks):
        piece = text[k * chunk :] if k == ks - 1 else text[k * chunk : (k + 1) * chunk + overlap]
        lo, hi, sure = splicing.owned(piece, k == 0, k == ks - 1, chunk, overlap)
        parts.append({"start": k * chunk + lo, "stop": k * chunk + hi, "raw": None if sure else piece[lo:hi], "size": 0, "text": piece[lo:hi]})
    assert all(a["stop"] == b["start"] for a, b in zip(parts[:-1], parts[1:], strict=True))
    ids = []
    for p in splicing.merged(parts):
        ids += byte_bpe.encode(p["raw"] if p["raw"] is not None else p["text"], RANKS, pattern()).tolist()
    assert ids == byte_bpe.coder(RANKS, pattern()).encode_ordinary(text)


def texts():
    return [(i, r[1]) for i, r in enumerate(odd_rows())] + [(100, "mot é 日本 " * 400), (101, ("x" * 700 + " ") * 5), (102, "a\n\n b  c\t" * 300)]


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (1000, 50), (1 << 15, 512)])
def test_encoding_is_that_of_the_whole_text_and_decodes_back(spark, chunk, overlap):
    df = spark.createDataFrame(texts(), "doc_id long, text string")
    got = {r.doc_id: r for r in byte_bpe.encoded(df, RANKS, pattern(), chunk, overlap, with_ids=True).collect()}
    for i, text in texts():
        ids = byte_bpe.coder(RANKS, pattern()).encode_ordinary(text or "")
        raw = b"".join(v.to_bytes(4, "little") for v in ids)
        assert bytes(got[i].ids) == raw and got[i].n_tokens == len(ids) and got[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert bytes(got[i].decoded) == (text or "").encode() and got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (1 << 15, 512)])
def test_counts_are_the_librarys(spark, chunk, overlap):
    rows = [*texts(), (200, "<|endoftext|>a <|endoftext|> b" * 20), (201, "x\x1c\x1dy   z")]
    own = token_counts.Counter(FILE, None, pattern())
    got = {r.doc_id: r for r in token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), FILE, FAST, pattern(), 1024, chunk, overlap).collect()}
    for i, text in rows:
        n = own.count(text or "")
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 1024)


def test_repeated_rows_and_empty_tables(spark):
    for run in (lambda d: byte_bpe.encoded(d, RANKS, pattern(), 64, 16), lambda d: token_counts.token_counts(d, FILE, FAST, pattern(), 1024, 64, 16)):
        ids = [r.doc_id for r in run(odd(spark)).collect()]
        assert sorted(map(str, ids)) == sorted(str(r[0]) for r in odd_rows())
        assert run(none(spark)).collect() == []
        long = spark.createDataFrame([(5, "a b " * 99)] * 3 + [(5, "c d " * 99)], "doc_id long, text string")
        assert len(run(long).collect()) == 4


def test_every_plain_character_is_counted_as_the_library_counts_it():
    c = token_counts.Counter(FILE, FAST, pattern())
    plain = [chr(i) for i in range(0x10000) if not 0xD800 <= i < 0xE000 and token_counts.PLAIN.fullmatch(chr(i))]
    assert len(plain) > 20_000
    for lo in range(0, len(plain), 200):
        some = [f"a{x}1{x} {x}{x}\n{x}." for x in plain[lo : lo + 200]]
        fast = [len(c.fast.encode_to_numpy(t, allowed_special="all")) for t in some]
        assert fast == [len(e) for e in c.own.encode_batch(some, add_special_tokens=False)]
    assert regex.fullmatch(token_counts.PLAIN, "x" * 100_000)

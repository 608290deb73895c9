import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from riskframe.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_vocabulary(PATH))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    decoded = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


TEXTS = [
    "", "a", "  \n\n  x ", "<|endoftext|>hi<|endoftext|>", "a<|endoftext|", "I'll we've 's'", "日本語 ١٢٣ 😀 é ‍", "\u0000\u0001",
    "x" * 30_000, "ab" * 20_000, "ñé😀" * 9_000, " " * 70_000 + "z", "\t\n" * 40_000, "word " * 20_000, "a" * 40_000 + " " + "b c" * 30_000,
]


def test_equals_the_library(codec, library):
    rng = random.Random(0)
    noise = ["".join(rng.choice("abcdefghijklmnop") for _ in range(20_000)), "".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(5_000))]
    for text in [*TEXTS, *noise]:
        assert bpe.digests(codec, text) == expected(library, text), text[:40]


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=200))
def test_equals_the_library_on_any_text(text):
    codec, library = _pair()
    assert bpe.digests(codec, text) == expected(library, text)


_PAIR = []


def _pair():
    if not _PAIR:
        _PAIR.extend([bpe.Codec(bpe.load_vocabulary(PATH)), Tokenizer.from_file(PATH)])
    return _PAIR


def merge_lists(trials):
    for trial in range(trials):
        rng = random.Random(trial)
        letters = [bytes([97 + i]) for i in range(rng.choice([1, 2, 3]))]
        tokens, merges, made = list(letters), [], set()
        for _ in range(rng.randint(3, 25)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in made and len(a + b) <= 12:
                made.add(a + b)
                merges.append((a, b))
                tokens.append(a + b)
        yield rng, letters, merges


def test_lookahead_fixes_tokens_and_streaming_equals_whole():
    for rng, letters, merges in merge_lists(150):
        bpe.check_proper(merges)
        ranks, ahead = {m: r for r, m in enumerate(merges)}, bpe.sufficient_lookahead(merges)
        of_bytes = [[ranks.get((a, b), len(ranks)) for b in bpe._BYTES] for a in bpe._BYTES] if merges and rng.random() < 0.05 else None
        for _ in range(10):
            text = b"".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
            whole = bpe.merge_all(text, ranks)
            if of_bytes:
                assert bpe.merge_short(text, ranks, of_bytes) == whole
            cut, end = rng.randint(0, len(text)), 0
            for x, y in zip(bpe.merge_all(text[:cut], ranks), whole, strict=False):
                end += len(x)
                if end > cut - ahead:
                    break
                assert x == y
            machine, out, at = bpe.Transducer(ranks, ahead), [], 0
            machine.window = max(2 * ahead, 8)
            while at < len(text):
                n = rng.randint(1, 50)
                out += machine.feed(text[at : at + n])
                at += n
                assert len(machine.held) <= machine.window
            assert out + list(machine.finish()) == whole


def test_improper_merge_lists_are_refused():
    for merges in ([(b"ab", b"c")], [(b"a", b"b"), (b"a", b"b")], [(b"b", b"c"), (b"a", b"bc"), (b"a", b"b"), (b"ab", b"c")]):
        with pytest.raises(ValueError):
            bpe.check_proper(merges)


def test_decoder_keeps_split_characters_and_marks_broken_bytes(codec):
    raw = {t: i for t, i in codec.vocab.items() if len(t) == 1}
    ids = lambda b: [[raw[bytes([x])]] for x in b]
    assert "".join(codec.decode(ids("é😀".encode()))) == "é😀"
    assert "".join(codec.decode(ids(b"a\xf0\x9f\x98b\xff"))) == b"a\xf0\x9f\x98b\xff".decode("utf-8", "replace")


def test_table_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "c"), (None, None, "c"), (None, "x", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(df, PATH).collect()], key=str)
    assert got == sorted([(i, *expected(library, t)) for i, t, _ in rows], key=str)
    assert bpe.encode_digests(df.limit(0), PATH).collect() == []

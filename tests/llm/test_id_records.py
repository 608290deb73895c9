"""Binary records against the tokenizers library, file by file, and their checks."""

import os
import random
import struct
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import regex
from tokenizers import Tokenizer

from riskframe.llm import id_records as ir

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"
ODD = [
    None, "", " ", "  ", "a  b", " a", "a ", "it's  we'll 'S don't", "x\n\n y \n z\t\t", "a b 　c  d", "a\x1c b \x1d\x85 c", "one <|endoftext|> two<|endoftext|>", "<|endoftext|", "né " * 50, "日本語 テスト", "🙂🙂 🙂",
    "١٢٣ ½ ²", "_ _x __ x_", "á é", "​ zero", "A" * 3000, "ab" * 2000 + "  c",
]


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def digests(spark, rows, schema=SCHEMA, shards=4, **kw):
    manifest = ir.write_records(spark.createDataFrame(rows, schema), PATH, end_id=2, shards=shards, **kw)
    return manifest, ir.read_digests(manifest)


def test_pieces_equal_the_library():
    with open(PATH, encoding="utf-8") as f:
        encode = ir.Encoder(f.read())
    assert encode.by_word and encode.width == 2
    rng = random.Random(3)
    letters = ["a", "B", "é", "7", " ", " ", "  ", "\n", "\t", ".", "'s", " ", "\x1c", "\x85", " ", "日", "'", "’", "\r\n"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    tok = Tokenizer.from_file(PATH)
    for t in texts:
        assert np.frombuffer(encode(t or ""), "<u2").tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_sections_change_nothing(monkeypatch):
    monkeypatch.setattr(ir, "SECTION", 7)
    monkeypatch.setattr(ir, "CACHE", 5)
    with open(PATH, encoding="utf-8") as f:
        encode = ir.Encoder(f.read())
    rng = random.Random(8)
    tok = Tokenizer.from_file(PATH)
    for _ in range(500):
        t = "".join(rng.choice(["ab", " ", "  ", "\n", "c's", "é", "."]) for _ in range(rng.randint(1, 60)))
        assert np.frombuffer(encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_other_tokenizers_encode_whole_texts():
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    encode, tok = ir.Encoder(spec), Tokenizer.from_str(spec)
    assert not encode.by_word
    for t in ("Hello  World", "don't STOP"):
        assert np.frombuffer(encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_records_in_id_order(spark):
    rng = random.Random(2)
    ids = rng.sample(range(-50, 10_000), len(ODD) + 300)
    rows = [(i, t) for i, t in zip(ids, ODD + [" ".join(rng.choice(["the", "And,", "x1", "\n"]) for _ in range(rng.randint(0, 80))) for _ in range(300)], strict=True)]
    manifest, out = digests(spark, rows)
    got = {r.id: (r.start, r.n_tokens, r.ids_crc32) for r in out.collect()}
    at, want = 0, {}
    for i, t in sorted(rows):
        x = [*library(t), 2]
        want[i] = (at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert got == want
    shards = manifest.orderBy("shard").collect()
    assert len(shards) > 1 and shards[-1].start + shards[-1].n_tokens == at
    # The files by themselves, without the index: framed records, one after the other.
    stream = []
    for s in shards:
        with open(s.file.removeprefix("file:") + ".rec", "rb") as f:
            data = f.read()
        assert len(data) == s.n_bytes
        pos = 0
        while pos < len(data):
            n = struct.unpack_from("<Q", data, pos)[0]
            stream += np.frombuffer(ir.unframe(data[pos : pos + 12 + n + 4]), "<u2").tolist()
            pos += 12 + n + 4
    assert stream == [x for _, t in sorted(rows) for x in [*library(t), 2]]


def test_shuffled_reads(spark):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(500)]
    manifest, _ = digests(spark, rows)
    plain = [(r.id, r.start, r.ids) for r in ir.read_records(manifest).collect()]
    once, again, other = ([(r.id, r.start, r.ids) for r in ir.read_records(manifest, seed=s).collect()] for s in (1, 1, 2))
    assert once == again and once != other and sorted(once) == sorted(plain) == sorted(other)
    assert [r[0] for r in once] != sorted(r[0] for r in once)
    assert dict((r[0], r[2]) for r in once)[6] == [*library("text 6 " * 6), 2]


def test_damage_is_found(spark):
    manifest, _ = digests(spark, [(i, "some text here") for i in range(50)], shards=1)
    path = manifest.first().file.removeprefix("file:") + ".rec"
    with open(path, "r+b") as f:
        f.seek(40)
        b = f.read(1)
        f.seek(40)
        f.write(bytes([b[0] ^ 1]))
    with pytest.raises(Exception, match="checksum differ"):
        ir.read_digests(manifest).collect()
    with pytest.raises(ValueError):
        ir.unframe(ir.frame(b"abc")[:-1])
    with pytest.raises(ValueError):
        ir.unframe(b"")


def test_odd_tables(spark, tmp_path):
    manifest, out = digests(spark, [])
    assert manifest.count() == 0 and out.collect() == []
    rows = [(None, "last"), (3, "b"), (3, None), (3, "b"), (1, "x" * 300_000)]
    _, out = digests(spark, [(*r, 1, 2) for r in rows], SCHEMA + ", id int, start int", folder=str(tmp_path))
    got = sorted((r.start, r.id, r.n_tokens) for r in out.collect())
    assert [g[1] for g in got] == [1, 3, 3, 3, None] and sorted(g[2] for g in got[1:4]) == [1, 2, 2]
    assert got[0][2] == len(library("x" * 300_000)) + 1 and all(a[0] + a[2] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert len(os.listdir(tmp_path)) == 1
    with pytest.raises(ValueError):
        ir.write_records(spark.createDataFrame([("a", "b")], "doc_id string, text string"), PATH)


def test_strays_go(spark, tmp_path):
    for name in ("part-0-a.rec", "part-0-a.idx", "part-1-b.rec"):
        (tmp_path / name).write_bytes(b"x")
    ir._drop_strays(f"file://{tmp_path}", {"part-0-a"})
    assert sorted(os.listdir(tmp_path)) == ["part-0-a.idx", "part-0-a.rec"]


def test_usual_pieces_need_no_split_pattern():
    with open(PATH, encoding="utf-8") as f:
        encode = ir.Encoder(f.read())
    tok = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    parts = ["the", "And", "éß", "Ñandú", ",", ".", "!?", ";:", "\n", "\n\n", "\r\n", "x1", "'s", "\x1c", "­", "ǅ", "×"]
    for _ in range(3000):
        t = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 6)))
        assert np.frombuffer(encode(t), "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)

    class Never:
        def findall(self, text):
            assert " " not in text, text  # the first piece of a text has no blank before it
            return whole.findall(text)

    whole, encode.split = encode.split, Never()
    made, tokenize = [], encode.tokenize
    encode.tokenize = lambda letters: made.append(letters) or tokenize(letters)
    encode("A zebu, a yak;\nNow zebus: zebu!\nNow yak.")
    n = len(made)
    assert n == len(set(made)) and "Ġzebu" in made
    encode("A yak, zebu.\nNow zebus, zebu!")
    assert len(made) == n


def test_white_space_is_that_of_the_cut():
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    gap = pc.match_substring_regex(pa.array(letters), ir._GAP).to_pylist()
    assert gap == [regex.match(r"\s", c) is not None for c in letters]
    assert pc.match_substring_regex(pa.array(["", "a", "a ", "\na"]), ir._GAP).to_pylist() == [True, False, False, True]


@pytest.mark.parametrize("known", [5, 1 << 19])
def test_texts_of_a_run_equal_the_library(monkeypatch, known):
    monkeypatch.setattr(ir, "KNOWN", known)
    with open(PATH, encoding="utf-8") as f:
        encode = ir.Encoder(f.read())
    rng = random.Random(4)
    parts = ["a", "zebu", "é", "7", " ", " ", "  ", "\n", "\t", ".", ",", "'s", "\u3000", "\x1c", "\x85", "\xa0", "日", "\r\n", " <|endoftext|>"]
    texts = [t or "" for t in ODD] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    tok = Tokenizer.from_file(PATH)
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for n in (1, 7, 500, len(texts)):
        got = [x for at in range(0, len(texts), n) for x in encode.together(pa.array(texts[at : at + n], pa.string()))]
        assert [np.frombuffer(x, "<u2").tolist() for x in got] == want
    assert list(encode.together(pa.array([], pa.string()))) == []
    assert len(encode.known) == len(encode.known_ids) <= known and len(set(encode.known.to_pylist())) == len(encode.known)


def test_runs_are_bounded(monkeypatch):
    monkeypatch.setattr(ir, "RUN", 1000)
    sizes = [0, 5, 2000, 1, 400, 400, 400, 0, 0, 900, 3000, 3000, *[0] * 60]
    batches = [pa.record_batch({"id": list(range(at, at + 5))[: len(sizes) - at], "text": pa.array(["x" * n for n in sizes[at : at + 5]], pa.large_string())}) for at in range(0, len(sizes), 5)]
    runs = list(ir._runs(iter(batches)))
    assert [i for ids, _ in runs for i in ids] == list(range(len(sizes)))
    assert [len(t.as_py()) for _, texts in runs for t in texts] == sizes
    assert len(runs) > 8 and all(len(ids) == 1 or sum(len(t.as_py()) for t in texts) <= 1000 and len(ids) < 20 for ids, texts in runs)
    with open(PATH, encoding="utf-8") as f:
        encode = ir.Encoder(f.read())
    long = "a  zebu <|endoftext|>\n " * 100
    assert np.frombuffer(next(encode.together(pa.array([long]))), "<u2").tolist() == library(long)


def test_what_is_remembered_stays_small():
    with open(PATH, encoding="utf-8") as f:
        encode = ir.Encoder(f.read())
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdefghijklmnop", k=9)) for _ in range(200_000))
    tracemalloc.start()
    try:
        encode(text)
        assert tracemalloc.get_traced_memory()[0] < 16e6  # all of them as Python objects are 26 MB
        before = pa.total_allocated_bytes()
        for _ in encode.together(pa.array([text])):
            pass
        assert len(encode.known) > 190_000
        assert tracemalloc.get_traced_memory()[0] < 16e6 and pa.total_allocated_bytes() - before < 10e6
    finally:
        tracemalloc.stop()


def test_reading_takes_one_python_step(spark):
    manifest, out = digests(spark, [(i, f"text {i}") for i in range(600)])
    for df in (out, ir.read_records(manifest)):
        assert df._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # each is a Python worker beside the others
    assert ir.read_index(manifest).count() == 600

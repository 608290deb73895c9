import random

from riskframe.llm.substring_dedup import chunks, drop_repeats, find_repeats

SCHEMA = "doc_id long, text string, digest string, key string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n)]


def shared_runs(rows, least):
    """Documents with a stretch of ``least`` words that another document has too."""
    where = {}
    for doc, text, *_ in rows:
        w = (text or "").lower().split()
        for k in range(len(w) - least + 1):
            where.setdefault(tuple(w[k : k + least]), set()).add(doc)
    return {d for s in where.values() if len(s) > 1 for d in s}


def test_chunks_are_cut_by_content_and_stand_in_every_window():
    rng = random.Random(1)
    w = words(rng, 3000)
    lo, hi, digest, _, start, end = chunks(" ".join(w))
    assert lo[0] == 0 and hi[-1] == 2950 and all(a + 1 == b for a, b in zip(hi, lo[1:], strict=False))
    assert all(h <= s <= e < x + 50 for x, h, s, e in zip(lo, hi, start, end, strict=True))
    lengths = {e - s + 1 for s, e in zip(start, end, strict=True)}
    assert lengths == {12, 13, 14, 15, 16} and len(lo) < 3000 / 10
    moved = chunks(" ".join([*w[:1500], "inserted", "words", *w[1500:]]))
    assert len(set(digest) - set(moved[2])) <= 8
    for k in range(0, 2900, 97):  # the chunk of a window is the same in whatever text the window stands
        alone = chunks(" ".join(w[k : k + 50]))
        amid = chunks(" ".join(words(rng, 9) + w[k : k + 50] + words(rng, 9)))
        here = next(i for i, (a, b) in enumerate(zip(lo, hi, strict=True)) if a <= k <= b)
        there = next(i for i, (a, b) in enumerate(zip(*amid[:2], strict=True)) if a <= 9 <= b)
        assert alone[2] == [digest[here]] == [amid[2][there]]
    assert chunks("")[0] == [] and chunks(" \n")[0] == [] and chunks("x " * 49)[0] == []
    assert len(chunks("same " * 5000)[0]) and len(chunks("x" * 50_000 + " y" * 60)[0])
    assert chunks("a b c d e f", 3)[0] and chunks("a b c d e f g h i j k l m", 12)[0]


def corpus():
    rng = random.Random(2)
    passage, other = words(rng, 70), words(rng, 55)
    rows = [(k, " ".join(words(rng, 120)), "c", "c") for k in range(40)]
    put = lambda k, p: (k, " ".join(words(rng, 60) + p + words(rng, rng.randint(0, 60))), "c", "c")
    rows += [put(100, passage), put(101, passage), put(102, [x.upper() for x in passage]), put(103, other), put(104, other)]
    rows += [put(200, words(rng, 12) + ["a", "common", "line"]), put(201, ["a", "common", "line"]), (300, None, "c", "c"), (301, "", "c", "c")]
    rows += [(100, rows[40][1], "c", "c"), (None, " ".join(words(rng, 90)), "c", "c")]
    return rows


def test_finds_repeated_passages_and_nothing_else(spark):
    rows = corpus()
    want = shared_runs(rows, 51)
    got = find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id for r in got} == want == {100, 101, 102, 103, 104}
    assert {(r.doc_id, r.keep_id) for r in got} == {(100, 100), (101, 100), (102, 100), (103, 103), (104, 103)}
    assert all(r.kept == (r.doc_id == r.keep_id) and r.first_word >= 60 and 20 <= r.n_words <= 70 for r in got)


def test_drop_keeps_one_copy_and_everything_else(spark):
    rows = corpus()
    got = drop_repeats(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "text", "digest", "key"]
    by = {r.doc_id: r.text for r in got.collect()}
    old = {r[0]: r[1] for r in rows}
    assert got.count() == len(rows)
    assert all(by[k] == old[k] for k in old if k not in (101, 102, 104))
    for k in (101, 102, 104):
        assert len(old[k].split()) - 70 <= len(by[k].split()) <= len(old[k].split()) - 20
    assert spark.createDataFrame([], SCHEMA).transform(find_repeats).collect() == []


def test_recall_of_passages_just_over_the_length(spark):
    rng = random.Random(7)
    rows = []
    for k in range(120):
        p = words(rng, 56)
        rows += [(2 * k, " ".join(words(rng, 30) + p + words(rng, 30)), "", ""), (2 * k + 1, " ".join(words(rng, 41) + p), "", "")]
    got = {r.doc_id // 2 for r in find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) >= 114  # of 120


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id for r in find_repeats(docs).collect()}
    assert shared_runs(rows, 60) <= got <= shared_runs(rows, 16)


def real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    return docs, {r.doc_id: r.text or "" for r in docs.collect()}


def test_keeper_holds_the_passage_and_each_passage_survives_the_cut(spark):
    docs, texts = real_rows(spark)
    flat = lambda t: " " + " ".join(t.lower().split()) + " "
    found = find_repeats(docs).collect()
    held = {k: flat(t) for k, t in texts.items()}
    runs = [(r, flat(" ".join(texts[r.doc_id].split()[r.first_word : r.first_word + r.n_words]))) for r in found]
    assert runs and all(run in held[r.keep_id] and r.keep_id <= r.doc_id for r, run in runs)
    after = {r.doc_id: flat(r.text or "") for r in drop_repeats(docs).collect()}
    assert all(run in after[r.keep_id] for r, run in runs)


def test_overlapping_passages_of_two_keepers_survive(spark):
    rng = random.Random(11)
    a, b, c = words(rng, 40), words(rng, 40), words(rng, 40)
    rows = [(1, " ".join(b + c), "", ""), (2, " ".join(a + b + c), "", ""), (3, " ".join(words(rng, 9) + a + b), "", "")]
    after = {r.doc_id: r.text for r in drop_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert after[1] == rows[0][1] and " ".join(a + b) in after[2] and len(after[3].split()) == 9


def test_fifty_words_are_found_exactly_and_fewer_are_not(spark):
    docs, texts = real_rows(spark)
    assert {r.doc_id for r in find_repeats(docs).collect()} == shared_runs(texts.items(), 50)
    rng = random.Random(13)
    common = [w for t in texts.values() for w in t.lower().split()][:50_000]
    rows, want = [], {}
    for k in range(150):
        n = (49, 50, 51)[k % 3]
        p = rng.choices(common, k=n)
        rows += [(2 * k, " ".join([f"a{k}", *p, f"b{k}"]), "", ""), (2 * k + 1, " ".join([f"c{k}", f"d{k}", *p, f"e{k}"]), "", "")]
        if n > 49:
            want |= {2 * k: (1, n), 2 * k + 1: (2, n)}
    assert {r.doc_id: (r.first_word, r.n_words) for r in find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_hot_chunks_and_short_passages(spark):
    rng = random.Random(17)
    shared, line = words(rng, 60), words(rng, 8)
    rows = [(k, " ".join(words(rng, 20) + shared + words(rng, 20)), "", "") for k in range(200)]
    rows += [(1000 + k, " ".join(words(rng, 70)), "", "") for k in range(50)]
    got = {r.doc_id: (r.first_word, r.n_words, r.keep_id) for r in find_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: (20, 60, 0) for k in range(200)}
    for least in (3, 8, 12, 20):
        short = [(k, " ".join(words(rng, k + 1) + line * 3 + words(rng, 5)), "", "") for k in range(6)] + [(50, " ".join(words(rng, 30)), "", "")]
        found = {r.doc_id for r in find_repeats(spark.createDataFrame(short, SCHEMA), least).collect()}
        assert found == shared_runs(short, least) == set(range(6))

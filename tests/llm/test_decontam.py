import random

from hypothesis import given, settings
from hypothesis import strategies as st

from riskframe.llm import decontam
from riskframe.llm.decontam import drop_leaked, find_leaks, myers, pieces, words_only

DOCS = "doc_id long, text string, item_id string, end string"
ITEMS = "item_id long, text string, doc_id string"


def infix_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=70), st.text("abc ", max_size=90), st.integers(0, 30))
def test_myers_is_the_edit_distance(item, text, errors):
    got = myers(item, text, errors)
    best = infix_distance(item, text)
    assert (got[0] if got else None) == (best if best <= errors and text else None)


def test_pieces_cover_the_item():
    for n in range(1, 60):
        for k in range(0, n):
            parts = pieces("x" * n, k)
            assert len(parts) == k + 1 and "".join(p for _, p in parts) == "x" * n and all(p for _, p in parts)


def edit(rng, text, k):
    t = list(text)
    for _ in range(k):
        i = rng.randrange(len(t))
        t[i : i + 1] = rng.choice([[], ["q"], [t[i], "z"]])
    return "".join(t)


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(12, 30)))) for k in range(15)] + [(90, ""), (91, None), (92, "too short"), (None, "the item without an id " * 3)]
    docs = []
    for k in range(60):
        text = " ".join(word() for _ in range(rng.randint(0, 80)))
        if k % 3 == 0:
            item = rng.choice(items[:15])[1]
            item = edit(rng, item, rng.randint(0, len(item) // 12))
            text += rng.choice([" ", "\n", "!! "]) + rng.choice([item, item.upper(), item.replace(" ", "### ")]) + " tail " + text
        docs.append((k, text))
    docs += [(0, docs[0][1]), (None, "the ITEM without an id! " * 3), (100, None), (101, ""), (102, "é" * 20_000 + " " + items[0][1])]
    return docs, items


def brute(docs, items):
    out = []
    for doc, text in docs:
        t = words_only(text or "")
        for item_id, item in items:
            w = words_only(item or "")
            if 0 < len(w) < decontam.SHORT_LETTERS:
                if f" {w} " in f" {t} ":
                    out.append((doc, item_id, 0))
            elif w:
                k = decontam.budget(len(w), decontam.ERROR_RATE)
                if len(t) < 10_000 and (d := infix_distance(w, t)) <= k:
                    out.append((doc, item_id, d))
                elif len(t) >= 10_000 and w in t:
                    out.append((doc, item_id, 0))
    return sorted(out, key=str)


def test_matches_brute_force_in_one_block_and_in_many(spark):
    docs, items = corpus(random.Random(4))
    d = spark.createDataFrame([(*x, "clash", "clash") for x in docs], DOCS)
    b = spark.createDataFrame([(*x, "clash") for x in items] * 2, ITEMS)
    want = brute(docs, items)
    assert len(want) > 15
    for size in (10**6, 500):
        got = find_leaks(d, b, block_letters=size).collect()
        found = sorted({(r.doc_id, r.item_id, r.distance) for r in got}, key=str)
        assert found == sorted(set(want), key=str)
        assert all(r.distance <= r.budget for r in got)
    leaked = {x[0] for x in want}
    kept = drop_leaked(d, b, block_letters=500)
    assert kept.columns == d.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([x for x in docs if x[0] not in leaked], key=str)


def test_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "x" * 90, "", "")], DOCS), spark.createDataFrame([(1, "x" * 90, "")], ITEMS)
    assert find_leaks(d.limit(0), b).collect() == [] and find_leaks(d, b.limit(0)).collect() == []
    assert drop_leaked(d, b.limit(0)).count() == 1


def test_short_items_stand_word_for_word(spark):
    rows = [(1, "Well: what is two plus two equal to?"), (2, "what is two plus twothousand equal to"), (3, "swhat is two plus two equal to"), (4, "WHAT is,\ntwo plus two equal TO"), (5, "four"), (6, "forty-four"), (7, "fourteen"), (8, "")]
    items = [(10, "What is two plus two equal to?"), (11, "four"), (12, "?!"), (13, None), (14, "")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance, r.budget, r.end) for r in find_leaks(d, b).collect())
    assert got == [(1, 10, 0, 0, 34), (4, 10, 0, 0, 29), (5, 11, 0, 0, 4), (6, 11, 0, 0, 10)]
    assert [r.doc_id for r in drop_leaked(d, b).orderBy("doc_id").collect()] == [2, 3, 7, 8]

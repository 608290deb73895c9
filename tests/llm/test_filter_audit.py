"""Filter audit against replaying every order over rows, and odd input."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from riskframe.llm import filter_audit as fa

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def brute(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, t, part in docs:
        t, w = t or "", words(t or "")
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(o is not None and o < d and (u or "") == t for o, u, _ in docs),
        }
        rows.append((part or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                failing = sum(f in r[1] for r in mine)
                out[part, "".join(order), step] = [
                    len(left), len(gone), failing - len(gone), sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(spark, docs, labels):
    df = fa.audit_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in df.collect()}


def some_docs(n, seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(n // 2):
        t = " ".join(rng.choice(["alpha", "Beta", "GAMMA", "x", "née", "#tag"][: rng.randint(2, 6)]) + str(rng.randint(0, rng.choice([3, 900]))) for _ in range(rng.choice([3, 199, 200, 250])))
        texts.append(t)
    return [(rng.randint(0, 2 * n), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(n)]


def test_equals_replaying_orders(spark):
    docs = some_docs(60, 4)
    rng = random.Random(1)
    labels = [(d, rng.randint(0, 1), rng.randint(0, 1)) for d, _, _ in docs[:40]]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_odd_rows(spark):
    docs = [(1, None, None), (2, "", ""), (None, "", "en"), (None, " \n\t", "en"), (3, "a b c", "en"), (3, "a b c", "en"), (4, "a b c", "de"), (5, "W " * 300_000, "de"), (5, "W " * 300_000, "de")]
    labels = [(4, None, 1), (4, 1, None), (None, 1, 1), (99, 1, 1), (5, 0, 0)]
    assert got(spark, docs, labels) == brute(docs, labels)


def test_many_copies_of_one_text(spark):
    docs = [(i, "same text", "en") for i in range(3000)] + [(i, f"own {i}", "en") for i in range(3000, 3100)]
    r = got(spark, docs, [])["en", "EABCD", 1]
    assert r[:2] == (101, 2999)


def test_empty_tables_and_clashing_columns(spark):
    assert got(spark, [], []) == {}
    docs = spark.createDataFrame([(1, "a", "en", 5, 6, 7), (2, "a", "en", 5, 6, 7)], DOCS + ", n long, mask long, part long")
    labels = spark.createDataFrame([(1, 1, 1, "x")], LABELS + ", lang string")
    rows = fa.audit_documents(docs, labels).where("filter_order = 'EABCD' and step = 1").collect()
    assert [(r.part, r.kept, r.removed, r.good_lost) for r in rows] == [("en", 1, 1, 0)]


def test_gray_walk_equals_counting(spark):
    rng = np.random.default_rng(3)
    for k in (1, 3, 6):
        masks = np.arange(1 << k)
        counts = rng.integers(0, 50, (1 << k, 2))
        states = fa.gray_walk(masks, counts, k)
        for active in range(1 << k):
            assert (states[active] == counts[(masks & active) == 0].sum(axis=0)).all()


def test_other_filters(spark):
    cells = spark.createDataFrame([("p", 0, 4, 1, 0), ("p", 1, 3, 1, 1), ("p", 3, 2, 0, 1)], "part string, mask int, n long, good long, toxic long")
    rows = {(r.filter_order, r.step): tuple(r)[3:] for r in fa.audit_orders(cells, "XY").collect()}
    assert rows == {("XY", 1): (4, 5, 0, 3, 1, 2, 8), ("XY", 2): (4, 0, 2, 0, 0, 0, 2), ("YX", 1): (7, 2, 0, 0, 0, 1, 2), ("YX", 2): (4, 3, 2, 3, 1, 1, 8)}
    with pytest.raises(ValueError):
        fa.audit_orders(cells, "AA")

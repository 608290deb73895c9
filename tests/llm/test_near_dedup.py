import random

import numpy as np

from riskframe.llm import near_dedup as nd
from riskframe.llm.components import components

SCHEMA = "doc_id long, text string, key string, n string"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, percent):
    sets = [shingle_set(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            least = min(ids) if ids else None
            out.append((rows[i][0], len(sets[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    base = [word() for _ in range(120)]
    rows = []
    for k in range(90):  # a family whose members differ from one another by more or less
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6, 12])):
            w[rng.randrange(len(w))] = word()
        rows.append((500 - k, " ".join(w)))
    chain = [word() for _ in range(60)]
    for k in range(12):  # each links to the next, the first not to the last
        chain[5 * k % 60] = word()
        rows.append((600 + k, "  ".join(chain)))
    rows += [(700 + k, " ".join(word() for _ in range(rng.randint(0, 50)))) for k in range(60)]
    rows += [(1, "a b c"), (2, "A\tB\nC"), (3, "a b"), (4, ""), (5, None), (6, " \n"), (500, rows[0][1]), (None, "a b c"), (None, "alone here"), (800, "É x"), (801, "é x")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)


def test_matches_brute_force(spark):
    rows = corpus()
    got = nd.near_components(frame(spark, rows)).collect()
    want = brute(rows, 85)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == want
    assert len({x[2] for x in want}) < len(want) - 30


def test_drop_keeps_one_of_each_group_and_all_blank_texts(spark):
    rows = corpus()
    got = nd.drop_near_duplicates(frame(spark, rows), percent=80)
    assert got.columns == ["doc_id", "text", "key", "n"]
    want = brute(rows, 80)
    groups = {(x[2] if x[2] is not None else "null") for x in want if x[1]}
    kept = got.collect()
    assert sorted((r.doc_id for r in kept if shingle_set(r.text)), key=str) == sorted((None if g == "null" else g for g in groups), key=str)
    assert sum(not shingle_set(r.text) for r in kept) == sum(not shingle_set(r[1]) for r in rows)


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = nd.near_components(docs).collect()
    assert sorted([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got], key=str) == brute(rows, 85)


def test_large_group_of_copies_emits_no_pairs(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows = []
    for k in range(300):
        w = list(base)
        w[rng.randrange(200)] = f"v{k}"
        rows.append((k, " ".join(w)))
    run = nd._Corpus(frame(spark, rows), 85)
    buckets = run.buckets()
    stars = run.star_candidates(buckets)
    assert stars.count() <= 5 * len(rows)
    links = run.confirmed(stars, run.elements(buckets.select("cid").distinct()))
    assert run.cross_candidates(buckets, components(links)).count() == 0


def test_lanes_and_odd_sketch_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, 200, dtype=np.uint64))
        b = np.unique(np.append(a[20:], rng.integers(0, 1 << 62, 15, dtype=np.uint64)))
        (sa, oa), (sb, ob) = nd.signature(a), nd.signature(b)
        x = [int(p) ^ int(q) for p, q in zip(sa, sb, strict=True)]
        swar = sum(((((v & nd.LOW) + nd.LOW) | v) & nd.TOP).bit_count() for v in x)
        lanes = sum((v >> (12 * i)) & nd.LANE != 0 for v in x for i in range(5))
        assert swar == lanes
        assert sum((int(p) ^ int(q)).bit_count() for p, q in zip(oa, ob, strict=True)) <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(201, 200)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.v: r.root for r in components(df).collect()}
    assert got == {k: 0 for k in range(41)} | {100 + k: 100 for k in range(30)} | {200: 200, 201: 200}
    assert components(df.limit(0)).collect() == []


def test_empty_table(spark):
    empty = frame(spark, [])
    assert nd.near_components(empty).collect() == [] and nd.drop_near_duplicates(empty).collect() == []


def test_pairs_share_the_first_slot(spark):
    rng = random.Random(8)
    full = (1 << 60) - 1
    rows = []
    for k in range(200):
        a = [rng.getrandbits(60) for _ in range(nd.CHUNKS)]
        b = []
        for v in a:
            for lane in rng.sample(range(5), rng.choice([0, 1] + [2, 3, 5] * 6)):
                v ^= rng.randint(1, nd.LANE) << (12 * lane)
            b.append(v & full)
        rows.append((k, *a, *b))
    cols = [f"{side}{c}" for side in "ab" for c in nd.SIG]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{c} long" for c in cols))
    a = df.select("k", *[df[f"a{c}"].alias(c) for c in nd.SIG]).withColumn("keys", nd.index_keys()).alias("p")
    b = df.select("k", *[df[f"b{c}"].alias(c) for c in nd.SIG]).withColumn("keys", nd.index_keys()).alias("q")
    got = a.join(b, a.k == b.k).select(nd._first_slot("p", "q").alias("slot"), "p.keys", "q.keys").collect()
    assert any(r[0] is None for r in got) and any(r[0] for r in got)
    for r in got:
        same = [i for i, (x, y) in enumerate(zip(r[1], r[2], strict=True)) if x == y]
        assert r[0] == (same[0] if same else None)

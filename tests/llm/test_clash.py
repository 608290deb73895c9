"""Columns that bear the names of temporary ones pass through unharmed."""

import random

from riskframe.llm import line_dedup, near_dedup, pii, substring_dedup


def _docs(spark, names, texts):
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in names)
    rows = [(k, t, f"s{k}", *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def _same(df, out, names):
    assert set(names) <= set(out.columns)
    for r in out.collect():
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]
    return out


def test_pii(spark):
    names = ["_pii", "_pii_text", "_PII_", "found_", "id"]
    df = _docs(spark, names, ["on 2020-01-05", "none", None])
    assert [r.n_found for r in _same(df, pii.pseudonymise(df, "k"), names).orderBy("doc_id").collect()] == [1, 0, 0]


def test_line_dedup(spark):
    names = ["__id", "__th", "__gone", "__GONE_", "id", "th", "h1"]
    df = _docs(spark, names, ["nav\nown a", "nav\nown b", "nav", "own c"])
    out = _same(df, line_dedup.drop_spread_lines(df, min_sites=3), names)
    assert [r.text for r in out.orderBy("doc_id").collect()] == ["nav\nown a", "own b", "", "own c"]


def test_substring_dedup(spark):
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    names = ["_id", "_th", "_spans", "_all", "th", "_SPANS_"]
    df = _docs(spark, names, [f"a {passage} b", f"c {passage} d", "e"])
    out = _same(df, substring_dedup.drop_repeats(df), names).orderBy("doc_id").collect()
    assert out[0].text == f"a {passage} b" and passage not in out[1].text and out[2].text == "e"


def test_near_dedup(spark):
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    names = ["__key", "__th", "__each", "key", "th", "n"]
    df = _docs(spark, names, [" ".join(words), " ".join([*words[:-1], "x"]), "other words are here now", " ".join(words)])
    assert sorted(r.doc_id for r in _same(df, near_dedup.drop_near_duplicates(df.union(df.where("doc_id = 0"))), names).collect()) == [0, 2]

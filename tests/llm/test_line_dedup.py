import random

from pyspark.sql import functions as F

from riskframe.llm.line_dedup import drop_spread_lines, spread_lines

SCHEMA = "doc_id long, text string, source string, n_chars long, pos int, first string"


def brute(rows, min_sites):
    sites, first = {}, {}
    for k, (doc, text, site, *_) in enumerate(rows):
        for p, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).update([site] if site is not None else [])
    gone = {line for line, s in sites.items() if len(s) >= min_sites}
    return gone, first


def test_removes_lines_of_many_sites_but_for_the_first(spark):
    rng = random.Random(2)
    rows = [(k, "\n".join(rng.choice(["nav", " nav ", "foot", f"own {k}", "", "rare"]) for _ in range(4)), f"s{k % 7}", 1, 1, "c") for k in range(60)]
    rows += [(100 + k, "rare two", "s1", 1, 1, "c") for k in range(30)] + [(None, "nav\nown", None, 1, 1, "c"), (200, None, "s1", None, 1, "c"), (200, "", "s2", 0, 1, "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = drop_spread_lines(df, min_sites=5, length_col="n_chars").collect()
    gone, _ = brute(rows, 5)
    assert "nav" in gone and "rare two" not in gone and len(got) == len(rows)
    left = [line.strip(" ") for r in got for line in (r.text or "").split("\n")]
    assert all(left.count(line) == 1 for line in gone)  # one document keeps it
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 200)}
    for doc, text, *_ in rows[:60]:
        own = lambda t: [x for x in t.split("\n") if x and x.strip(" ") not in gone]
        assert own(by[doc].text) == own(text)
        assert by[doc].n_lines == 4 and by[doc].n_chars == (len(by[doc].text) if by[doc].n_removed else 1)
    assert all(r.text in (None, "") for r in got if r.doc_id == 200)


def test_near_threshold_lines_are_counted_exactly(spark):
    n = 60
    counts = {f"line {m}": m for m in range(40, 61)}
    rows = [(k, m, line) for m, (line, c) in enumerate(counts.items()) for k in range(c)]
    lines = spark.createDataFrame(rows, "k long, m long, line string").select(
        F.xxhash64("line").alias("h1"), F.lit(0).cast("long").alias("h2"), F.concat(F.lit("s"), "k").alias("site"), F.col("k").alias("id"), F.col("m").alias("th"), F.lit(0).alias("pos")
    )
    got = {r.h1 for r in spread_lines(lines.union(lines), min_sites=50, lg_k=5, band=0.5).collect()}
    want = {r.h1 for r in spark.createDataFrame([(x,) for x, c in counts.items() if c >= 50], "line string").select(F.xxhash64("line").alias("h1")).collect()}
    assert got == want and n


def test_without_counts_keeps_the_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", "s", 3, 1, "c")], SCHEMA)
    assert drop_spread_lines(df, min_sites=1, keep_first=False, counts=False).columns == df.columns
    assert drop_spread_lines(spark.createDataFrame([], SCHEMA)).collect() == []

import hashlib
import random
import re

from riskframe.llm.exact_dedup import content_sort_dedup

SCHEMA = "doc_id long, text string, norm string"


def brute(rows):
    groups = {}
    for i, (doc, text, _) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc is None, doc or 0, i))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            doc = rows[m[3]][0]
            out.append((doc, rows[best[3]][0], len(members), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force_with_hot_text_nulls_and_repeats(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a b", "ab", "a  b\t", "é\u00a0x", "é\u00a0 x", None, "", " \n", "long " * 2000]), "clash") for k in range(200)]
    rows += [(1000 + k, "hot  text"[: rng.choice([8, 9])], "clash") for k in range(300)] + [(7, "ab", "clash")] * 2 + [(None, "ab", "clash"), (None, "only", "clash")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = content_sort_dedup(df, partitions=4).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)


def test_empty_table(spark):
    assert content_sort_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_window_needs_no_second_shuffle_of_texts(spark):
    df = spark.createDataFrame([(1, "a", "")], SCHEMA)
    plan = content_sort_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan.replace("BroadcastExchange", "")

import random
import uuid

import pytest

import corpus_pipeline
from riskframe.llm import bpe, decontam, toxicity
from riskframe.session import checkpoint_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long, th string, __x string"


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    items = [(k, " ".join(word() for _ in range(20))) for k in range(6)]
    rows, labels = [], []
    for k in range(160):
        body = " ".join(word() for _ in range(60))
        if k % 8 == 0:
            body += " you are a moron."
        if k % 20 == 3:
            body += " " + items[k % 6][1].upper().replace(" ", "!! ")
        if k % 20 == 7:
            body = rows[-1][1].split("\n")[-1].replace(" you are a moron.", "") + " " + word()
        rows.append((k, f"site header number one\n{body}", "en", f"s{k % 12}", 0))
        labels.append((k, 1, int(k % 8 == 0)))
    rows += [(300, None, "en", "s1", None), (301, "", "en", "s2", 0), (302, "", "en", "s3", 0), (None, "the one without an id " * 4, None, None, None), (rows[1][0], *rows[1][1:])]
    return [(*r[:4], len(r[1]) if r[1] else r[4], "clash", "clash") for r in rows], labels, items


@pytest.fixture(scope="module")
def sf_dir(spark):
    rows, labels, items = corpus()
    root = f"{checkpoint_dir(spark).rstrip('/')}/sf-{uuid.uuid4().hex}"
    spark.createDataFrame(rows, DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_each_stage_does_its_work_on_what_came_before(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, at = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        path = f"{sf_dir}/out-{name}-{uuid.uuid4().hex}"
        stage(spark, before, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        at[name] = docs
        if name != "bpe":
            assert docs.columns == columns, name
    texts = {n: [(r.doc_id, r.text) for r in d.collect()] for n, d in at.items() if n != "bpe"}
    clean = [r for r in corpus()[0] if not (r[1] or "").endswith("moron.")]
    assert sorted(texts["toxicity"], key=str) == sorted([r[:2] for r in clean], key=str)
    # the header is on twelve sites: it stays once, and no document is lost
    assert len(texts["line_dedup"]) == len(clean) and sum("site header" in (t or "") for _, t in texts["line_dedup"]) in (1, 2)
    assert all(r.n_chars == len(r.text) for r in at["line_dedup"].collect() if r.text and r.doc_id is not None)
    kept = {i for i, _ in texts["near_dedup"]}
    assert {300, 301, 302, None} <= kept and len(kept) == len(texts["near_dedup"])
    gone = {i for i, _ in texts["line_dedup"]} - kept
    assert gone and all(i % 20 == 7 for i in gone)
    leaked = {i for i, t in texts["near_dedup"] if any(decontam.words_only(x) in decontam.words_only(t or "") for _, x in corpus()[2])}
    assert leaked and {i for i, _ in texts["decontamination"]} == kept - leaked
    codec = bpe.Codec(bpe.load_vocabulary(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json")))
    want = sorted([(i, *bpe.digests(codec, t)) for i, t in texts["decontamination"]], key=str)
    assert sorted([tuple(r) for r in at["bpe"].collect()], key=str) == want


def test_run_gives_the_last_stage(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 100


def test_empty_tables(spark):
    root = f"{checkpoint_dir(spark).rstrip('/')}/sf-{uuid.uuid4().hex}"
    spark.createDataFrame([], DOCS).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    assert corpus_pipeline.run(spark, root).collect() == []


def test_threshold_and_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "bpe"] and toxicity.THRESHOLD == 0.3

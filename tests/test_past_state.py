"""Past rates kept by a stream: any order of files, restarts and compaction give the batch fit."""

import random
import uuid

from riskframe.operators import encode
from riskframe.session import checkpoint_dir
from riskframe.streaming import past_state

SCHEMA = "id long, is_train int, isDefault int, time_key int, k string, g string"
ROWS = [(i, int(i % 7 > 0), (i * 5 + i // 3) % 3 // 2, [201511, 201512, 201601, 201603, 0][i % 5], "abc"[i * i % 3] if i % 11 else None, str(i % 2)) for i in range(120)]


def folder(spark, name):
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stream(spark, src):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)


def feed(spark, rows, src):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)


def run(spark, src, path, **kw):
    q = past_state.start(stream(spark, src), ["k", "g"], path, available_now=True, **kw)
    q.awaitTermination()
    return q


def rates(model):
    return {(r.col, r.key, r.month): r.rate for r in model.table.collect()}


def test_any_order_restarts_and_compaction_give_the_batch_fit(spark):
    rows = ROWS[:]
    random.Random(3).shuffle(rows)
    src, path = folder(spark, "loans"), folder(spark, "rates")
    for part in (rows[:5], rows[5:70]):
        feed(spark, part, src)
    run(spark, src, path, compact_every=2)
    feed(spark, rows[70:], src)  # the query has ended; the next one starts from its checkpoint
    run(spark, src, path, compact_every=2)
    want = encode.fit_past_rate(spark.createDataFrame(ROWS, SCHEMA), ["k", "g"])
    got = past_state.fitted(spark, path, ["k", "g"])
    assert rates(got) == rates(want) and got.global_rate == want.global_rate
    assert past_state._folders(spark, path)["base"]


def test_a_batch_written_again_changes_nothing(spark):
    path = folder(spark, "rates")
    one = spark.createDataFrame([("k", "a", 201501, 1.0, 2)], "col string, key string, month int, s double, n bigint")
    two = spark.createDataFrame([("k", "a", 201501, 3.0, 5), ("k", "b", 201502, 0.0, 1)], one.schema)
    for number, batch in ((0, one), (1, two), (1, two)):
        past_state.merge_batch(batch, number, path, compact_every=2)
    assert sorted(map(tuple, past_state.totals(spark, path).collect())) == [("k", "a", 201501, 3.0, 5), ("k", "b", 201502, 0.0, 1)]
    past_state.merge_batch(one, 2, path, compact_every=2)
    past_state.merge_batch(one, 3, path, compact_every=2)
    assert past_state._folders(spark, path) == {"base": [1, 3], "batch": [2, 3]}
    assert past_state.totals(spark, folder(spark, "none")).collect() == []


def test_months_behind_the_delay_are_closed_and_counted(spark):
    src, path = folder(spark, "loans"), folder(spark, "rates")
    for part in ([(1, 1, 1, 201501, "a", "x")], [(2, 1, 0, 201512, "a", "x")], [(3, 1, 1, 201501, "a", "x"), (4, 1, 1, 201511, "a", "x")]):
        feed(spark, part, src)
        q = run(spark, src, path, delay="60 days")
    got = {(r.key, r.month): (r.s, r.n) for r in past_state.totals(spark, path).where("col = 'k'").collect()}
    assert got == {("a", 201501): (1.0, 1), ("a", 201512): (0.0, 1), ("a", 201511): (1.0, 1)}
    assert sum(s["numRowsDroppedByWatermark"] for p in q.recentProgress for s in p["stateOperators"]) == 2

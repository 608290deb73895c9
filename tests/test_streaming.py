"""Streaming apply of fitted past rates equals the batch apply on test rows."""

import uuid

from pyspark.sql import functions as F

from riskframe.operators import encode
from riskframe.session import checkpoint_dir
from riskframe.streaming.scoring import encode_stream


def test_stream_matches_batch(spark):
    rows = [(i, 1, i % 2, 201500 + i % 6 + 1, "abc"[i % 3]) for i in range(60)]
    hist = spark.createDataFrame(rows, "id long, is_train int, isDefault int, time_key int, k string")
    model = encode.fit_past_rate(hist, ["k"])
    new = spark.createDataFrame([(100 + i, 0, None, 201512, "abcd"[i % 4]) for i in range(8)],
                                "id long, is_train int, isDefault int, time_key int, k string")
    base = checkpoint_dir(spark).rstrip("/")
    src = f"{base}/stream-src-{uuid.uuid4().hex}"
    new.write.parquet(src)
    stream = spark.readStream.schema(new.schema).parquet(src)
    name = f"scored_{uuid.uuid4().hex[:8]}"
    q = (encode_stream(stream, model, ["k"]).writeStream.format("memory").queryName(name)
         .option("checkpointLocation", f"{base}/stream-ckpt-{uuid.uuid4().hex}").start())
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: r["hist_rate_k"] for r in spark.table(name).collect()}
    batch = {r["id"]: r["hist_rate_k"] for r in encode.apply_past_rate(new, model, "k").collect()}
    assert got == batch and len(got) == 8

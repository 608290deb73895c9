"""Substring dedup by content-defined chunks, extended to exact passages.

A gear hash rolls over the normalised bytes, and its least values cut the words into
chunks of varying length. Of each passage-long window one chunk is taken: it ends
at the least hash of the window's later words and begins after the least one of a
few words before. Both cuts depend on the window's text alone, so a passage that
stands in two documents has the same chunk in both, whatever was inserted around
it, and neighbouring windows mostly share one. Chunks are deduplicated by digest, and
only windows whose chunk stands in several documents can be repeated. Where a chunk
stands amid the same words everywhere, its windows are repeated as a whole;
around the others the words decide: the word grams of those windows meet by a
128-bit digest. A passage is a run of windows that follow each other in the
document that keeps them.

A chunk or gram that very many places hold meets its digest by a broadcast of the
hot ones, whose number is bounded, and all others by a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import clean_text, fresh, shuffle_partitions, small_batches, write_table

WINDOW = 16
REACH = WINDOW // 2  # words before a word that its hash can see
STARTS = 5  # words among which a chunk begins
MIN_WORDS = 50
_GEAR = np.random.Generator(np.random.PCG64(20240607)).integers(0, 1 << 32, 256, dtype=np.uint32)
_WORD = re.compile(r"\S+")  # the words of str.split


def gear(raw: np.ndarray) -> np.ndarray:
    """At each byte: the sum of the last 16 bytes' gear numbers, each shifted by twice its age, modulo 2^32."""
    h = _GEAR[raw]
    width = 1
    while width < WINDOW:  # a window of 2w is two windows of w
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint32(2 * width))
        width *= 2
    return h


def _words(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-case words with single spaces, a space at the end; the same as numbers; where each word begins and ends."""
    joined = b"".join(w.encode("utf-8", "replace") + b" " for w in text.lower().split())
    raw = np.frombuffer(joined, np.uint8)
    stop = np.flatnonzero(raw == 0x20)
    return joined, raw, np.append(0, stop[:-1] + 1), stop


def chunk_words(min_words: int) -> int:
    """Words before a chunk's end, its own included, that decide where it begins and ends: half a passage or more."""
    return max((min_words + 1) // 2, min(min_words, REACH + 1))


def chunks(text: str, min_words: int = MIN_WORDS) -> tuple[list[int], list[int], list[int], list[int], list[int], list[int]]:
    """Of each chunk: the first and last window of ``min_words`` words it stands for, 64-bit digests of the chunk
    and of all its windows, its first word and its last one."""
    joined, raw, begin, stop = _words(text)
    n = chunk_words(min_words)
    if len(stop) < min_words:
        return [], [], [], [], [], []
    hashes = gear(raw)[stop - 1]
    choices = sliding_window_view(hashes[n - 1 :], min_words - n + 1)[:, ::-1]  # of equal ones, the last
    end = np.arange(len(choices)) + (min_words - 1) - choices.argmin(axis=1)
    end, first = np.unique(end, return_index=True)
    last = np.append(first[1:], len(choices)) - 1
    start = end - n + 1
    if n > REACH + STARTS:  # the hashes before, as far as they see none but the n words
        start = start + REACH
        start = start + sliding_window_view(hashes, STARTS)[start].argmin(axis=1) + 1
    number = lambda raw: int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
    chunk = [number(joined[a:b]) for a, b in zip(begin[start].tolist(), stop[end].tolist(), strict=True)]
    spans = zip(begin[first].tolist(), stop[last + min_words - 1].tolist(), (end - first).tolist(), (last - first).tolist(), strict=True)
    return first.tolist(), last.tolist(), chunk, [number(b"%d %d " % (c, d) + joined[a:b]) for a, b, c, d in spans], start.tolist(), end.tolist()


def grams(text: str, spans: list[tuple[int, int]], min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The windows (first word) within the spans, and the 128-bit digest of each one's words as two numbers."""
    joined, _, begin, stop = _words(text)
    at = np.unique(np.concatenate([np.arange(a, b + 1) for a, b in spans]))
    places = zip(begin[at].tolist(), stop[at + min_words - 1].tolist(), strict=True)
    digest = b"".join(hashlib.blake2b(joined[a:b], digest_size=16).digest() for a, b in places)
    return at, np.frombuffer(digest, np.int64).reshape(-1, 2)


def _chunk_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows: tuple[list, list, list, list, list] = ([], [], [], [], [])
                for k, t in enumerate(part.column(2)):
                    found = chunks(t.as_py() or "", min_words)[:4]
                    rows[0].extend([k] * len(found[0]))
                    for have, new in zip(rows[1:], found, strict=True):
                        have.extend(new)
                at = pa.array(rows[0], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c).take(at) for c in (0, 1)), *(pa.array(x, pa.int32()) for x in rows[1:3]), *(pa.array(x, pa.int64()) for x in rows[3:])],
                    names=["th", "key", "lo", "hi", "chunk", "span"],
                )

    return run


def _gram_rows(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                found = [grams(t.as_py(), [(x["lo"], x["hi"]) for x in s.as_py()], min_words) for t, s in zip(part.column(2), part.column(3), strict=True)]
                doc = pa.array(np.repeat(np.arange(len(found)), [len(at) for at, _ in found]))
                at, digest = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(doc), part.column(1).take(doc), pa.array(at.astype(np.int32)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy())],
                    names=["th", "key", "lo", "g1", "g2"],
                )

    return run


def _meet(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with the columns of their key in ``held``, which counts each key's rows in ``places``.

    A key of more than 1 / (4 x partitions) of the rows is hot. There are at most 4 x
    partitions of them, so they are broadcast, and their rows stay where they are.
    """
    held = write_table(held, "held")
    share = rows.agg((F.count(F.lit(1)) / (4 * shuffle_partitions(rows.sparkSession))).alias("share")).first().share
    hot = F.broadcast(held.where(F.col("places") > share).drop("places"))
    cold = held.where(F.col("places") <= share).drop("places")
    spread = rows.join(hot, keys)
    return spread.unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(cold, keys))


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per repeated passage: ``doc_id, th, first_word, n_words, keep_id, kept``.

    A stretch of ``min_words`` words is repeated if two or more documents hold it, and
    the smallest of them keeps it. A passage is a longest run of such stretches, each
    a word after the one before, that also follow each other in the keeping
    document: ``keep_id`` holds the whole passage. ``first_word`` and ``n_words``
    count white-space separated words of the text, ``th`` is the text's hash;
    ``kept`` marks the keeping document's own rows. Where the keeper changes, one
    passage ends and the next begins, and the two share up to ``min_words - 1``
    words. Case and white space don't matter. Rows with the
    same ``doc_id`` are one document, and so are rows with a null one (it sorts
    first); equal rows give one result. Null and empty texts have no passages; other
    columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    null_key = F.lit(-(1 << 63)).cast("long")
    text = clean_text("text")
    rows = docs.select(F.xxhash64(text).alias("th"), F.coalesce(F.col("doc_id").cast("long"), null_key).alias("key"), text.alias("text"))
    table = write_table(rows.mapInArrow(_chunk_rows(min_words), "th long, key long, lo int, hi int, chunk long, span long"), "chunks")
    shared = (
        table.groupBy("chunk")
        .agg(F.min("key").alias("keep"), F.max("key").alias("most"), F.min("span").alias("a"), F.max("span").alias("b"), F.count(F.lit(1)).alias("places"))
        .where("keep < most")
        .select("chunk", "keep", F.expr("a = b").alias("alike"), "places")
    )
    hit = write_table(_meet(table.drop("span"), shared, ["chunk"]), "shared-chunks")
    # Where a window stands, as one number in the order of the documents: a struct would be sorted, not hashed.
    place = F.expr("cast(key as decimal(20,0)) * 4611686018427387904BD + cast((th & 2147483647) * 2147483648 + lo as decimal(20,0))").cast("decimal(38,0)")
    alike = hit.where("alike").drop("alike")
    whole = _meet(alike, alike.groupBy("chunk").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("places")), ["chunk"]).drop("chunk")
    spans = hit.where("not alike").groupBy("key", "th").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # bounded by a text
    texts = rows.join(spans, ["key", "th"]).select("th", "key", "text", "spans")
    table = write_table(texts.mapInArrow(_gram_rows(min_words), "th long, key long, lo int, g1 long, g2 long"), "grams")
    held = (
        table.groupBy("g1", "g2")
        .agg(F.min("key").alias("keep"), F.max("key").alias("most"), F.min(place).alias("place"), F.count(F.lit(1)).alias("places"))
        .where("keep < most")
        .drop("most")
    )
    single = _meet(table, held, ["g1", "g2"]).select("key", "th", "lo", F.col("lo").alias("hi"), "keep", "place")
    windows = whole.select("key", "th", "lo", "hi", "keep", "place").union(single).groupBy("key", "th", "lo", "hi").agg(F.min("keep").alias("keep"), F.min("place").alias("place"))
    along = Window.partitionBy("key", "th").orderBy("lo")  # bounded by a text
    before = lambda c: F.lag(c).over(along)
    follows = (F.col("lo") == before("hi") + 1) & (F.col("place") == before("place") + before("hi") - before("lo") + 1)
    runs = (
        windows.withColumn("fresh", F.when(follows, 0).otherwise(1))
        .withColumn("run", F.sum("fresh").over(along))
        .groupBy("key", "th", "run")
        .agg(F.min("lo").alias("first_word"), (F.max("hi") - F.min("lo") + min_words).cast("long").alias("n_words"), F.min("keep").alias("keep"))
    )
    id_of = lambda c: F.when(F.col(c) != null_key, F.col(c)).cast(docs.schema["doc_id"].dataType)
    return runs.select(
        id_of("key").alias("doc_id"), "th", F.col("first_word").cast("long").alias("first_word"), "n_words", id_of("keep").alias("keep_id"), (F.col("key") == F.col("keep")).alias("kept")
    )


def _cut(text: str, spans: list[tuple[int, int, bool]]) -> str:
    """The text without the words of the spans (first word, number of words, kept) that are in no kept one."""
    of = lambda kept: {w for first, n, k in spans if k == kept for w in range(first, first + n)}
    gone = of(False) - of(True)
    out, at = [], 0
    for k, m in enumerate(_WORD.finditer(text)):
        if k in gone:
            out.append(text[at : m.start()])
            at = m.end()
    return "".join([*out, text[at:]])


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The input with every repeated passage cut from ``text`` but for the document that keeps it.

    Words that a document shares between a passage it keeps and another one stay.
    """
    own_id, own_th, own_spans, own_all = fresh(docs, "_id", "_th", "_spans", "_all")
    spans = (
        find_repeats(docs, min_words)
        .groupBy(F.col("doc_id").alias(own_id), F.col("th").alias(own_th))
        .agg(F.collect_list(F.struct("first_word", "n_words", "kept")).alias(own_spans), F.bool_and("kept").alias(own_all))
        .where(~F.col(own_all))
        .drop(own_all)
    )
    cut = F.udf(lambda t, s: _cut(t or "", [tuple(x) for x in s or ()]), "string", useArrow=True)
    at = docs["doc_id"].eqNullSafe(F.col(own_id)) & (F.xxhash64(clean_text("text")) == F.col(own_th))
    joined = docs.join(spans, at, "left").drop(own_id, own_th)
    return joined.withColumn("text", F.when(F.col(own_spans).isNull(), F.col("text")).otherwise(cut("text", own_spans))).drop(own_spans)

"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

Signature: 65 MinHash values of the word shingles, 12 bits each, five to a long.
Two documents of similarity s differ in each value with probability about 1 - s.
The 13 longs are the chunks of the index. If two signatures differ in at most 25
values, some chunk differs in at most one (13 * 2 > 25); leaving out one value of
a chunk enumerates all such errors, so each document has 65 index keys and every
pair within distance 25 shares one. At similarity 0.85 a distance over 25 has
probability under 1e-6. Pairs somewhat further apart nearly always share a key too
and are looked at up to six standard deviations over the mean distance.

Documents with equal shingle sets are one class; only classes are joined. In each
bucket, members are first held against the bucket's smallest class (one row
per member), and linked ones become components. Only buckets that then hold
several components are joined further, rows outside the bucket's main component
against the others; a large group of copies is resolved by the first step and
emits no pairs among its members.

A pair is a candidate if its signatures are within the distance and its odd
sketches allow the similarity (each element of the symmetric difference flips
one bit, so the number of differing bits never exceeds it). Candidates are
confirmed on their full shingle sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import clean_text, fresh, small_batches, write_table
from riskframe.llm.components import components

SHINGLE = 5
CHUNKS, LANES, LANE_BITS = 13, 5, 12
VALUES = CHUNKS * LANES
DISTANCE = 2 * CHUNKS - 1
ODD_LONGS = 8
LANE = (1 << LANE_BITS) - 1
LOW = sum(((1 << (LANE_BITS - 1)) - 1) << (LANE_BITS * i) for i in range(LANES))
TOP = sum(1 << (LANE_BITS * i + LANE_BITS - 1) for i in range(LANES))
NO_ID = (1 << 63) - 1
BLOCK = 4096
KNOWN_WORDS = 1 << 17

_rng = np.random.Generator(np.random.PCG64(20240601))
_TIMES = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """Word -> 64-bit hash; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, known: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; of the whole sequence if it is shorter."""
    words = text.encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = len(ids) - SHINGLE + 1
    if n < 1:
        return np.array([xxhash.xxh64_intdigest(ids.tobytes(), seed=len(ids))], np.uint64)
    h = ids[:n].copy()
    for k in range(1, SHINGLE):
        h *= _STEP
        h ^= h >> np.uint64(31)
        h += ids[k : k + n]
    h *= _STEP
    h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(elements: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MinHash values packed into CHUNKS longs, and the odd sketch in ODD_LONGS longs."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(elements), BLOCK):
        part = elements[None, k : k + BLOCK] ^ _PLUS[:, None]
        part *= _TIMES[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    lanes = ((least * _STEP) >> np.uint64(64 - LANE_BITS)).reshape(CHUNKS, LANES)
    packed = np.zeros(CHUNKS, np.uint64)
    for i in range(LANES):
        packed |= lanes[:, i] << np.uint64(LANE_BITS * i)
    bit = (elements * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(55)  # 0 .. 511
    odd = np.packbits((np.bincount(bit.astype(np.int64), minlength=64 * ODD_LONGS) & 1).astype(np.uint8)).view(np.uint64)
    return packed, odd


SIG = [f"s{i}" for i in range(CHUNKS)]
ODD = [f"o{i}" for i in range(ODD_LONGS)]
SIGNED = "key long, th long, n long, d1 long, d2 long, " + ", ".join(f"{c} long" for c in SIG + ODD)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()  # a task's own, so that it goes with the task
    for batch in batches:
        out = np.zeros((batch.num_rows, 3 + CHUNKS + ODD_LONGS), np.int64)
        for k, t in enumerate(batch.column(2)):
            s = shingles(t.as_py() or "", known)
            if len(s):
                packed, odd = signature(s)
                digest = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                out[k] = [len(s), *digest, *packed.view(np.int64), *odd.view(np.int64)]
        names = ["key", "th", "n", "d1", "d2", *SIG, *ODD]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c) for c in out.T)], names=names)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Words()
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([shingles(t.as_py() or "", known).tobytes() for t in part.column(1)], pa.binary())], names=["cid", "elements"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def index_keys() -> Column:
    """Each chunk with one value left out: every way in which it may differ in one value."""
    return F.array(
        *[F.xxhash64(F.lit(c * LANES + i), F.col(SIG[c]).bitwiseAND(F.lit(~(LANE << (LANE_BITS * i))).cast("long"))) for c in range(CHUNKS) for i in range(LANES)]
    )


def reach(percent: int) -> int:
    """The signature distance up to which pairs that share a key are looked at: the
    guaranteed one, or six standard deviations over the mean at the similarity."""
    apart = 1 - percent / 100
    return max(DISTANCE, math.ceil(VALUES * apart + 6 * math.sqrt(VALUES * apart * (1 - apart))))


def _unlike(p: str, q: str, chunk: str) -> Column:
    """The top bit of each lane in which two rows' chunks differ."""
    low, top = F.lit(LOW).cast("long"), F.lit(TOP).cast("long")
    x = F.col(f"{p}.{chunk}").bitwiseXOR(F.col(f"{q}.{chunk}"))
    return (x.bitwiseAND(low) + low).bitwiseOR(x).bitwiseAND(top)


def _close(p: str, q: str, percent: int) -> Column:
    """Whether two rows' signatures are within the distance and their odd sketches allow the similarity."""
    lanes = [F.bit_count(_unlike(p, q, c)) for c in SIG]
    flips = [F.bit_count(F.col(f"{p}.{c}").bitwiseXOR(F.col(f"{q}.{c}"))) for c in ODD]
    total = F.col(f"{p}.n") + F.col(f"{q}.n")
    slack = 100 - percent  # similarity >= percent <=> (100 + percent) * |A xor B| <= slack * (|A| + |B|)
    return (
        (F.abs(F.col(f"{p}.n") - F.col(f"{q}.n")) * (100 + percent) <= total * slack)
        & (sum(flips[1:], flips[0]) * (100 + percent) <= total * slack)
        & (sum(lanes[1:], lanes[0]) <= reach(percent))
    )


def _first_slot(p: str, q: str) -> Column:
    """The first of the index keys that two rows share: the first chunk that differs in
    one lane at most, and in it the lane left out (any, so the first, if none differs)."""
    slot = F.lit(None).cast("int")
    for k in reversed(range(CHUNKS)):
        bits = _unlike(p, q, SIG[k])
        lane = F.when(bits == 0, 0).otherwise((F.bit_count(bits - 1) / LANE_BITS).cast("int"))
        slot = F.when(F.bit_count(bits) <= 1, k * LANES + lane).otherwise(slot)
    return slot


class _Corpus:
    """The tables of one run."""

    def __init__(self, docs: DataFrame, percent: int):
        self.percent = percent
        small_batches(docs.sparkSession)
        text = clean_text("text")
        self.texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.xxhash64(text).alias("th"), text.alias("text"))
        self.signed = write_table(self.texts.mapInArrow(_sign, SIGNED), "signatures")
        firsts = [F.first(c).alias(c) for c in SIG + ODD]
        classes = self.signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("key", "th")).alias("rep"), *firsts)
        self.classes = write_table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def buckets(self) -> DataFrame:
        """``bucket, slot, cid, lead`` of the index buckets with several classes; slot is the key's number, lead the smallest class."""
        keys = self.classes.select("cid", F.posexplode(index_keys()).alias("slot", "bucket"))
        several = keys.groupBy("bucket").agg(F.min("cid").alias("lead"), F.max("cid").alias("most")).where("lead < most").select("bucket", "lead")
        return write_table(keys.join(several, "bucket"), "buckets")

    def elements(self, cids: DataFrame) -> DataFrame:
        """``cid, elements``: the full shingle sets of some classes, from their first document's text."""
        wanted = self.classes.join(cids, "cid", "left_semi").select("cid", "rep.key", "rep.th")
        found = self.texts.join(wanted, ["key", "th"]).select("cid", "text").groupBy("cid").agg(F.first("text").alias("text"))
        return write_table(found.mapInArrow(_sets, "cid long, elements binary"), "elements")

    def confirmed(self, pairs: DataFrame, elements: DataFrame) -> DataFrame:
        """The pairs ``a, b`` whose full sets are similar enough."""
        left = elements.select(F.col("cid").alias("a"), F.col("elements").alias("x"))
        right = elements.select(F.col("cid").alias("b"), F.col("elements").alias("y"))
        return write_table(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_confirm(self.percent), "a long, b long"), "links")

    def star_candidates(self, buckets: DataFrame) -> DataFrame:
        stars = buckets.where("cid <> lead").select(F.col("lead").alias("a"), F.col("cid").alias("b")).distinct().alias("e")
        p, q = self.classes.alias("p"), self.classes.alias("q")
        joined = stars.join(p, F.col("e.a") == F.col("p.cid")).join(q, F.col("e.b") == F.col("q.cid"))
        return joined.where(_close("p", "q", self.percent)).select("e.a", "e.b")

    def cross_candidates(self, buckets: DataFrame, roots: DataFrame) -> DataFrame:
        """Candidates between different components within a bucket."""
        labelled = (
            buckets.select("bucket", "slot", "cid")
            .join(roots.withColumnRenamed("v", "cid"), "cid", "left")
            .select("bucket", "slot", "cid", F.coalesce("root", "cid").alias("root"))
        )
        labelled = write_table(labelled, "labelled")
        main = (
            labelled.groupBy("bucket", "root")
            .agg(F.count(F.lit(1)).alias("m"))
            .groupBy("bucket")
            .agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("m", "root")).alias("main"))
            .where("roots > 1")
            .select("bucket", F.col("main.root").alias("main"))
        )
        mixed = labelled.join(main, "bucket")
        rows = write_table(mixed.join(self.classes.select("cid", "n", *SIG, *ODD), "cid"), "mixed")
        p, q = rows.where("root <> main").alias("p"), rows.alias("q")
        once = (F.col("q.root") == F.col("q.main")) | (F.col("p.cid") < F.col("q.cid"))
        # A pair may share many buckets; only the first one makes a row of it.
        first = _first_slot("p", "q") == F.col("p.slot")
        on = (F.col("p.bucket") == F.col("q.bucket")) & (F.col("p.root") != F.col("q.root")) & once & _close("p", "q", self.percent) & first
        return p.join(q, on).select(F.col("p.cid").alias("a"), F.col("q.cid").alias("b")).distinct()


def _resolve(docs: DataFrame, percent: int) -> tuple[_Corpus, DataFrame]:
    """The run's tables, and for each class ``n, d1, d2`` the ``least`` (key, text hash) of its component."""
    run = _Corpus(docs, percent)
    buckets = run.buckets()
    elements = run.elements(buckets.select("cid").distinct())
    links = run.confirmed(run.star_candidates(buckets), elements)
    roots = write_table(components(links), "roots")
    across = run.confirmed(run.cross_candidates(buckets, roots), elements)
    p, q = roots.alias("p"), roots.alias("q")
    joins = (
        across.join(p, F.col("a") == F.col("p.v"), "left")
        .join(q, F.col("b") == F.col("q.v"), "left")
        .select(F.coalesce("p.root", "a").alias("a"), F.coalesce("q.root", "b").alias("b"))
    )
    merged = write_table(components(joins), "merged").select(F.col("v").alias("root"), F.col("root").alias("top"))
    tops = (
        run.classes.select("n", "d1", "d2", "cid", "rep")
        .join(roots.withColumnRenamed("v", "cid"), "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
        .join(merged, "root", "left")
        .select("n", "d1", "d2", "rep", F.coalesce("top", "root").alias("top"))
    )
    tops = write_table(tops, "tops")
    least = tops.groupBy("top").agg(F.min("rep").alias("least"))
    return run, tops.join(least, "top").select("n", "d1", "d2", "least")


def near_components(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Links documents whose sets of 5-word shingles have a Jaccard similarity of at
    least ``percent`` / 100; ``component_id`` is the smallest ``doc_id`` reachable
    and ``kept`` marks rows with that id. Words are what stands between ASCII white
    space, A-Z lower-cased; fewer than five are one shingle; null, empty and blank
    texts have none and are linked with nothing. A null id sorts after all others,
    and a component of null ids only has a null ``component_id``. Repeated rows fall
    in one component; other columns are ignored; an empty table gives an empty
    result.
    """
    run, least = _resolve(docs, percent)
    joined = run.signed.select("key", "n", "d1", "d2").join(least, ["n", "d1", "d2"], "left")
    kind = docs.schema["doc_id"].dataType
    known = lambda c: F.when(c != NO_ID, c).cast(kind)
    component = F.coalesce(F.col("least.key"), F.col("key"))
    return joined.select(
        known(F.col("key")).alias("doc_id"), F.col("n").alias("n_shingles"), known(component).alias("component_id"), (F.col("key") == component).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The input without near duplicates: of each component the row with the smallest id (then text hash) stays.

    Rows, links and nulls as in ``near_components``; texts without words all stay. Of
    repeated rows (same id and text) one stays. All columns are kept.
    """
    run, least = _resolve(docs, percent)
    own_key, own_th, own_each = fresh(docs, "__key", "__th", "__each")
    stay = write_table(least.select(F.col("least.key").alias(own_key), F.col("least.th").alias(own_th)).distinct(), "survivors")
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    blank = ~text.rlike("[^\\x20\\x09-\\x0D]")
    on = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col(own_key)) & (F.xxhash64(text) == F.col(own_th))
    kept = docs.join(stay, on, "left").where(F.col(own_key).isNotNull() | blank)
    repeated = run.signed.where("n > 0").groupBy("key", "th").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    if not repeated.isEmpty():
        each = F.when(F.col(own_key).isNull(), F.monotonically_increasing_id())  # blank texts are no copies
        kept = kept.withColumn(own_each, each).dropDuplicates([own_key, own_th, own_each]).drop(own_each)
    return kept.drop(own_key, own_th)


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS sh
  FROM d),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 85 * (na + nb - shared)),
ll AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (
  SELECT doc_id AS v, doc_id AS u FROM s
  UNION
  SELECT reach.v, ll.b FROM reach JOIN ll ON ll.a = reach.u),
c AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id, s.doc_id = c.component_id AS kept
FROM s JOIN c ON c.v = s.doc_id
"""

"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item of m letters may differ from its place in a document by up to
k = error_rate * m edits. Cut into k + 1 pieces, at least one piece stands in the
document unchanged. All pieces of a block of items go into one Aho-Corasick
automaton; every hit names a window of the document in which the item may stand,
and Myers' bit-parallel algorithm gives the least edit distance in the window.

Both sides are compared as lower-case words with single spaces, so punctuation,
case and layout cost no edits. A short item has no budget: it is its own single
piece and must stand between word bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskframe.llm.common import Shared, latest, small_batches

ERROR_RATE = 0.05
SHORT_LETTERS = 40  # items under it must stand word for word
BLOCK_LETTERS = 4_000_000
# ASCII that is neither letter nor digit stands between words.
_BREAKS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_only(text: str) -> str:
    raw = text.lower().encode("utf-8", "replace").translate(_BREAKS)
    return b" ".join(raw.split()).decode("utf-8")


def budget(letters: int, error_rate: float, short: int = 0) -> int:
    return 0 if letters < short else max(1, int(letters * error_rate))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``errors + 1`` pieces of nearly equal length."""
    n, at, out = errors + 1, 0, []
    for k in range(n):
        end = (k + 1) * len(item) // n
        out.append((at, item[at:end]))
        at = end
    return out


def myers(item: str, window: str, errors: int) -> tuple[int, int] | None:
    """Least edit distance of the item to any substring of the window, and that substring's end.

    One bit per letter of the item holds the differences down a column of the
    distance matrix; a column takes a dozen operations on whole words of bits.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, None
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        x = eq | minus
        diag = (((eq & plus) + plus) ^ plus) | eq
        h_plus = minus | (full & ~(diag | plus))
        h_minus = plus & diag
        if h_plus & top:
            score += 1
        elif h_minus & top:
            score -= 1
        h_plus = (h_plus << 1) & full
        h_minus = (h_minus << 1) & full
        plus = h_minus | (full & ~(x | h_plus))
        minus = h_plus & x
        if score <= errors and (best is None or score < best[0]):
            best = (score, j + 1)
    return best


class Matcher:
    """The automaton of a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float, short: int = SHORT_LETTERS):
        self.items = []
        holders: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            k = budget(len(text), error_rate, short)
            for off, piece in pieces(text, k):
                holders.setdefault(piece, []).append((len(self.items), off))
            self.items.append((item_id, text, k))
        self.automaton = ahocorasick.Automaton()
        for piece, held_by in holders.items():
            self.automaton.add_word(piece, (len(piece), held_by))
        if holders:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """(item id, distance, budget, end in the normalised text) of each item found, its best place first."""
        if not self.items:
            return []
        doc = words_only(text)
        best: dict[int, tuple[int, int]] = {}
        seen: dict[int, list[tuple[int, int]]] = {}
        for end, (length, held_by) in self.automaton.iter(doc):
            for n, off in held_by:
                _, item, k = self.items[n]
                start = end - length + 1 - off
                if not k:
                    if n not in best and (not start or doc[start - 1] == " ") and (end + 1 == len(doc) or doc[end + 1] == " "):
                        best[n] = (0, end + 1)
                    continue
                lo, hi = max(0, start - k), min(len(doc), start + len(item) + k)
                if hi - lo < len(item) - k or n in best and best[n][0] == 0:
                    continue
                if any(a <= lo and hi <= b for a, b in seen.get(n, ())[-4:]):
                    continue  # this window has been searched
                # A little more on both sides, so that the item's other pieces fall in the same window.
                lo, hi = max(0, lo - k), min(len(doc), hi + k)
                seen.setdefault(n, []).append((lo, hi))
                if (hit := myers(item, doc[lo:hi], k)) and (n not in best or hit[0] < best[n][0]):
                    best[n] = (hit[0], lo + hit[1])
        return [(self.items[n][0], d, self.items[n][2], e) for n, (d, e) in sorted(best.items())]


def _blocks(benchmark: DataFrame, error_rate: float, short: int, block_letters: int) -> Iterator[Shared]:
    """The normalised items in broadcast blocks of about ``block_letters``, one at a time on the driver."""
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    letters = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-letters // block_letters))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).orderBy("item_id", "text").collect()  # a block
        block = [(r.item_id, t) for r in rows if (t := words_only(r.text))]
        yield Shared(spark, (block, error_rate, short))


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, short: int = SHORT_LETTERS, block_letters: int = BLOCK_LETTERS
) -> DataFrame:
    """One row per (document row, item found in it): ``doc_id, item_id, distance, budget, end``.

    ``distance`` is the least edit distance of the item to a stretch of the
    document, at most ``budget``; ``end`` is where the first such stretch ends in the
    normalised text. Items under ``short`` normalised letters have budget 0 and are
    found word for word; items without a letter or digit stand nowhere. Null and
    empty texts hold nothing.
    Repeated document rows give repeated results; repeated items give one. An empty
    table on either side gives an empty result; other columns are ignored.
    """
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, distance int, budget int, end long"
    out = None
    for shared in _blocks(benchmark, error_rate, short, block_letters):
        part = texts.mapInArrow(_pairs(shared, to_arrow_type(benchmark.schema["item_id"].dataType)), schema)
        out = part if out is None else out.union(part)
    return out


def _pairs(shared, item_type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = latest(shared, lambda v: Matcher(*v))
        for batch in batches:
            found, take = [], []
            for k, t in enumerate(batch.column(1)):
                for hit in matcher.find(t.as_py() or ""):
                    found.append(hit)
                    take.append(k)
            column = lambda n, kind, found=found: pa.array([hit[n] for hit in found], kind)
            ids = batch.column(0).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, column(0, item_type), column(1, pa.int32()), column(2, pa.int32()), column(3, pa.int64())],
                names=["doc_id", "item_id", "distance", "budget", "end"],
            )

    return run


def drop_leaked(
    docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, short: int = SHORT_LETTERS, block_letters: int = BLOCK_LETTERS
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns, unshuffled.

    A filter over each row's own text, block of items by block of items; nulls and
    repeated rows as in ``find_leaks``.
    """
    out = docs
    for shared in _blocks(benchmark, error_rate, short, block_letters):
        out = out.mapInArrow(_without(shared, docs.columns.index("text")), docs.schema)
    return out


def _without(shared, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = latest(shared, lambda v: Matcher(*v))
        for batch in batches:
            yield batch.filter(pa.array([not matcher.find(t.as_py() or "") for t in batch.column(text_at)], pa.bool_()))

    return run

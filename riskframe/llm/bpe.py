"""Byte-level BPE as a streaming transducer with bounded lookahead.

A merge can change a token only through a chain of merges of falling priority
that each take the token to the left of the last. ``sufficient_lookahead``
computes the longest such chain of a merge list, in bytes: a token that ends so
many bytes before the last byte read is what it will be, whatever follows. The
transducer keeps a window of bytes, merges it, emits the stable tokens and drops
them, so its memory does not grow with the text or with its longest word.

Decoding is a state machine over token bytes that emits text once a character
is complete, and U+FFFD for bytes that can't be part of one.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riskframe.llm.common import Shared, latest, small_batches

# Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 1 << 15
CACHE_WORDS = 1 << 17
SHORT = 48
_BYTES = [bytes([b]) for b in range(256)]


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary, as letter -> byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_vocabulary(path: str) -> dict:
    """Ids, merges and special strings of a byte-level BPE file, as bytes and plain tuples."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    of = byte_letters()
    raw = lambda s: bytes(of[c] for c in s)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    merges = [tuple(map(raw, m if isinstance(m, list) else m.split(" "))) for m in spec["model"]["merges"]]
    return {"vocab": vocab, "merges": merges, "special": special}


def check_proper(merges: list[tuple[bytes, bytes]]) -> None:
    """Every part of a merge must be a byte or made by exactly one earlier merge; else a ValueError."""
    made: set[bytes] = set()
    for a, b in merges:
        if any(len(x) > 1 and x not in made for x in (a, b)) or a + b in made:
            raise ValueError(f"not a proper merge list at {a!r} {b!r}")
        made.add(a + b)


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that fix it, for a proper merge list.

    Take two texts that agree up to some byte. Left of a frontier their tokens
    agree. The frontier moves only when a merge (u, x) happens in one text and
    not in the other, by ``len(u)``, to the start of u; the next move is a later
    merge (u', y) whose right part y starts there, so y starts with u. The
    longest chain by total length of its left parts, plus the longest token for
    the one that the end of the window cuts, bounds the frontier's way.
    """
    best: dict[bytes, int] = {}
    furthest, longest = 0, 1
    for a, b in merges:
        way = len(a) + max((best.get(b[:k], 0) for k in range(1, len(b) + 1)), default=0)
        best[a] = max(best.get(a, 0), way)
        furthest, longest = max(furthest, way), max(longest, len(a) + len(b))
    return furthest + longest


def merge_short(piece: bytes, ranks: dict[tuple[bytes, bytes], int], of_bytes: list[list[int]]) -> list[bytes]:
    """The same as ``merge_all`` for a short piece: the ranks of all neighbours are searched for the least.

    ``of_bytes``: the rank of each pair of single bytes, ``len(ranks)`` where there is none.
    """
    none, rank = len(ranks), ranks.get
    parts = [_BYTES[b] for b in piece]
    at = [of_bytes[a][b] for a, b in zip(piece, piece[1:], strict=False)]
    while at and (least := min(at)) < none:
        i = at.index(least)
        new = parts[i] = parts[i] + parts.pop(i + 1)
        del at[i]
        if i:
            at[i - 1] = rank((parts[i - 1], new), none)
        if i < len(at):
            at[i] = rank((new, parts[i + 1]), none)
    return parts


def merge_all(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> list[bytes]:
    """Apply the lowest-ranked merge, leftmost first, until none applies."""
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) < 2:
        return [p for p in parts if p]
    after = [*range(1, len(parts)), -1]
    before = [*range(-1, len(parts) - 1)]
    heap = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j < 0 or ranks.get((parts[i], parts[j])) != r:
            continue  # what stood here has merged meanwhile
        parts[i] += parts[j]
        parts[j] = None
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (n := ranks.get((parts[k], parts[after[k]]))) is not None:
                heapq.heappush(heap, (n, k))
    return [p for p in parts if p is not None]


class Transducer:
    """Bytes of one word in, stable tokens out; keeps at most ``window`` bytes plus one feed."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], lookahead: int):
        self.ranks, self.lookahead = ranks, lookahead
        self.window = 4 * lookahead
        self.held = b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.held += data
        while len(self.held) > self.window:
            tokens, end = merge_all(self.held[: self.window], self.ranks), 0
            for t in tokens:
                if end + len(t) > self.window - self.lookahead:
                    break
                end += len(t)
                yield t
            self.held = self.held[end:]

    def finish(self) -> Iterator[bytes]:
        tokens, self.held = merge_all(self.held, self.ranks), b""
        yield from tokens


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, vocabulary: dict):
        check_proper(vocabulary["merges"])
        self.vocab, self.special = vocabulary["vocab"], vocabulary["special"]
        self.ranks = {m: r for r, m in enumerate(vocabulary["merges"])}
        self.of_bytes = [[self.ranks.get((a, b), len(self.ranks)) for b in _BYTES] for a in _BYTES]
        self.lookahead = sufficient_lookahead(vocabulary["merges"])
        # Ids of the latest words, and of those before them: bounded, and hot words stay.
        self.words: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.split = regex.compile(PATTERN)
        # Longest first, so that a special string that starts with another wins.
        names = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.bytes_of = {i: t for t, i in self.vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.name_of = {i: str(i) for i in self.bytes_of}
        self.gap = regex.compile(r"(?<=\S)\s")

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a word that is not among the latest ones."""
        if (out := self.older.get(word)) is None:
            raw = word.encode("utf-8", "surrogatepass")
            out = tuple(map(self.vocab.__getitem__, merge_short(raw, self.ranks, self.of_bytes) if len(raw) <= SHORT else self._stream(raw)))
        if len(word) <= SHORT:
            if len(self.words) >= CACHE_WORDS:
                self.older = dict(self.words)
                self.words.clear()
            self.words[word] = out
        return out

    def _stream(self, raw: bytes) -> Iterator[bytes]:
        machine = Transducer(self.ranks, self.lookahead)
        for k in range(0, len(raw), machine.window):
            yield from machine.feed(raw[k : k + machine.window])
        yield from machine.finish()

    def _blocks(self, text: str) -> Iterator[str]:
        """Cut the text where a word surely ends: before white space that follows a non-space."""
        at = 0
        while len(text) - at > 2 * BLOCK_CHARS and (m := self.gap.search(text, at + BLOCK_CHARS)):
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]

    def encode(self, text: str) -> Iterator[list[int]]:
        """The ids, in lists of a block each."""
        at = 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            yield from self._plain(text[at : m.start()])
            yield [self.special[m.group()]]
            at = m.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str) -> Iterator[list[int]]:
        known = self.words
        for block in self._blocks(text):
            words = self.split.findall(block)
            yield list(chain.from_iterable([known.get(w) or self._word(w) for w in words]))

    def decode(self, ids: Iterable[list[int]]) -> Iterator[str]:
        """The text of the ids, list by list; a character comes out once its last byte is in."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for part in ids:
            yield state.decode(b"".join(map(self.bytes_of.__getitem__, part)))
        yield state.decode(b"", True)


SCHEMA = "{id} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"

def digests(codec: Codec, text: str | None) -> tuple[int, str, str]:
    """Token count, digest of the decimal ids joined by commas, digest of the decoded text."""
    n, ids_sum, text_sum = 0, hashlib.sha256(), hashlib.sha256()

    def counted():
        nonlocal n
        for ids in codec.encode(text or ""):
            if ids:
                ids_sum.update((("," if n else "") + ",".join(map(codec.name_of.__getitem__, ids))).encode())
                n += len(ids)
                yield ids

    for piece in codec.decode(counted()):
        text_sum.update(piece.encode("utf-8", "surrogatepass"))
    return n, ids_sum.hexdigest(), text_sum.hexdigest()


def encode_digests(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id, n_tokens, ids_sha256, decoded_sha256``.

    The vocabulary is read on the driver and broadcast (its size is that of the
    file, whatever the corpus). Null text is empty text: no tokens, digests of
    nothing. Null ids and repeated rows are kept; other columns are ignored; no
    shuffle, and a lost task only repeats its own rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = Shared(spark, load_vocabulary(vocabulary_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = latest(shared, Codec)
        for batch in batches:
            rows = [digests(codec, t.as_py()) for t in batch.column(1)]
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return docs.select(id_col, docs[text_col].cast("string")).mapInArrow(run, SCHEMA.format(id=f"`{id_col}`", id_type=id_type))

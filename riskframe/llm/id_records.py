"""Token ids as framed binary records, with an offset index beside them.

``write_records`` sorts documents by id over range partitions; each task encodes
its documents and appends one record a document to its own shard. A record is

    length of the payload        8 bytes, little-endian
    masked checksum of those     4 bytes
    payload: the ids             2 bytes each if the vocabulary fits, else 4, little-endian
    masked checksum of it        4 bytes

Checksums are CRC-32 (zlib), rotated right by 15 bits plus a constant, so that a
checksum of bytes that hold checksums stays a good one. The index file of a
shard has one entry of fixed size per record (``ENTRY``): where it starts, how many
ids lie before it in the shard, how many it has, its document's id. Any record
is thus one read, which ``read_records`` uses to deal all records out in a
seeded random order without moving the data itself.

Files go to the shared folder through Arrow's file systems. A task names its
files anew on each attempt, and the manifest (one row a shard, a written
table) names those of the attempts that count: a lost executor's half-written
files are never read, and ``write_records`` deletes them at the end. Memory: a run
of ``RUN`` bytes of texts (of longer texts, a section), one document's ids and the
pieces remembered, which are two Arrow arrays. Reading takes one Python step a task,
so a core holds one Python worker.

The tokenizers library merges each distinct word. The texts of a run are cut at
blanks together, each distinct piece is looked up once, and the ids are dealt to all
its places; the pieces of the latest runs are remembered, and a few words of those that
aren't one word. Latin letters with marks after them, the usual piece, are parted without the split
pattern, and pieces with line breaks line by line, so that their words are found again. Longer texts and those
with special tokens are encoded one at a time. A tokenizer that isn't plain
byte-level BPE (no normalizer, no prefix blank) encodes whole texts with ``encode``.

Nulls and odd input: null text is empty text (the record holds the end id
alone); null ids come last; equal ids come in order of a hash of their texts,
then the texts, so repeated rows stand beside each other; ids that are no
integers are refused; other columns are ignored; an empty table has an empty manifest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from riskframe.llm.bpe import PATTERN, byte_letters
from riskframe.llm.common import Shared, clean_text, latest, shuffle_partitions, small_batches, write_table
from riskframe.session import checkpoint_dir

# The constant and the rotation of masked checksums.
MASK_DELTA = 0xA282EAD8
MASK_SHIFT = 15
ENTRY = np.dtype([("offset", "<u8"), ("first", "<u8"), ("tokens", "<u8"), ("id", "<i8"), ("known", "u1")])
HEAD, TAIL = 12, 4
INDEX_BLOCK = 4096
SECTION = 1 << 20
READ_ROWS = 256
RUN = 1 << 23  # bytes of texts that are encoded together
ROW = 64
KNOWN = 1 << 19  # pieces remembered between runs, about 25 bytes each
CACHE = 1 << 15  # pieces and words remembered as Python objects, about 200 bytes each
LONGEST_KEY = 48


def masked(crc: int) -> int:
    return (((crc >> MASK_SHIFT) | (crc << (32 - MASK_SHIFT))) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(zlib.crc32(head))), payload, struct.pack("<I", masked(zlib.crc32(payload)))))


def unframe(record: bytes) -> bytes:
    """The payload of a whole record; a ValueError names what doesn't hold."""
    if len(record) < HEAD + TAIL:
        raise ValueError("record cut off")
    n, crc = struct.unpack_from("<QI", record)
    if masked(zlib.crc32(record[:8])) != crc:
        raise ValueError("length and its checksum differ")
    if len(record) != HEAD + n + TAIL:
        raise ValueError("record cut off")
    payload = record[HEAD : HEAD + n]
    if masked(zlib.crc32(payload)) != struct.unpack_from("<I", record, HEAD + n)[0]:
        raise ValueError("payload and its checksum differ")
    return payload


class _Latest(dict):
    """Remembers the latest results of ``make``; two generations, so hot keys stay. Not those of long keys or, if ``one_line``, of several lines."""

    def __init__(self, make: Callable[[str], bytes], most: int, one_line: bool = False):
        self.make, self.most, self.one_line, self.older = make, most, one_line, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEY and not (self.one_line and "\n" in key):
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Text to ids as bytes of a fixed width."""

    def __init__(self, spec: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks share the cores already
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.tokenize = self.library.model.tokenize
        self.width = width(spec)
        self.pack = "<u2" if self.width == 2 else "<u4"
        told = json.loads(spec)
        pre = told.get("pre_tokenizer") or {}
        added = told.get("added_tokens") or []
        plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.by_word = (
            told["model"]["type"] == "BPE" and told.get("normalizer") is None and {k: pre.get(k, True) for k in plain} == plain
            and not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        self.special = {t["content"]: np.array([t["id"]], self.pack).tobytes() for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.id_bytes = [i.to_bytes(self.width, "little") for i in range(highest_id(spec) + 1)]
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile(r" (?=\S)")
        self.word = _Latest(self._word, CACHE)
        self.piece = _Latest(self._piece, CACHE, one_line=True)
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.binary())

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.pack).tobytes()
        out, at = [], 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            out += self._plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return b"".join([*out, *self._plain(text[at:])])

    def together(self, texts: pa.StringArray) -> Iterator[bytes]:
        """The ids of each text of a run."""
        if not self.by_word or len(texts) == 1 and pc.binary_length(texts[0]).as_py() > RUN:
            yield from map(self, (t.as_py() for t in texts))
            return
        alone = np.array([self.special_at is not None and self.special_at.search(t.as_py()) is not None for t in texts], bool)
        others = self._together(texts.filter(pa.array(~alone)))
        for i, by_itself in enumerate(alone):
            yield self(texts[i].as_py()) if by_itself else next(others)

    def _together(self, texts: pa.StringArray) -> Iterator[bytes]:
        if not len(texts):
            return
        lists = pc.split_pattern(texts, " ")
        pieces, starts = lists.flatten(), lists.offsets.to_numpy()
        first, coded = _distinct(pieces, starts)
        gap = pc.match_substring_regex(coded.dictionary, _GAP).to_numpy(zero_copy_only=False)
        if gap.any():  # no cut at the blank before these: they go to the piece before
            inner = ~first
            inner[inner] = gap[coded.indices.to_numpy()]
            heads = np.append(np.flatnonzero(~inner), len(pieces)).astype(np.int32)
            pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array(heads), pieces), " ")
            starts = np.searchsorted(heads, starts)
            first, coded = _distinct(pieces, starts)
        openings = pieces.filter(pa.array(first))
        ids = self._ids(coded.dictionary).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int32, len(ids) + 1, 4 * ids.offset) if len(ids) else np.zeros(1, np.int32)
        at, data = at[starts - np.arange(len(starts))].tolist(), memoryview(data or b"")
        for opening, a, b in zip(openings, at, at[1:], strict=False):
            yield b"".join((self._words(opening.as_py()), data[a:b]))

    def _ids(self, pieces: pa.StringArray) -> pa.BinaryArray:
        """The ids of distinct pieces, each with the blank before it; these are remembered before those of earlier runs."""
        at = pc.index_in(pieces, value_set=self.known)
        new = at.is_null().to_numpy(zero_copy_only=False)
        old = at.drop_null().to_numpy()
        made = pa.array(map(self._piece, pieces.filter(pa.array(new)).to_pylist()), pa.binary())
        place = np.empty(len(pieces), np.int64)
        place[~new] = old
        place[new] = len(self.known) + np.arange(len(made))
        ids = pa.concat_arrays([self.known_ids, made]).take(pa.array(place))
        usual = pc.and_not(pc.less_equal(pc.binary_length(pieces), LONGEST_KEY), pc.match_substring(pieces, "\n"))
        rest = np.ones(len(self.known), bool)
        rest[old] = False
        for name, latest_ones in (("known", pieces), ("known_ids", ids)):
            kept = latest_ones.filter(usual)[:KNOWN]
            setattr(self, name, pa.concat_arrays([kept, getattr(self, name).filter(pa.array(rest))[: KNOWN - len(kept)]]))
        return ids

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isprintable():  # only the blank has another letter
            letters = word.replace(" ", self.letters[0x20])
        else:
            letters = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.letters)
        return b"".join([self.id_bytes[t.id] for t in self.tokenize(letters)])

    def _piece(self, piece: str) -> bytes:
        """The ids of a blank and the piece after it."""
        stem = piece.rstrip(MARKS)
        if _is_word(stem):
            return self._word(" " + stem) if len(stem) == len(piece) else self.piece[stem] + self.word[piece[len(stem) :]]
        first, *rest = piece.split("\n")
        # A single line break between non-spaces is a word of its own.
        if not rest or not first or first[-1].isspace() or not all(rest) or any(x[0].isspace() or x[-1].isspace() for x in rest):
            return self._words(" " + piece)
        return b"".join([self.piece[first], *(self.word["\n"] + self._line(x) for x in rest)])

    def _line(self, line: str) -> bytes:
        """The ids of what stands after a line break."""
        stem = line.rstrip(MARKS)
        if not _is_word(stem):
            return self._words(line)
        return self.word[stem] if len(stem) == len(line) else self.word[stem] + self.word[line[len(stem) :]]

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.word.__getitem__, self.split.findall(text)))

    def _plain(self, text: str) -> Iterator[bytes]:
        """A blank before a non-space always begins a word, whatever stands before it: pieces begin there."""
        at, opening = 0, self._words
        while at < len(text) or not at:
            end = len(text)
            if end - at > 2 * SECTION and (m := self.cut.search(text, at + SECTION)):
                end = m.start()
            section = text[at:end]
            first, *rest = self.cut.split(section) if _GAPS.search(section) else section.split(" ")
            yield opening(first)
            yield b"".join(map(self.piece.__getitem__, rest))
            at, opening = end + 1, self.piece.__getitem__  # the blank at a cut is the next section's


_GAPS = re.compile(r" (?:\s|$)")
_GAP = r"\A(?:\z|[\t-\r\x{85}\p{Z}])"  # for Arrow: empty, or white space in front
MARKS = ".,;:!?"
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")


def _is_word(stem: str) -> bool:
    """Letters only, which are letters in every version of Unicode: one word by the split pattern, and marks after it another."""
    return stem.isalpha() if stem.isascii() else _LATIN.fullmatch(stem) is not None


def _distinct(pieces: pa.StringArray, starts: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Which pieces begin a text, and the others by their distinct values."""
    first = np.zeros(len(pieces), bool)
    first[starts[:-1]] = True
    return first, pieces.filter(pa.array(~first)).dictionary_encode()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, pa.StringArray]]:
    """Ids and texts of consecutive rows, of ``RUN`` bytes at most (a few more count for each row) or one row."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        begin = 0
        for i, n in enumerate(pc.add(pc.binary_length(batch.column(1)), ROW).to_pylist()):
            if size and size + n > RUN:
                yield _joined([*held, batch.slice(begin, i - begin)])
                held, size, begin = [], 0, i
            size += n
        held.append(batch.slice(begin))
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[list, pa.StringArray]:
    return [i for b in held for i in b.column(0).to_pylist()], pa.concat_arrays([b.column(1) for b in held]).cast(pa.string())


def highest_id(spec: str) -> int:
    told = json.loads(spec)
    vocab = told["model"].get("vocab", {})
    ids = vocab.values() if isinstance(vocab, dict) else range(len(vocab))
    return max([*ids, *(t["id"] for t in told.get("added_tokens") or [])], default=0)


def width(spec: str) -> int:
    """Bytes an id takes: 2 if all ids fit."""
    return 2 if highest_id(spec) < 1 << 16 else 4


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a folder that driver and executors share, and the path in it."""
    if re.match(r"file:|/", uri):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(uri)


MANIFEST = "shard int, file string, width int, n_records long, n_tokens long, n_bytes long"


class _Shard:
    """The two files of one attempt."""

    def __init__(self, folder: str, shard: int, bytes_per_id: int):
        files, path = _file_system(folder)
        files.create_dir(path, recursive=True)
        self.shard, self.width = shard, bytes_per_id
        self.name = f"part-{shard:06d}-{uuid.uuid4().hex}"
        self.data = files.open_output_stream(f"{path}/{self.name}.rec")
        self.index = files.open_output_stream(f"{path}/{self.name}.idx")
        self.records = self.tokens = self.bytes = 0
        self.entries: list[tuple] = []

    def add(self, doc_id: int | None, payload: bytes) -> None:
        n = len(payload) // self.width
        self.entries.append((self.bytes, self.tokens, n, doc_id or 0, doc_id is not None))
        if len(self.entries) >= INDEX_BLOCK:
            self._flush()
        record = frame(payload)
        self.data.write(record)
        self.records, self.tokens, self.bytes = self.records + 1, self.tokens + n, self.bytes + len(record)

    def _flush(self) -> None:
        self.index.write(np.array(self.entries, ENTRY).tobytes())
        self.entries.clear()

    def close(self) -> pa.RecordBatch:
        self._flush()
        self.index.close()
        self.data.close()
        row = {"shard": self.shard, "file": self.name, "width": self.width, "n_records": self.records, "n_tokens": self.tokens, "n_bytes": self.bytes}
        types = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))


def write_records(
    docs: DataFrame, tokenizer_path: str, end_id: int | None = None, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None
) -> DataFrame:
    """Write the ids of every text, each followed by ``end_id``, in ascending id order; the manifest.

    Manifest: ``shard`` (ascending as the ids), ``file`` (with the folder, without
    ``.rec`` or ``.idx``), ``width`` of an id, ``n_records, n_tokens, n_bytes`` and
    ``start``, the ids in all shards before.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise ValueError(f"{id_col} must be an integer column")
    spark = docs.sparkSession
    small_batches(spark, 256)
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = Shared(spark, f.read())
    bytes_per_id = width(shared.value)
    if end_id is not None and not 0 <= end_id < 1 << (8 * bytes_per_id):
        raise ValueError(f"{end_id} is no id of {bytes_per_id} bytes")
    end = b"" if end_id is None else end_id.to_bytes(bytes_per_id, "little")
    folder = f"{(folder or checkpoint_dir(spark)).rstrip('/')}/records-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, out = latest(shared, Encoder), None
        for doc_ids, texts in _runs(batches):
            for doc_id, ids in zip(doc_ids, encode.together(texts), strict=True):
                if out is None:
                    out = _Shard(folder, TaskContext.get().partitionId(), bytes_per_id)
                out.add(doc_id, ids + end)
        if out is not None:
            yield out.close()

    text = clean_text(text_col)
    # Only rows of one id and one text can crowd a range; they are alike, so a salt may part them.
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), salt.alias("salt"))
    dealt = keyed.repartitionByRange(shards or shuffle_partitions(spark), F.col("id").asc_nulls_last(), "h", "salt")
    ordered = dealt.sortWithinPartitions(F.col("id").asc_nulls_last(), "h", "text").select("id", "text")
    manifest = write_table(ordered.mapInArrow(run, MANIFEST), "records-manifest")
    _drop_strays(folder, {r["file"] for r in manifest.select("file").toLocalIterator()})
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def _drop_strays(folder: str, counted: set[str]) -> None:
    """Delete what attempts that don't count have left in this run's own folder."""
    files, path = _file_system(folder)
    for info in files.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        if os.path.splitext(info.base_name)[0] not in counted:
            files.delete_file(info.path)


INDEX = "id long, shard int, file string, width int, offset long, start long, n_tokens long"


def _blocks(manifest: DataFrame) -> DataFrame:
    """The places of index blocks, dealt out to tasks."""
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_records") - 1, F.lit(INDEX_BLOCK).cast("long"))).alias("at")
    blocks = manifest.where("n_records > 0").select("shard", "file", "width", "start", block)
    # A given number of tasks: these rows are few bytes but much work, which adaptive execution can't know.
    return blocks.repartition(shuffle_partitions(manifest.sparkSession), "file", "at")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index entries in each block."""
    names = INDEX.replace(",", "").split()[::2]
    for batch in batches:
        for shard, file, w, start, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            files, path = _file_system(file)
            with files.open_input_file(path + ".idx") as f:
                raw = f.read_at(INDEX_BLOCK * ENTRY.itemsize, at * ENTRY.itemsize)
            e = np.frombuffer(raw, ENTRY)
            whole = lambda c: e[c].astype(np.int64)  # noqa: E731, B023
            columns = [
                pa.array(whole("id"), pa.int64(), mask=e["known"] == 0), pa.array([shard] * len(e), pa.int32()), pa.array([file] * len(e), pa.string()),
                pa.array([w] * len(e), pa.int32()), pa.array(whole("offset")), pa.array(whole("first") + start), pa.array(whole("tokens")),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def read_index(manifest: DataFrame) -> DataFrame:
    """Every record's place, from the index files: ``id, shard, file, width, offset, start, n_tokens``."""
    return _blocks(manifest).mapInArrow(_entries, INDEX)


def _payloads(batch: pa.RecordBatch, opened: dict) -> Iterator[np.ndarray]:
    """The ids of each record of an index batch; the last file stays open."""
    for file, w, offset, n in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("file", "width", "offset", "n_tokens")), strict=True):
        if file not in opened:
            for f in opened.values():
                f.close()
            opened.clear()
            files, path = _file_system(file)
            opened[file] = files.open_input_file(path + ".rec")
        try:
            payload = unframe(opened[file].read_at(HEAD + n * w + TAIL, offset))
        except ValueError as e:
            raise ValueError(f"{file}.rec at {offset}: {e}") from None
        yield np.frombuffer(payload, "<u2" if w == 2 else "<u4")


def _read(places: DataFrame, value: str, of: Callable[[np.ndarray], object], kind: pa.DataType, blocks: bool) -> DataFrame:
    """Index rows, or those in index blocks, with ``value``: what ``of`` makes of a record's ids. One Python step: each is a worker beside it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict = {}
        for whole in _entries(batches) if blocks else batches:
            for at in range(0, whole.num_rows, READ_ROWS):
                batch = whole.slice(at, READ_ROWS)
                told = pa.array([of(ids) for ids in _payloads(batch, opened)], kind)
                yield pa.RecordBatch.from_arrays([*batch.columns, told], names=[*batch.schema.names, value.split()[0]])
        for f in opened.values():
            f.close()

    return places.mapInArrow(run, f"{INDEX}, {value}")


def read_records(manifest: DataFrame, seed: int | None = None) -> DataFrame:
    """``id, start, ids`` of every record: in file order, or (with a seed) dealt out in a random order that the seed fixes."""
    small_batches(manifest.sparkSession, 256)
    if seed is None:
        places = _blocks(manifest)
    else:
        places = read_index(manifest).withColumn("at", F.xxhash64(F.lit(seed), "shard", "offset")).repartitionByRange("at", "shard", "offset").sortWithinPartitions("at", "shard", "offset").drop("at")
    return _read(places, "ids array<int>", lambda ids: ids.astype(np.int32), pa.list_(pa.int32()), blocks=seed is None).select("id", "start", "ids")


def read_digests(manifest: DataFrame) -> DataFrame:
    """``id, start, n_tokens, ids_crc32`` of every record, from the files: CRC-32 of its ids as little-endian 32-bit integers."""
    crc = lambda ids: zlib.crc32(ids.astype("<u4").tobytes())
    return _read(_blocks(manifest), "ids_crc32 long", crc, pa.int64(), blocks=True).select("id", "start", "n_tokens", "ids_crc32")

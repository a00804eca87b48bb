"""Token-ID output: each document its own zstandard frame under one shared dictionary, with an offset index.

A file set is a folder with three tables. `dictionary` holds the shared
dictionary and its hash. `blocks` holds, in ascending doc_id order, rows of up
to BLOCK_DOCS documents: their ids, token counts, the offsets of their frames
in the payload, the payload, and the number of ids before the block in its
shard. `shards` holds the number of ids before each shard. One document is
read by decompressing one frame.

The tokenizer's work is memoised by pretoken. The byte-level BPE never merges
across pretokens, so a text's ids are those of its pretokens in order; what a
task has not seen yet goes to the tokenizer, everything else is a gather.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textops as T
from .scratch import new_path, written

BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: The dictionary is trained on about this many documents, the first by a hash of
#: their doc_id, and on this many neighbouring ids of each at most, from a place that a hash picks.
SAMPLE_DOCS, SAMPLE_IDS, DICTIONARY_BYTES = 1000, 4096, 1 << 16
#: Pretokens that a worker remembers, about 200 bytes each; pretokens joined in one text; bytes of texts at once.
MEMO_ENTRIES, JOINED, CHUNK_BYTES = 400_000, 512, 1 << 18
LEVEL = 3

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: Code points of white space.
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that stay with an apostrophe.
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


_UNKNOWN = 255


@cache
def _table() -> np.ndarray:
    out = np.full(0x110000, _UNKNOWN, np.uint8)
    out[_SPACES] = _SPACE
    return out


def _kinds(points: np.ndarray) -> np.ndarray:
    """The class of each code point; the table fills with what occurs."""
    table = _table()
    kind = table[points]
    if (kind == _UNKNOWN).any():
        for c in np.unique(points[kind == _UNKNOWN]).tolist():
            table[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
        kind = table[points]
    return kind


def pretoken_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pretokens of code points begin; offsets: of each document, and the end."""
    n = len(points)
    kind = _kinds(points)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    begins = edge[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    ends = np.ones(n, dtype=bool)  # the last of a run
    ends[:-1] = begins[1:]
    # Before a word, the last character of white space stands apart from the
    # rest; it joins the word where it is a plain space.
    parting = space & ends & ~edge[1:]
    joins = np.flatnonzero(parting & (points == 32)) + 1
    starts = begins | parting
    starts[joins] = False
    # An apostrophe that starts a pretoken of its own takes a known ending from the letters after it.
    marks = np.flatnonzero(starts & ends & (points == 39))
    marks = marks[marks + 1 < n]
    marks = marks[(kind[marks + 1] == _LETTER) & ~edge[marks + 1]]
    for m in marks.tolist():
        tail = "".join(map(chr, points[m + 1 : m + 3].tolist()))
        if m + 2 < n and edge[m + 2]:
            tail = tail[:1]
        size = 1 if tail[:1] in _ENDINGS else 2 if tail in _ENDINGS else 0
        if size:
            starts[m + 1] = False
            if m + 1 + size < n:
                starts[m + 1 + size] = True
    return np.flatnonzero(starts)


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer, memoised by pretoken."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Byte-level pieces that begin with a space: where words with a leading space begin.
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for piece, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = piece.startswith("\u0120")
        self.forget()

    def forget(self) -> None:
        self.index: dict[int, int] = {}
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _learn(self, keys: list[int], strings: list[str]) -> np.ndarray:
        """Encodes new pretokens; the entries of the keys."""
        # Words with a leading space are told apart in a joined text by the pieces that hold it.
        words = [i for i, x in enumerate(strings) if x[0] == " " and len(x) > 1 and x[1].isalpha()]
        chosen = set(words)
        others = [i for i in range(len(strings)) if i not in chosen]
        joined = ["".join(strings[i] for i in words[j : j + JOINED]) for j in range(0, len(words), JOINED)]
        entries = np.zeros(len(keys), np.int64)
        for texts, rows in ((joined, words), ([strings[i] for i in others], others)):
            encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            count = np.fromiter((len(e) for e in encoded), np.int64, len(encoded))
            flat = np.fromiter(chain.from_iterable(e.ids for e in encoded), np.uint32, int(count.sum()))
            del encoded
            if texts is joined:
                count = np.diff(np.append(np.flatnonzero(self.spaced[flat]), len(flat)))
            first = np.cumsum(count) - count + len(self.flat)
            entries[rows] = np.arange(len(self.first), len(self.first) + len(rows))
            self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, flat])
            if len(self.first) != len(self.count) or len(count) != len(rows):
                raise ValueError("the tokenizer does not keep words apart as a byte-level BPE does")
        self.index.update(zip(keys, entries.tolist(), strict=True))
        return entries

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text (null: none), in order."""
        buf, offsets = T.text_bytes(column)
        for first, last, part, offs in T.chunks(buf, offsets, CHUNK_BYTES):
            text = part.tobytes().decode("utf-8")
            if any(a in text for a in self.added):
                # Strings of added tokens are cut out before pretokens are, so such texts go whole.
                for t in pc.fill_null(column[first:last], "").to_pylist():
                    yield np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            places = np.append(np.flatnonzero((part & 0xC0) != 0x80), len(part))  # the byte at which each code point begins
            yield from self._chunk(text, part, points, places, np.searchsorted(places, offs))

    def _chunk(self, text: str, part: np.ndarray, points: np.ndarray, places: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
        starts = pretoken_starts(points, offs)
        ends = np.append(starts[1:], len(points))
        if not len(starts):
            yield from (np.zeros(0, np.uint32) for _ in offs[1:])
            return
        keys = T.span_hashes(part, places[starts], places[ends])
        unique, at, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.index) + len(unique) > MEMO_ENTRIES:
            self.forget()
        listed = unique.tolist()
        known = np.array(list(map(self.index.get, listed, repeat(-1))), np.int64)
        if len(new := np.flatnonzero(known < 0)):
            spans = zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)
            known[new] = self._learn([listed[i] for i in new.tolist()], [text[a:b] for a, b in spans])
        entry = known[back.reshape(-1)]
        count = self.count[entry]
        done = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[entry] - (done - count), count) + np.arange(done[-1])]
        bounds = np.append(0, done)[np.searchsorted(starts, offs)]
        yield from (ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))


@cache
def _encoder(path: str) -> Encoder:
    """One encoder for each Python worker, whose memo lasts over its tasks."""
    return Encoder(path)


def _width(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def train_dictionary(docs: DataFrame, path: str, width: np.dtype) -> bytes:
    """A zstandard dictionary for serialized ids, from a bounded sample of documents; where they are too few to train on, their own ids."""
    n = docs.count()
    some = docs.where(F.expr(f"pmod(xxhash64(doc_id), {max(n, 1)}L) < {SAMPLE_DOCS}"))
    sample = some.orderBy(F.xxhash64("doc_id"), F.xxhash64("text")).limit(2 * SAMPLE_DOCS).select("text")

    def excerpt(ids: np.ndarray) -> np.ndarray:
        first = zlib.crc32(ids.tobytes()) % max(1, len(ids) - SAMPLE_IDS + 1)
        return ids[first : first + SAMPLE_IDS]

    def serialized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in T.sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([excerpt(ids).astype(width).tobytes() for ids in encoder.encode(batch["text"])], pa.binary())], names=["b"])

    samples = sorted(bytes(r.b) for r in sample.mapInArrow(T.task(serialized), "b binary").collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes) -> dict:
    # Shorter than eight bytes is no dictionary to the library.
    return {"dict_data": zstandard.ZstdCompressionDict(raw)} if len(raw) >= 8 else {}


def write_tokens(docs: DataFrame, tokenizer_path: str, path: str, end_id: int = 0) -> None:
    """The ids of docs (doc_id, text), an end id after each document, as a file set at path."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    width = _width(Tokenizer.from_file(tokenizer_path).get_vocab_size())
    raw = train_dictionary(docs, tokenizer_path, width)
    mark = hashlib.sha256(raw).hexdigest()
    spark.createDataFrame([(mark, width.str, bytearray(raw))], "hash string, width string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = _encoder(tokenizer_path), zstandard.ZstdCompressor(level=LEVEL, **_dictionary(raw)).compress
        for batch in T.sliced(batches):
            counts, packed = [], []
            for ids in encoder.encode(batch["text"]):
                counts.append(len(ids) + 1)
                packed.append(pack(np.append(ids, np.uint32(end_id)).astype(width).tobytes()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(counts, pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "frame"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, start = TaskContext.get().partitionId(), 0, 0

        def block(rows: list) -> pa.RecordBatch:
            nonlocal number, start
            ids, counts, packed = zip(*rows, strict=True)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in packed])]).tolist()
            cells = [[shard], [number], [start], [ids], [counts], [offsets], [b"".join(packed)], [mark]]
            number, start = number + 1, start + sum(counts)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names=names)

        longs = pa.list_(pa.int64())
        types = [pa.int64(), pa.int64(), pa.int64(), longs, longs, longs, pa.binary(), pa.string()]
        names = ["shard", "block", "start", "doc_ids", "n_tokens", "offsets", "payload", "dictionary_hash"]
        rows, size = [], 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("doc_id", "n_tokens", "frame")), strict=True):
                rows.append(row)
                size += len(row[2])
                if len(rows) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block(rows)
                    rows, size = [], 0
        if rows:
            yield block(rows)

    schema = "shard long, block long, start long, doc_ids array<long>, n_tokens array<long>, offsets array<long>, payload binary, dictionary_hash string"
    # Written first: the range exchange samples its input, and would encode everything twice.
    framed = written(docs.mapInArrow(T.task(frames), "doc_id long, n_tokens long, frame binary"), "frames")
    # Rows of one id, or without one, may be any number: their frames' hashes part them as well.
    order = [F.col("doc_id"), F.col("n_tokens"), F.xxhash64("frame")]
    ordered = framed.repartitionByRange(*order).sortWithinPartitions(*order, "frame")
    ordered.mapInArrow(T.task(blocks), schema).write.parquet(f"{path}/blocks")
    totals = spark.read.parquet(f"{path}/blocks").select("shard", F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard: bounded by their number
    shards = totals.groupBy("shard").agg(F.sum("n").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shards.select("shard", "base").coalesce(1).write.parquet(f"{path}/shards")


def read_tokens(spark: SparkSession, path: str, column: str, kind: str, of: Callable[[np.ndarray], object]) -> DataFrame:
    """doc_id, start, n_tokens and `column` (of(ids) of the Spark type `kind`) of every document of a file set."""
    mark, width, raw = spark.read.parquet(f"{path}/dictionary").first()
    raw = bytes(raw)

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor(**_dictionary(raw)).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary_hash"] != mark:
                    raise ValueError("a block was written with another dictionary")
                starts = row["base"] + row["start"] + np.cumsum(row["n_tokens"]) - row["n_tokens"]
                frames = (row["payload"][a:b] for a, b in zip(row["offsets"][:-1], row["offsets"][1:], strict=True))
                values = [of(np.frombuffer(unpack(f), width).astype("<u4")) for f in frames]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(row["n_tokens"], pa.int64()), pa.array(values)], names=["doc_id", "start", "n_tokens", column])

    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(spark.read.parquet(f"{path}/shards")), "shard")
    return blocks.mapInArrow(T.task(unpacked), f"doc_id long, start long, n_tokens long, {column} {kind}")


def token_output(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row of docs (doc_id, text), read back from the files written.

    Files go to the shared folder, in ascending doc_id order; null doc_ids come
    first, rows that repeat one by their number of ids and a hash. Null and empty texts are the end
    id alone. An empty table gives an empty table; other columns are ignored.
    """
    path = new_path(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer_path, path, end_id)
    return read_tokens(docs.sparkSession, path, "ids_crc32", "long", lambda ids: zlib.crc32(ids.tobytes()))

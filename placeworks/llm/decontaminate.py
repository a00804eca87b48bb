"""Benchmark decontamination by a prefix-filtered set join.

A window is a set that must be contained whole in a run of document words, so
by the prefix rule one token is enough to find every candidate: the window's
rarest word, rarity being the frequency over all documents. Documents give a
row for each place of a prefix word, with as many words around it as a window
can reach; it is joined with the windows of that prefix. The offset of the
word inside the window bounds where the window can lie (position and length),
and what is left is verified on the words themselves.

Windows and documents meet in joins alone. Tasks hold only a filter of
1 << SLOT_BITS flags, whatever the size of the benchmark: it keeps most words
that are no prefix from being sent, and decides nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .scratch import written

#: Flags of the filter of words, by the first bits of a word's hash.
SLOT_BITS = 24
#: Words whose counts a task holds before it sends them.
HELD = 1 << 20
PLACES = "_n_words long, _places array<struct<word: long, at: long, before: long, context: string>>"


class Words:
    """The words of some rows: hashes, the first of each row, and their text, one space between two."""

    def __init__(self, part: np.ndarray, offs: np.ndarray):
        starts, ends, self.first = T.word_bounds(part, offs, T.ALNUM)
        self.hashes = T.word_hashes(part, starts, ends)
        sizes = ends - starts
        self.hi = np.cumsum(sizes + 1) - 1
        self.lo = self.hi - sizes
        self.text = np.full(int(self.hi[-1]) + 1 if len(sizes) else 0, 32, np.uint8)
        kept = np.flatnonzero(T.ALNUM[part])
        self.text[np.arange(len(kept)) + np.repeat(np.arange(len(sizes)), sizes)] = T.LOWER[part[kept]]

    def joined(self, a: int, b: int) -> str:
        """The words from a to b - 1."""
        return self.text[self.lo[a] : self.hi[b - 1]].tobytes().decode()


def _of_rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, words) of runs of whole rows."""
    buf, offsets = T.text_bytes(batch["text"])
    for row, last, part, offs in T.chunks(buf, offsets):
        yield row, last, Words(part, offs)


def _windows(size: int):
    """Rows (item, words, window) of every window of every item: the words' hashes and their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.sliced(batches):
            names = batch["item"].to_pylist()
            for row, last, words in _of_rows(batch):
                items, hashes, texts = [], [], []
                for i in range(row, last):
                    a, b = words.first[i - row], words.first[i - row + 1]
                    for at in range(a, max(b - size, a) + 1) if b > a else ():
                        end = min(at + size, b)
                        items.append(names[i])
                        hashes.append(words.hashes[at:end].view(np.int64))
                        texts.append(words.joined(at, end))
                yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(hashes, pa.list_(pa.int64())), pa.array(texts, pa.string())], names=["item", "words", "window"])

    return run


def _filter(words: DataFrame) -> np.ndarray:
    """The flags of the column `word`, eight to a byte; at most 1 << SLOT_BITS numbers reach the driver."""
    slots = words.select(F.shiftrightunsigned("word", 64 - SLOT_BITS).cast("int").alias("slot")).distinct().toArrow()["slot"].to_numpy()
    flags = np.zeros(1 << SLOT_BITS - 3, np.uint8)
    np.bitwise_or.at(flags, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return flags


def _passing(flags: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Indices of the words whose flag is set."""
    bits = len(flags).bit_length() + 2  # eight flags to a byte
    slots = (words >> np.uint64(64 - bits)).astype(np.int64)
    return np.flatnonzero((flags[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)


def _frequencies(flags: np.ndarray):
    """How often each word that passes the filter occurs in the batches of a task, in one row or several."""

    def counts(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        word, where = np.unique(np.concatenate([w for w, _ in held]), return_inverse=True)
        n = np.bincount(where, weights=np.concatenate([n for _, n in held]), minlength=len(word)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in T.sliced(batches):
            for _, _, words in _of_rows(batch):
                held.append(np.unique(words.hashes[_passing(flags, words.hashes)], return_counts=True))
                size += len(held[-1][0])
                if size > HELD:
                    yield counts(held)
                    held, size = [], 0
        if held:
            yield counts(held)

    return run


def _places(flags: np.ndarray, size: int):
    """Batches with PLACES for their text: the places of words that pass the filter, with size - 1 words on either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.sliced(batches):
            for row, last, words in _of_rows(batch):
                first, at = words.first, _passing(flags, words.hashes)
                doc = np.searchsorted(first, at, side="right") - 1
                begin, end = np.maximum(at - size + 1, first[doc]), np.minimum(at + size, first[doc + 1])
                context = [words.joined(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
                place = pa.StructArray.from_arrays(
                    [pa.array(words.hashes[at].view(np.int64)), pa.array(at - first[doc]), pa.array(at - begin), pa.array(context, pa.string())], names=["word", "at", "before", "context"]
                )
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(last - row + 1)), pa.int32()), place)
                rows = batch.slice(row, last - row).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.diff(first)), lists], names=[*rows.schema.names, "_n_words", "_places"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item ids as strings), items_sha256 and contaminated of every row of docs.

    A word is a run of digits, ASCII letters (lower-cased) and non-ASCII
    characters; a window is `size` consecutive words of an item, or all of an
    item that has fewer but some. A document word inside any occurrence of a
    window is hit.

    Null and empty texts have no words. A null item_id stands for the string
    "null"; repeated items count once per id. An empty benchmark marks nothing.
    Rows that repeat a doc_id get a row each. Other columns are ignored.
    """
    docs = docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    places, windows, hits = _joined(docs, benchmark, size)
    runs = hits.groupBy("_row").agg(_covered(F.collect_set(F.struct("start", "end"))).alias("n_hit"))
    items = hits.select("_row", "window").distinct().join(windows.select("item", "window"), "window").select("_row", "item").distinct()
    items = items.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = places.select("_row", "doc_id", F.col("_n_words").alias("n_words")).join(runs, "_row", "left").join(items, "_row", "left")
    out = out.withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long"))).withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs (text and any other columns) that are not contaminated, each by its own text whatever its doc_id.

    Rows are told apart by the SHA-256 of their text, so only those digests go into the last join.
    """
    digest = F.sha2(F.col("text").cast("string").cast("binary"), 256)
    _, _, hits = _joined(docs.select(digest.alias("_row"), F.col("text").cast("string").alias("text")), benchmark, size, all_rows=False)
    key = "_row"
    while key in docs.columns:
        key += "_"
    return docs.withColumn(key, digest).join(hits.select(F.col("_row").alias(key)).distinct(), key, "left_anti").select(*docs.columns)


def _covered(runs: Column) -> Column:
    """The number of words in the union of the runs (start, end)."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def more(seen: Column, run: Column) -> Column:
        fresh = F.greatest(F.lit(0).cast("long"), run["end"] - F.greatest(run["start"], seen["end"]))
        return F.struct((seen["n"] + fresh).alias("n"), F.greatest(seen["end"], run["end"]).alias("end"))

    return F.aggregate(F.array_sort(runs), none, more, lambda seen: seen["n"])


def _joined(docs: DataFrame, benchmark: DataFrame, size: int, all_rows: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables: rows of docs (_row, text and others) with PLACES for their text; windows (item, words, window); hits (_row, start, end, window)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    windows = written(items.mapInArrow(T.task(_windows(size)), "item string, words array<long>, window string").distinct(), "windows")
    flags = _filter(windows.select(F.explode("words").alias("word")))
    counted = docs.select("text").mapInArrow(T.task(_frequencies(flags)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    # The rarest word of each window, and its offset.
    rated = windows.select("window", "words").distinct().select("window", F.size("words").alias("length"), F.posexplode("words").alias("offset", "word"))
    rated = rated.join(counted, "word", "left").groupBy("window", "length").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset")).alias("p"))
    prefixes = written(rated.select("window", "length", F.col("p.word").alias("word"), F.col("p.offset").alias("offset")), "prefixes")

    others = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    places = docs.mapInArrow(T.task(_places(_filter(prefixes), size)), f"{others}, {PLACES}")
    places = written(places if all_rows else places.where(F.size("_places") > 0), "places")
    found = places.select("_row", F.explode("_places").alias("place")).select("_row", "place.*").join(prefixes, "word").where("offset <= before")
    same = F.array_join(F.slice(F.split("context", " "), F.col("before").cast("int") - F.col("offset") + 1, F.col("length")), " ") == F.col("window")
    start = F.col("at") - F.col("offset")
    return places, windows, written(found.where(same).select("_row", start.alias("start"), (start + F.col("length")).alias("end"), "window"), "hits")

"""MinHash near-dedup: universal hash minima, banding, signature and exact verification, star components.

Copies of one shingle set are one class before any search, so a group of any
number of copies costs one row per document. Candidates are then searched in
two rounds. First every class is compared with one hub, the central class that
shares most of its buckets; then, without any bound on their number, all
members of a bucket that are still in different components. Buckets are
compared in blocks of rows, only pairs whose signatures agree leave a block,
and a block's texts are fetched once for all its pairs, so no group is expanded
into pairs of texts and no link between components is lost.

With 40 bands of 6 minima a pair of similarity 0.8 shares no bucket with
probability (1 - 0.8**6)**40 = 5e-6; one of 0.2 shares a bucket with 0.003.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .graph import components
from .scratch import written

BANDS, ROWS, MINIMA = 40, 6, 512
#: Signature bytes that must agree: a pair of similarity 0.8 has 512 * 0.8 = 410
#: on average, deviation 9.1; fewer than 373 has a probability of 3e-5.
AGREE_LEAST = 373
#: Rows of a bucket that one block holds of either side.
BLOCK = 256

_rng = np.random.default_rng(20240801)
_A = _rng.integers(1, 1 << 63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
_PIECE = 1024

SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, buckets array<long>, signature binary"
PAIRS = "bucket long, ask_block int, block int, a long, b long"
KEY = ["bucket", "ask_block", "block"]


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each text: the sorted hashes of its distinct k-word shingles, or of all its words where it has fewer."""
    buf, offsets = T.text_bytes(column)
    for _, _, part, offs in T.chunks(buf, offsets):
        starts, ends, first = T.word_bounds(part, offs, T.NONSPACE)
        words = T.word_hashes(part, starts, ends)
        grams = T.grams(words, k)
        for i in range(len(offs) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield T.grams(words[a:b], b - a)
            else:
                yield np.zeros(0, np.uint64)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest value of each universal hash over a set that is not empty."""
    out = None
    for i in range(0, len(hashes), _PIECE):
        part = (hashes[i : i + _PIECE, None] * _A + _B).min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.sliced(batches):
            n, fp1, fp2, mins = [], [], [], []
            none = np.zeros(MINIMA, np.uint64)
            for s in shingle_sets(batch["text"], k):
                n.append(len(s))
                fp1.append(s.sum(dtype=np.uint64))
                fp2.append(T.mix(s).sum(dtype=np.uint64) if len(s) else np.uint64(0))
                mins.append(minima(s) if len(s) else none)
            m = np.array(mins, dtype=np.uint64).reshape(len(n), MINIMA)
            keys = np.zeros((len(n), BANDS), dtype=np.uint64)
            for b in range(BANDS):
                key = np.full(len(n), b + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = T.mix(key * np.uint64(0x100000001B3) + m[:, b * ROWS + r])
                keys[:, b] = key
            low = np.ascontiguousarray((T.mix(m) & np.uint64(255)).astype(np.uint8))
            offsets = np.arange(0, (len(n) + 1) * BANDS, BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(fp1, np.uint64).view(np.int64)),
                    pa.array(np.array(fp2, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1).view(np.int64))),
                    pa.array([row.tobytes() for row in low], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "fp1", "fp2", "buckets", "signature"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, from batches in which they are neighbours."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(table: pa.Table, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind).reshape(table.num_rows, -1)


def _compared(percent: int):
    """Of each block: pairs (a, b) of an asking and another row of different components whose signatures agree.

    A row (a, null) goes with every member of a pair. A pair that shares
    several buckets is told in the first of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, KEY):
            asks, asking = table["asks"].to_numpy(), table["asking"].to_numpy()
            rep, comp, n = (table[c].to_numpy() for c in ("rep", "component", "n_shingles"))
            signature = _matrix(table, "signature", np.uint8)
            bands = table["buckets"].combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
            band = table["band"][0].as_py()
            q, d = np.flatnonzero(asks), np.flatnonzero(~asks)
            met = np.zeros(len(rep), dtype=bool)
            for i in q.tolist():
                j = d[(comp[d] != comp[i]) & (100 * np.minimum(n[d], n[i]) >= percent * np.maximum(n[d], n[i]))]
                j = j[~(bands[j, :band] == bands[i, :band]).any(axis=1)]
                j = j[(signature[j] == signature[i]).sum(axis=1) >= AGREE_LEAST]
                # Of two asking rows each meets the other; one of the two tells.
                j = j[~asking[j] | (rep[j] > rep[i])]
                if len(j):
                    met[i] = met[j] = True
                    yield _keyed(table, pa.array(np.minimum(rep[i], rep[j])), pa.array(np.maximum(rep[i], rep[j])))
            if met.any():
                nodes = pa.array(np.unique(rep[met]))
                yield _keyed(table, nodes, pa.nulls(len(nodes), pa.int64()))

    return run


def _keyed(block: pa.Table, a: pa.Array, b: pa.Array) -> pa.RecordBatch:
    keys = [pa.repeat(block[k][0], len(a)) for k in KEY]
    return pa.RecordBatch.from_arrays([*keys, a, b], names=[*KEY, "a", "b"])


def _similar(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> bool:
    for x in xs:
        for y in ys:
            both = len(np.intersect1d(x, y, assume_unique=True))
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                return True
    return False


def _confirmed(k: int, percent: int):
    """The linked pairs of each block; its texts, in rows without b, come before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sets = None, {}
        for batch in T.sliced(batches):
            found = []
            keys = zip(*(batch[c].to_pylist() for c in KEY), strict=True)
            rows = zip(keys, batch["a"].to_pylist(), batch["b"].to_pylist(), shingle_sets(batch["text"], k), strict=True)
            for key, a, b, s in rows:
                if key != last:
                    last, sets = key, {}
                if b is None:
                    of = sets.setdefault(a, [])
                    if not any(np.array_equal(s, x) for x in of):
                        of.append(s)
                elif _similar(sets[a], sets[b], percent):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


def _across(placed: DataFrame, reps: DataFrame, links: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of different components among the rows of each bucket (bucket, band, rep), by block."""
    found = written(components(links, "a", "b"), "components").withColumnRenamed("node", "rep")
    rows = written(placed.join(found, "rep", "left").select("bucket", "band", "rep", F.coalesce("component", "rep").alias("component")), "labelled")
    sizes = rows.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest"))
    mixed = written(mixed.where("rest > 0"), "mixed")
    open_ = rows.join(mixed, "bucket").withColumn("asking", F.col("component") != F.col("most"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("rep"), blocks(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    kept = ("bucket", "band", "rep", "component", "asking")
    asks = open_.where("asking").select(*kept, own("rest").alias("ask_block"), F.explode(every("all")).alias("block"), F.lit(True).alias("asks"))
    rest = open_.select(*kept, F.explode(every("rest")).alias("ask_block"), own("all").alias("block"), F.lit(False).alias("asks"))
    full = written(asks.unionByName(rest), "asked").join(reps.select("rep", "n_shingles", "signature", "buckets"), "rep")
    dealt = full.repartition(*KEY).sortWithinPartitions(*KEY)
    return written(dealt.mapInArrow(T.task(_compared(percent)), PAIRS), "across")


def _links(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs of blocks (with a row (a, null) for each member) whose whole shingle sets are as similar as asked."""
    told = pairs.where("b is null").join(texts.withColumnRenamed("doc_id", "a"), "a").select(*KEY, "a", "b", "text")
    both = told.unionByName(pairs.where("b is not null").withColumn("text", F.lit(None).cast("string")))
    both = both.repartition(*KEY).sortWithinPartitions(*KEY, F.col("b").asc_nulls_first())
    return written(both.mapInArrow(T.task(_confirmed(k, percent)), "a long, b long").distinct(), "links")


def _stars(placed: DataFrame) -> DataFrame:
    """A pair of each class and the hub that shares most buckets with it, in blocks by hub."""
    # The class that meets most others is the likeliest centre of a family of copies.
    central = written(placed.groupBy("rep").agg(F.sum("n").alias("met")), "central")
    ranked = written(placed.join(central, "rep").select("bucket", "rep", "met"), "ranked")
    hubs = written(ranked.groupBy("bucket").agg(F.max(F.struct("met", -F.col("rep"))).alias("top")).selectExpr("bucket", "-top.col2 AS hub", "top.met AS hub_met"), "hubs")
    shared = ranked.select("bucket", "rep").join(hubs, "bucket").where("rep != hub").groupBy("rep", "hub").agg(F.count("*").alias("times"), F.first("hub_met").alias("met"))
    best = written(shared.groupBy("rep").agg(F.max_by("hub", F.struct("times", "met", -F.col("hub"))).alias("hub")), "stars")
    sizes = written(best.groupBy("hub").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    key = (F.col("hub").alias("bucket"), F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("ask_block"), F.lit(0).alias("block"))
    dealt = best.join(sizes, "hub")
    none = F.lit(None).cast("long").alias("b")
    pairs = dealt.select(*key, F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b"))
    members = dealt.select(*key, F.col("rep").alias("a"), none)
    centres = sizes.select(F.col("hub").alias("bucket"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("ask_block"), F.lit(0).alias("block"), F.col("hub").alias("a"), none)
    return pairs.unionByName(members).unionByName(centres)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text; other columns are ignored).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Two
    documents are linked when their sets of distinct word shingles have a
    Jaccard similarity of percent / 100 or more. component_id is the smallest
    doc_id reachable by links; kept says that this is the document's own.

    Null, empty and blank texts have an empty set and are linked with nothing.
    A row without doc_id is kept alone with a null component_id. Rows that
    repeat a doc_id are one node, linked as any of their texts is. An empty
    table gives an empty table.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = written(docs.mapInArrow(T.task(_sketch(words)), SKETCH), "sketch")
    linkable = sketch.where("n_shingles > 0 and doc_id is not null")
    same = ["fp1", "fp2", "n_shingles"]
    narrow = linkable.select("doc_id", *same)
    classes = written(narrow.groupBy(*same).agg(F.min("doc_id").alias("rep")), "classes")
    members = written(narrow.join(classes, same).select("doc_id", "n_shingles", "rep"), "members")
    reps = written(linkable.withColumnRenamed("doc_id", "rep").join(classes.hint("merge"), ["rep", *same]).select("rep", "n_shingles", "buckets", "signature"), "reps")

    rows = reps.select("rep", F.posexplode("buckets").alias("band", "bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min("rep").alias("first"), F.max("rep").alias("last"))
    shared = written(shared.where("first < last").select("bucket", "n"), "buckets")
    placed = written(rows.join(shared, "bucket").select("bucket", "band", "rep", "n").distinct(), "placed")
    # Texts that any pair can need; the ids grow with the corpus, so they are not broadcast.
    wanted = placed.select(F.col("rep").alias("doc_id")).distinct()
    texts = written(docs.join(wanted.hint("merge"), "doc_id", "left_semi"), "texts")
    links = _links(written(_stars(placed), "stars"), texts, words, percent)
    more = _links(_across(placed.select("bucket", "band", "rep"), reps, links, percent), texts, words, percent)
    links = links.unionByName(more)
    # A doc_id that repeats with different texts ties their classes.
    ties = written(members.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a != last").select("doc_id", "a"), "ties")
    tied = members.select("doc_id", F.col("rep").alias("b")).join(ties, "doc_id").select("a", "b")
    joined = written(components(links.unionByName(tied), "a", "b"), "components")

    grouped = members.select("doc_id", "n_shingles", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    grouped = grouped.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone = sketch.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone).withColumn("kept", F.expr("doc_id <=> component_id"))

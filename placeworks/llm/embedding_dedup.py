"""Embedding near-dedup: vectors sorted by random hashes, compared with their neighbours, pass after pass.

Equal vectors of a label are one class before any search. In each pass the
classes of a label are ordered by the signs of another set of random
projections, taken as one number; vectors of a small angle share long prefixes
and come near each other. A class is compared with the WINDOW that follow it.
Verified pairs of all passes are united into groups, and since a group may hold
more neighbours than a window, the links inside each group are then counted
over all its classes, in blocks. Orders are made of keys and ids alone; the
vectors, as wide as they are stored, travel once to each block.

With a cosine of 0.98 two signs agree with a probability of 0.936. Where n
vectors of a label need b = log2(n / WINDOW) signs to part into windows, a
pass misses a pair with a probability of about 1 - 0.936**b; over 12 passes
that is 5e-7 at 5,000 vectors and 1e-3 at a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from . import textops as T
from .graph import components
from .near_dedup import _blocks
from .scratch import written

PASSES, BITS, WINDOW = 12, 48, 128
#: Classes that are compared by one task at once, and rows of a product of two blocks.
BLOCK, PART = 2048, 512
SEED = 11


def unit_vectors(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision, those of unusable vectors being NaN."""
    x = rows.astype(np.float64)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, keepdims=True, initial=0)
        x = x / np.where(np.isfinite(x).all(axis=1, keepdims=True) & (top > 0), top, np.nan)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0


def _planes(number: int, width: int) -> np.ndarray:
    return np.random.default_rng([SEED, number]).normal(size=(width, BITS))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row: label, vec_id, and where it can link with others its dim, vector (as stored), fp (128 bits of its unit vector) and the sort key of each pass."""
    weights = (np.int64(1) << np.arange(BITS - 1, -1, -1)).astype(np.int64)
    for batch in batches:
        column, n = batch["embedding"], batch.num_rows
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)  # a null component is NaN
        first = np.cumsum(sizes) - sizes
        told = np.asarray(batch["label"].is_valid()) & np.asarray(batch["vec_id"].is_valid())
        fps, raws = [None] * n, [None] * n
        keys, usable = np.zeros((n, PASSES), np.int64), np.zeros(n, bool)
        for d in np.unique(sizes[told & (sizes > 0)]).tolist():
            rows = np.flatnonzero(told & (sizes == d))
            stored = flat[first[rows][:, None] + np.arange(d)]
            unit = unit_vectors(stored)
            good = ~np.isnan(unit[:, 0])
            rows, stored, unit = rows[good], stored[good], unit[good]
            usable[rows] = True
            for i, s, u in zip(rows.tolist(), stored, unit, strict=True):
                raws[i], fps[i] = s.tobytes(), xxhash.xxh3_128_digest(u.tobytes())
            for p in range(PASSES):
                keys[rows, p] = (unit @ _planes(p, d) > 0) @ weights
        offsets = np.append(0, np.cumsum(np.where(usable, PASSES, 0))).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                batch["label"],
                batch["vec_id"],
                pa.array(sizes),
                pa.array(raws, pa.binary()),
                pa.array(fps, pa.binary()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[usable].reshape(-1))),
            ],
            names=["label", "vec_id", "dim", "vector", "fp", "keys"],
        )


def _units(table: pa.Table) -> np.ndarray:
    raw = table["vector"].to_pylist()
    kind = np.float32 if len(raw[0]) == 4 * table["dim"][0].as_py() else np.float64
    return unit_vectors(np.frombuffer(b"".join(raw), kind).reshape(table.num_rows, -1))


def _windowed(least: float):
    """Verified pairs of a block: its own classes (first) with the WINDOW classes after each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, ["pass", "label", "dim", "block"]):
            order = np.argsort(table["place"].to_numpy(), kind="stable")
            x, ids = _units(table)[order], table["rep"].to_numpy()[order]
            own = int((~table["next"].to_numpy(zero_copy_only=False)).sum())
            # A tree of the block's links is enough to unite its groups.
            keep, top = [], np.arange(len(ids))
            for start in range(0, own, PART):
                stop = min(start + PART, own)
                i, j = np.nonzero(x[start:stop] @ x[start : stop + WINDOW].T >= least)
                near = (j > i) & (j - i <= WINDOW)
                for a, b in zip((i[near] + start).tolist(), (j[near] + start).tolist(), strict=True):
                    p, q = a, b
                    while top[p] != p:
                        top[p] = p = top[top[p]]
                    while top[q] != q:
                        top[q] = q = top[top[q]]
                    if p != q:
                        top[max(p, q)] = min(p, q)
                        keep.append((ids[a], ids[b]))
            a, b = zip(*keep, strict=True) if keep else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _counted(least: float):
    """How many rows of other classes of a block each asking class is linked with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, COUNT_KEYS):
            asks = table["asks"].to_numpy(zero_copy_only=False)
            asking, rest = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
            if not asking.num_rows or not rest.num_rows:
                continue
            x, y, n = _units(asking), _units(rest), rest["n"].to_numpy()
            fp, other = (np.array(t["fp"].to_pylist(), dtype=object) for t in (asking, rest))
            sums = np.zeros(len(x), np.int64)
            for start in range(0, len(x), PART):
                near = (x[start : start + PART] @ y.T >= least) & (fp[start : start + PART, None] != other[None, :])
                sums[start : start + PART] = near @ n
            yield pa.RecordBatch.from_arrays([asking["label"].combine_chunks(), asking["fp"].combine_chunks(), pa.array(sums)], names=["label", "fp", "n"])

    return run


COUNT_KEYS = ["component", "label", "dim", "ask_block", "block"]


def _blocked(passes: DataFrame) -> DataFrame:
    """Classes with their block and place, each block followed by the first WINDOW classes of the next one (next is true)."""
    keys = ("pass", "label", "dim")
    order = (*keys, "key", "rep", "fp")
    placed = written(passes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy(*keys, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    placed = placed.join(counts, [*keys, "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before"))
    block, inside = F.floor(F.col("place") / BLOCK), F.col("place") % BLOCK
    own = F.struct(block.alias("block"), F.lit(False).alias("next"))
    also = F.when((inside < WINDOW) & (block > 0), F.struct((block - 1).alias("block"), F.lit(True).alias("next")))
    copies = placed.withColumn("to", F.explode(F.filter(F.array(own, also), lambda x: x.isNotNull())))
    return copies.select(*keys, "to.block", "to.next", "place", "rep", "fp")


def _links_inside(classes: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """label, fp and the number of rows of other classes that the rows of a class are linked with."""
    members = classes.join(groups, "rep").select("component", "label", "dim", "fp", "vector", "n")
    sizes = written(members.groupBy("component", "label", "dim").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    members = members.join(sizes, ["component", "label", "dim"])
    own, every = F.pmod(F.xxhash64("fp"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ("component", "label", "dim", "fp", "vector", "n")
    asks = members.select(*columns, own.alias("ask_block"), every.alias("block"), F.lit(True).alias("asks"))
    rest = members.select(*columns, every.alias("ask_block"), own.alias("block"), F.lit(False).alias("asks"))
    dealt = asks.unionByName(rest).repartition(*COUNT_KEYS).sortWithinPartitions(*COUNT_KEYS)
    return dealt.mapInArrow(T.task(_counted(least)), "label long, fp binary, n long").groupBy("label", "fp").agg(F.sum("n").alias("others"))


def near_vectors(vectors: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label).

    Vectors are linked when their labels are equal and their cosine in double
    precision is `least` or more. component_id is the smallest vec_id reachable
    by links; kept says that it is the vector's own.

    Vectors that are null, empty, zero or hold null or non-finite components,
    and those without label, are linked with nothing; vectors of different
    lengths are not linked. A row without vec_id is linked with nothing and kept
    with a null component_id. Each row is a vector: n_links counts the other
    rows, also those that repeat its vec_id; linkable rows of one vec_id
    have one component. An empty table gives an empty table; other columns are ignored.
    """
    kind = vectors.schema["embedding"].dataType
    stored = "array<float>" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(stored).alias("embedding"), F.col("label").cast("long").alias("label"))
    units = written(rows.mapInArrow(T.task(_keys), "label long, vec_id long, dim long, vector binary, fp binary, keys array<long>"), "units")
    linkable = units.where("fp is not null")
    narrow = linkable.select("label", "fp", "vec_id")
    classes = linkable.groupBy("label", "dim", "fp").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first(F.struct("vector", "keys")).alias("of"))
    classes = written(classes.select("label", "dim", "fp", "rep", "n", "of.*"), "classes")
    passes = classes.select("label", "dim", "fp", "rep", F.posexplode("keys").alias("pass", "key"))
    keys = ("pass", "label", "dim", "block")
    blocks = _blocked(passes).join(classes.select("label", "fp", "vector"), ["label", "fp"]).repartition(*keys).sortWithinPartitions(*keys)
    pairs = written(blocks.mapInArrow(T.task(_windowed(least)), "a long, b long").distinct(), "pairs")

    # A vec_id that repeats with different vectors ties their classes.
    members = written(narrow.join(classes.select("label", "fp", "rep"), ["label", "fp"]), "members")
    ties = members.groupBy("vec_id").agg(F.min("rep").alias("a"), F.max("rep").alias("most")).where("a < most").select("vec_id", "a")
    ties = members.select("vec_id", F.col("rep").alias("b")).join(written(ties, "ties"), "vec_id").select("a", "b")
    groups = written(components(pairs.unionByName(ties), "a", "b"), "groups").withColumnRenamed("node", "rep")

    told = classes.select("label", "fp", "rep", "n").join(_links_inside(classes, groups, least), ["label", "fp"], "left").join(groups, "rep", "left")
    told = written(told.select("label", "fp", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "told")
    alone = units.where("fp is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = narrow.join(told, ["label", "fp"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.expr("vec_id <=> component_id"))

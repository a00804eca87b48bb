"""Histogram sort: splitters found by counting exact bytes below candidate boundaries, then one exchange.

The key of a row is (xxhash64 of its text, doc_id), so copies of one text are
neighbours and share a shard unless a boundary has to go through them. Each
round counts the bytes between up to PROBES boundaries inside the interval
that is still open around every splitter, and the interval that holds the
splitter's target becomes the next one. A group of copies that is larger than
the tolerance is split inside by doc_id, by the same search.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

PROBES = 256
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Splitter:
    """Rows with a key below (h, d) go to the left; bytes and the key are known once `done`."""

    target: float
    lo: int = LOW
    hi: int = HIGH + 1
    below: int = 0
    h: int | None = None
    done: bool = False
    key: tuple[int, int] = (LOW, LOW)

    def interval(self) -> tuple:
        return (self.h, self.lo, self.hi)

    def settle(self, at: int) -> None:
        self.done, self.key = True, (at, LOW) if self.h is None else (self.h, at)


def _step(lo: int, hi: int) -> int:
    return -(-(hi - lo) // PROBES)


def _bucket(interval: tuple, open_: list[tuple]) -> tuple[Column, Column]:
    """Whether a row is inside an open interval, and the number of its part of it."""
    h, lo, hi = interval
    key = F.col("h") if h is None else F.col("d")
    inside = (key >= F.lit(lo)) & (key <= F.lit(hi - 1))
    if h is not None:
        inside &= F.col("h") == F.lit(h)
    # 64-bit differences overflow, so they are taken as decimals of 20 digits.
    part = F.floor((key.cast("decimal(20,0)") - F.lit(lo).cast("decimal(20,0)")) / F.lit(_step(lo, hi)).cast("decimal(20,0)"))
    return inside, F.struct(F.lit(open_.index(interval)).alias("i"), part.cast("long").alias("part"), key.alias("key"))


def splitters(keys: DataFrame, weight: str, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The keys (h, d) that cut `keys` (h, d, and the weight column) into shards of nearly equal weight.

    A splitter is final when the weight below it is within tolerance of its
    target, as a part of one shard's weight, or when no key lies between.
    What reaches the driver in a round is at most PROBES sums a splitter.
    """
    total = keys.agg(F.sum(weight)).first()[0] or 0
    found = [Splitter(total * (i + 1) / shards) for i in range(shards - 1)]
    allowed = tolerance * total / shards
    while open_ := list(dict.fromkeys(s.interval() for s in found if not s.done)):
        # Intervals may nest (a hash and doc_ids inside one hash), so a row can count for several.
        parts = F.filter(F.array(*[F.when(c, p) for c, p in (_bucket(x, open_) for x in open_)]), lambda p: p.isNotNull())
        counted = keys.select(F.explode(parts).alias("p"), weight).groupBy("p.i", "p.part")
        counted = counted.agg(F.sum(weight).alias("w"), F.min("p.key").alias("least"), F.max("p.key").alias("most")).collect()
        sums: dict[int, list] = {}
        for i, part, w, least, most in counted:
            sums.setdefault(i, []).append((part, w, least, most))
        for s in found:
            if s.done:
                continue
            interval, below = s.interval(), s.below
            best = (abs(below - s.target), s.lo)
            for part, w, least, most in sorted(sums.get(open_.index(interval), [])):
                best = min(best, (abs(below - s.target), least))
                if below + w >= s.target:
                    # The next interval is as narrow as the keys in it.
                    s.below, s.lo, s.hi = below, least, most + 1
                    best = min(best, (abs(below + w - s.target), min(most + 1, HIGH)))
                    break
                below += w
            else:
                s.settle(s.hi if s.hi <= HIGH else HIGH)
                continue
            if best[0] <= allowed:
                s.settle(best[1])
            elif s.hi - s.lo == 1 and s.h is None:
                s.h, s.lo, s.hi = s.lo, LOW, HIGH + 1
            elif s.hi - s.lo == 1:
                s.settle(best[1])
    return [s.key for s in found]


def _shard(cuts: list[tuple[int, int]]) -> Column:
    above = [(F.col("h") > F.lit(h)) | ((F.col("h") == F.lit(h)) & (F.col("d") >= F.lit(d))) for h, d in cuts]
    return sum((a.cast("int") for a in above), F.lit(0)).cast("int")


def shard_documents(docs: DataFrame, shards: int = 8, tolerance: float = 0.002) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of docs (doc_id, text).

    law is `bytes`: each shard has an equal part of the sizes, within
    2 * tolerance, or one row where rows are larger than that. size is the
    text's UTF-8 bytes plus 1; a null text counts as empty. slot numbers the
    rows of a shard from 0 in key order, without gaps. A null doc_id sorts as
    the smallest. Rows that repeat both text and doc_id stay together. An
    empty table gives an empty table; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keys = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("d"),
    )
    keys = written(keys, "keys")
    cuts = splitters(keys, "size", shards, tolerance)
    # The one exchange of the rows. Its partitions follow the shards' order, so
    # a row's place is its partition's first place plus its place inside.
    placed = keys.withColumn("shard", _shard(cuts)).repartitionByRange("shard", "h", "d").sortWithinPartitions("shard", "h", "d")
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "placed").withColumn("part", F.shiftright("at", 33))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    # One row for each partition and shard at most: the number of partitions bounds it.
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    out = placed.join(F.broadcast(counts), ["shard", "part"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("at") - F.col("first") + F.col("before")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

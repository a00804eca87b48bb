"""Source divergence audit: how far the sources of a language are from each other, and which terms mark each.

Terms are counted where the texts are read, so only sums cross the network.
Two sources differ by the sum of |p - q| over all kept terms. A term that a
source does not have gives it a baseline that depends on the source alone, so
only the terms that occur are visited: a pair starts from the baselines'
difference for every term and is corrected where one of the two has a term.
Corrections are made block of terms by block of terms, none of which grows
with the language.

The first terms of a source are found by radix select: histograms over ten
value bits at a time, three times, tell the value of rank k; where too many
terms have that very value, histograms over their UTF-8 bytes tell the last
term that still counts. Only terms up to that one are sorted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written
from .textops import sliced, task

#: Documents of a language that a term needs, what is added to every count, and the scale of p.
LEAST_DOCS, ADDED, SCALE = 30, 5, 1_000_000_000
TOP = 50
#: Terms that a scan's counts hold before they go on.
HELD_TERMS = 200_000
#: Cells of a block of terms, sources of a stripe, and entries of one matrix.
BLOCK, STRIPE, ENTRIES = 50_000, 256, 1 << 21
#: Values fit so many bits, of which a histogram takes so many; bytes that one takes; rows that are sorted as they are.
VALUE_BITS, DIGIT, BYTES, FEW = 30, 10, 2, 64

COUNTS = "lang string, source string, term string, n long, docs long"
GROUP = ["lang", "source"]

#: Bytes of terms, A-Z lower-cased; all others are blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _terms(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_TERMS).split()


@task
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            columns = [[lang] * len(n), [source] * len(n), [t.decode("utf-8", "replace") for t in n], list(n.values()), [docs[t] for t in n]]
            types = [pa.string()] * 3 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "source", "term", "n", "docs"])

    for batch in sliced(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            found = Counter(_terms(text))
            n.update(found)
            docs.update(found.keys())
            size += len(n) - before
        if size > HELD_TERMS:
            yield from out()
            held, size = {}, 0
    yield from out()


def _told(*columns: str) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n and n_lang where a term of at least least_docs documents of lang occurs in source; first marks one row of each term.

    A scan gives a term at most once for each HELD_TERMS terms and source, so
    no term is hot, and one exchange by (lang, term) serves the sums of groups
    and of languages alike.
    """
    found = docs.select(*_told("lang", "source", "text")).mapInArrow(_counted, COUNTS).repartition("lang", "term")
    found = found.groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")
    found = found.withColumns({"n_lang": F.sum("n").over(w), "docs": F.sum("docs").over(w), "first": F.col("source") == F.min("source").over(w)})
    return found.where(F.col("docs") >= least_docs).drop("docs")


def _p(n: str, total: str, v: str) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * v)) in decimals, which hold any count."""
    return F.expr(f"1L + cast({SCALE} as decimal(10, 0)) * cast({n} + {ADDED} as decimal(20, 0)) div cast({total} + {ADDED} * {v} as decimal(20, 0))")


def _pair_sums(cells: pa.Table, bases: pa.Table) -> pa.Table:
    """For the stripe's own sources and every other one: T * |b - b'|, and for each term of the own source what it corrects.

    Corrections count double where the other source lacks the term and once where it has it, so a pair's sum over both
    of its orders is twice the sum of |p - q|.
    """
    lang = bases.column("lang")[0].as_py()
    names = bases.column("source").to_pylist()
    base = bases.column("base").to_numpy()
    own = np.flatnonzero(bases.column("own").to_numpy(zero_copy_only=False))
    place = {name: i for i, name in enumerate(names)}
    terms = cells.column("term").combine_chunks().dictionary_encode()
    terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
    column, n_terms = terms.indices.to_numpy(), len(terms.dictionary)
    row = np.fromiter((place[s] for s in cells.column("source").to_pylist()), np.int64, len(cells))
    p = cells.column("p").to_numpy()
    apart = np.abs(base[own][:, None] - base[None, :])
    sums = n_terms * apart
    order = np.argsort(column, kind="stable")
    column, row, p = column[order], row[order], p[order]
    step = max(1, ENTRIES // len(names))
    for first in range(0, n_terms, step):
        a, e = np.searchsorted(column, (first, first + step))
        width = min(step, n_terms - first)
        dense = np.repeat(base[:, None], width, 1)
        there = np.zeros((len(names), width), np.int64)
        dense[row[a:e], column[a:e] - first] = p[a:e]
        there[row[a:e], column[a:e] - first] = 1
        for k, i in enumerate(own):
            at = np.flatnonzero(there[i])
            sums[k] += ((np.abs(dense[:, at] - dense[i, at]) - apart[k][:, None]) * (2 - there[:, at])).sum(1)
    left, right = np.repeat(own, len(names)), np.tile(np.arange(len(names)), len(own))
    keep = left != right
    names_array = pa.array(names, pa.string())
    return pa.table({
        "lang": pa.array([lang] * int(keep.sum()), pa.string()),
        "source": names_array.take(pa.array(left[keep])),
        "item": names_array.take(pa.array(right[keep])),
        "twice": pa.array(sums.ravel()[keep], pa.int64()),
    })


def pair_values(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item and value of each two sources of a language.

    cells have lang, source, term and p where the term occurs; groups have lang, source, base (p where it does not),
    n_blocks and n_stripes, the same in a language.
    """
    block, stripe = F.expr("pmod(xxhash64(term), n_blocks)").alias("block"), F.explode(F.expr("sequence(0L, n_stripes - 1)")).alias("stripe")
    of_lang = groups.groupBy("lang").agg(F.first("n_blocks").alias("n_blocks"), F.first("n_stripes").alias("n_stripes"))
    cells = cells.join(of_lang, "lang").select(*GROUP, "term", "p", block, stripe)
    bases = groups.select("*", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block")).select("*", stripe)
    bases = bases.select(*GROUP, "base", "block", "stripe", (F.expr("pmod(xxhash64(source), n_stripes)") == F.col("stripe")).alias("own"))
    keys = ["lang", "block", "stripe"]
    sums = cells.groupBy(*keys).cogroup(bases.groupBy(*keys)).applyInArrow(_pair_sums, "lang string, source string, item string, twice long")
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("pair")
    sums = sums.groupBy("lang", "source", "item").agg(F.sum("twice").alias("twice")).select("lang", both, "twice")
    return sums.groupBy("lang", "pair.source", "pair.item").agg(F.expr("sum(twice) div 2").alias("value"))


def _picked(histogram: DataFrame, keys: list[str], descending: bool) -> DataFrame:
    """Of each group's bins the one that holds its rank `need`, or the last; need becomes the rank inside it."""
    w = Window.partitionBy(*keys).orderBy(F.desc("bin") if descending else F.asc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    open_ = histogram.withColumn("passed", F.coalesce(F.sum("n").over(w), F.lit(0))).where("passed < need")
    best = (F.min_by if descending else F.max_by)(F.struct("bin", "n", (F.col("need") - F.col("passed")).alias("need")), "bin")
    return open_.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, bits: int = VALUE_BITS) -> DataFrame:
    """The first k rows of each group of keys by value, descending, then item by its UTF-8 bytes, with `rank` from 1.

    value is a long from 0 to 2**bits - 1 (bits a multiple of DIGIT) and item a string, neither null; keys may be null-safe strings, none of them
    null. Of rows that are equal in both any are taken. No group is ever in one task but for its histogram, at most 2**DIGIT or
    256**BYTES bins, and for what is ranked.
    """
    state = rows.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("prefix"), F.lit(k).cast("long").alias("need"))
    for shift in range(bits - DIGIT, -1, -DIGIT):
        inside = rows.join(state, keys).where(F.shiftright(value, shift + DIGIT) == F.col("prefix"))
        bins = inside.groupBy(*keys, "prefix", "need", F.shiftright(value, shift).alias("bin")).agg(F.count("*").alias("n"))
        state = _picked(bins, keys, True).withColumnRenamed("bin", "prefix")
    # prefix is now the value of rank k, `need` of the n rows that have it still count.
    state = state.select(*keys, F.col("prefix").alias("least"), "need", "n", F.lit("").alias("last"), F.lit(False).alias("done"))
    hexed = F.hex(F.encode(F.col(item), "utf-8"))
    at = 0
    while True:
        settled = F.col("done") | (F.col("n") <= F.col("need")) | (F.col("n") <= FEW)
        state = written(state.withColumn("done", settled), "ties")
        if state.where("not done").isEmpty():
            break
        live = state.where("not done").drop("n")
        ties = rows.join(live, keys).where((F.col(value) == F.col("least")) & (F.substring(hexed, 1, 2 * at) == F.col("last")))
        bins = ties.groupBy(*keys, "least", "need", F.substring(hexed, 1, 2 * (at + BYTES)).alias("bin")).agg(F.count("*").alias("n"))
        at += BYTES
        # Texts that end within these bytes are all the same.
        found = _picked(bins, [*keys, "least"], False).withColumnRenamed("bin", "last").withColumn("done", F.length("last") < 2 * at)
        state = state.where("done").unionByName(found.select(*state.columns))
    taken = (F.col(value) > F.col("least")) | ((F.col(value) == F.col("least")) & (F.substring(hexed, 1, F.length("last")) <= F.col("last")))
    first = rows.join(state.drop("need", "n", "done"), keys).where(taken).drop("least", "last")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), item))).where(F.col("rank") <= k)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: each other source of the language (part pair), and the source's `top` terms (part term).

    docs has text, lang and source; nulls are empty strings, other columns are
    ignored, rows count one by one and an empty table gives an empty one. A
    source without any kept term, or a language without one, has its pairs all
    the same. Sums of a pair are exact up to 2**62.
    """
    cells = written(kept_terms(docs, least_docs), "cells")
    groups = docs.select(*_told(*GROUP)).distinct()
    groups = written(groups.join(cells.groupBy(*GROUP).agg(F.sum("n").alias("total"), F.count("*").alias("cells"), F.count_if("first").alias("v")), GROUP, "left").na.fill(0), "groups")
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources"), *(F.sum(c).alias(to) for c, to in (("total", "total_lang"), ("cells", "cells"), ("v", "v"))))
    langs = langs.withColumns({"n_blocks": F.expr(f"greatest(1L, cells div {BLOCK})"), "n_stripes": F.expr(f"(sources + {STRIPE - 1}) div {STRIPE}")})
    groups = groups.drop("cells", "v").join(langs, "lang")
    groups = written(groups.withColumn("base", F.when(F.col("v") > 0, _p("0", "total", "v")).otherwise(F.lit(1).cast("long"))), "bases")
    weighed = cells.join(groups, GROUP).select(*GROUP, "term", _p("n", "total", "v").alias("p"), _p("n_lang", "total_lang", "v").alias("q"))
    weighed = written(weighed, "weighed")
    pairs = pair_values(weighed.drop("q"), groups.select(*GROUP, "base", "n_blocks", "n_stripes"))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")))
    marks = weighed.where("p > q").select(*GROUP, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    marks = radix_top(marks, GROUP, "value", "item", top)
    pairs, marks = (df.select(*GROUP, F.lit(part).alias("part"), "item", "value", "rank") for part, df in (("pair", pairs), ("term", marks)))
    return pairs.unionByName(marks)

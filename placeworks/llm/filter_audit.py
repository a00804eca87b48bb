"""Filter interaction audit: what each of five filters removes in each of their 120 orders.

Texts are routed by fingerprint. Every task of the scan keeps collision chains:
a fingerprint leads to the texts that have it, whole, each with the least id
seen so far. A row with a larger id than its text's least is a copy for good
and is emitted at once; only the least id of each text goes on, as a row of an
RDD partitioned by xxhash, where chains of the same kind settle which of the
ids that arrive is the least of all. So a text that a third of all rows share
crosses the network once for each part of a scan, not once a row.

What is emitted is a document's mask of failed filters. Masks meet the labels
by doc_id and are counted in vectors, one for each part, by combineByKey; all
orders follow from a vector's 32 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby, permutations
from operator import itemgetter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written
from .textops import sliced, task

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
A, B, C, D, E = (1 << i for i in range(5))
_CAPITALS, _SIGNS = bytes(range(65, 91)), b"#$%&*|"
#: Bytes of text that a scan's chains hold before what they have goes on.
CHAIN_BYTES = 16 << 20

ROWS = "doc_id long, part string, mask int, n long"
AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"

#: doc_id, part, mask, number of rows
Row = tuple[int | None, str, int, int]


def failures(text: str) -> int:
    """The bits of the filters A to D that a text fails."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at the white space of ASCII, as bytes are
    mask = A * (len(words) < LEAST_WORDS)
    mask |= B * (100 * len(set(words)) < LEAST_DISTINCT * len(words))
    mask |= C * (100 * (len(data) - len(data.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text))
    return mask | D * (len(data.translate(None, _SIGNS)) < len(data))


class Chains:
    """By fingerprint, the texts that have it: [text, least id, mask, {part: rows of that id}]."""

    def __init__(self) -> None:
        self.chains: dict[int, list[list]] = {}

    def find(self, print_: int, text: str) -> list | None:
        return next((link for link in self.chains.get(print_, ()) if link[0] == text), None)

    def start(self, print_: int, text: str, least: int, mask: int, parts: dict[str, int]) -> None:
        self.chains.setdefault(print_, []).append([text, least, mask, parts])

    def links(self) -> Iterator[tuple[int, list]]:
        return ((print_, link) for print_, chain in self.chains.items() for link in chain)


def meet(link: list, doc_id: int, parts: dict[str, int]) -> Iterator[Row]:
    """The rows that are copies for good, now that rows of doc_id have the link's text too."""
    text, least, mask, held = link
    if doc_id == least:
        for part, n in parts.items():
            held[part] = held.get(part, 0) + n
        return
    if doc_id < least:
        link[1], link[3] = doc_id, dict(parts)
        doc_id, parts = least, held
    for part, n in parts.items():
        yield doc_id, part, mask | E, n


#: What a scan gives: texts with their least id there, and, without a text, rows that are settled.
ROUTED = "print long, text string, doc_id long, mask int, parts map<string, long>"
_ROUTED = pa.schema([("print", pa.int64()), ("text", pa.string()), ("doc_id", pa.int64()), ("mask", pa.int32()), ("parts", pa.map_(pa.string(), pa.int64()))])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_ROUTED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROUTED, strict=True)], schema=_ROUTED)


@task
def _routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, text, part) each text with its least id, and the rows that are settled."""
    chains, held = Chains(), 0

    def links() -> pa.RecordBatch:
        return _batch([(print_, text, least, mask, list(parts.items())) for print_, (text, least, mask, parts) in chains.links()])

    for batch in sliced(batches):
        done: list[Row] = []
        for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            if doc_id is None:
                done.append((None, part, failures(text), 1))
                continue
            print_ = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
            link = chains.find(print_, text)
            if link is not None:
                done += meet(link, doc_id, {part: 1})
                continue
            chains.start(print_, text, doc_id, failures(text), {part: 1})
            held += len(text) + 200
            if held > CHAIN_BYTES:
                yield links()
                chains, held = Chains(), 0
        yield _batch([(None, None, doc_id, mask, [(part, n)]) for doc_id, part, mask, n in done])
    yield links()


def settled(records: Iterator[tuple[int, tuple]]) -> Iterator[Row]:
    """The rows of texts (fingerprint, (text, least id, mask, parts)) that come by fingerprint, so one chain is held at a time."""
    for print_, group in groupby(records, key=itemgetter(0)):
        chains = Chains()
        for _, (text, doc_id, mask, parts) in group:
            link = chains.find(print_, text)
            if link is None:
                chains.start(print_, text, doc_id, mask, parts)
            else:
                yield from meet(link, doc_id, parts)
        for _, (_, least, mask, parts) in chains.links():
            for part, n in parts.items():
                yield least, part, mask, n


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and n: the rows of docs (doc_id, text, lang) that have the first three in common.

    Bit i of mask is set where the text fails filter i of ABCDE. E is the copy:
    a smaller doc_id has the same text. A null text is empty, a null lang the
    part "". A null doc_id is smaller than none and never a copy; rows that
    repeat a text under its least doc_id are no copies either. Other columns
    are ignored; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "lang")]
    routed = written(docs.select(F.col("doc_id").cast("long"), *told).mapInArrow(_routed, ROUTED), "routed")
    copies = routed.where("text is null").select("doc_id", "mask", F.explode("parts").alias("part", "n"))
    texts = routed.where("text is not null").rdd.map(lambda r: (r[0], tuple(r[1:])))
    parts = max(2 * texts.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    chained = texts.repartitionAndSortWithinPartitions(parts, partitionFunc=lambda print_: print_).mapPartitions(settled)
    found = spark.createDataFrame(chained, ROWS, verifySchema=False).unionByName(copies)
    return found.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))


def _add(vector: list[int], row: tuple[int, int, int, int]) -> list[int]:
    mask, n, good, toxic = row
    for i, x in enumerate((n, good, toxic)):
        vector[3 * mask + i] += x
    return vector


def _create(row: tuple[int, int, int, int]) -> list[int]:
    return _add([0] * 96, row)


def _merge(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b, strict=True)]


def orders(part: str, vector: list[int]) -> Iterator[tuple]:
    """The rows of a part: every order of the filters, every step."""
    counts = [vector[3 * m : 3 * m + 3] for m in range(32)]

    def total(column: int, some: int, none: int) -> int:
        return sum(counts[m][column] for m in range(32) if m & some and not m & none)

    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        before = 0
        for k, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            removed = total(0, bit, before)
            shapley[letter] += removed
            kept = sum(counts[m][0] for m in range(32) if not m & (before | bit))
            steps.append(("".join(order), k, kept, removed, total(0, bit, 0) - removed, counts[bit][0], total(1, bit, before), total(2, bit, before)))
            before |= bit
    for step in steps:
        yield (part, *step, shapley[step[0][step[1] - 1]])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The counts of AUDIT for each part of docs (doc_id, text, lang), each order of the filters and each step.

    labels (doc_id, quality, toxic) tell which documents are good and which
    toxic; where an id has several labels one that says so is enough, null
    labels say nothing, and a null doc_id has none. Rows of docs count one by
    one. For the rest see `masks`.
    """
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).cast("int").alias(c) for c in ("quality", "toxic")))
    known = masks(docs).join(said, "doc_id", "left").select("part", "mask", "n", *((F.coalesce(c, F.lit(0)) * F.col("n")).alias(c) for c in ("quality", "toxic")))
    vectors = known.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_create, _add, _merge)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: orders(*kv)), AUDIT, verifySchema=False)

"""Removal of long repeated byte strings with suffix arrays of corpus shards.

Every string of LENGTH bytes contains windows of K bytes; the one of least
hash (the leftmost of equals) is its anchor. Equal strings have equal anchors
at equal offsets, so a string can only repeat where its anchor does, and the
strings of an anchor make up one region around it. Regions that are equal as a
whole are counted, not compared. Others are split by where strings begin: the
strings that begin in one part of the region all contain its core, so parts
are grouped by the core's hash, and parts that no other region shares, or that
are equal as a whole, are done. What is left are the parts in which a repeat
begins or ends. They go to shards in which all parts of a core are together: a
shard's suffix array is induced (induced.py), and runs of suffixes whose
permuted common prefixes reach LENGTH mark what repeats.

A core of more than MOST different parts is split further, down to single
strings. A passage in any number of documents therefore never meets in one
task.

Passages are told beside it: runs of PASSAGE words or more that another text
has too, most of which are shorter than LENGTH bytes. They have anchors among
the words in the same way; of the regions that differ, all strings are
compared by their hashes.

Equality of regions and cores is that of two 64-bit hashes at once, of the
anchor and of the region. They are sums of powers modulo 2**64, which differ on
complementary Thue-Morse strings of up to 512 bytes; a region has 736 at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T
from .induced import common_prefixes, suffix_array
from .near_dedup import _blocks
from .scratch import written

LENGTH, K = 400, 64
#: A string begins at most this many bytes before its anchor.
REACH = LENGTH - K
#: Different parts of a core that share a shard, and bytes of a shard.
MOST, SHARD_BYTES = 64, 1 << 19
#: Into how many parts the beginnings are split at each level: 337 are 43, 6 and 1.
PARTS = 8
SEGMENT = 1 << 20
#: Words of a passage, and of the windows that are its anchors.
PASSAGE, PASSAGE_K = 51, 8

_U = np.uint64
INTERVAL = "rid long, a long, b long"


def _prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    powers, inverse = T._powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + _U(1)) * powers[: len(buf)], out=sums[1:])
    return sums, inverse


def _range_hash(sums: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return T.mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` neighbours."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(buf: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, ...]:
    """(places, begins, ends, anchor hashes, region hashes) of all anchors of some documents, given as bytes or as hashes of words; the region is [begin, end)."""
    if len(buf) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums, inverse = _prefix(buf)
    hashes = T.mix((sums[k:] - sums[:-k]) * inverse[: len(buf) - k + 1])
    first, last = np.full(len(buf), len(buf), np.int64), np.full(len(buf), -1, np.int64)
    stops = offsets[1:]
    for begin in range(0, len(buf) - length + 1, SEGMENT - length):
        part = hashes[begin : begin + SEGMENT - k + 1]
        if len(part) < length - k + 1:
            break
        # Hash first, then place: the leftmost of equals is the least.
        least = _least((part & ~_U(SEGMENT - 1)) | np.arange(len(part), dtype=np.uint64), length - k + 1)
        starts = begin + np.arange(len(least))
        whole = starts + length <= stops[np.searchsorted(stops, starts, side="right")]
        starts, chosen = starts[whole], begin + (least[whole] & _U(SEGMENT - 1)).astype(np.int64)
        if not len(chosen):
            continue
        # The strings of an anchor begin in one run of places.
        new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1]))
        at = chosen[new]
        np.minimum.at(first, at, starts[new])
        np.maximum.at(last, at, starts[np.append(new[1:], len(chosen)) - 1])
    places = np.flatnonzero(last >= 0)
    lo, hi = first[places], last[places] + length
    region = T.mix(_range_hash(sums, inverse, lo, hi) + (places - lo).astype(np.uint64))
    return places, lo, hi, hashes[places], region


BYTES = ["places", "begins", "ends", "anchors", "regions"]
WORDS = ["word_begins", "word_ends", "word_anchors", "word_regions"]
ANCHORED = "doc_id long, rid long, n_bytes long, sha256 string, " + ", ".join(f"{c} array<long>" for c in BYTES + WORDS)


def _words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of words, case kept, and of each document its first word (and the number of words)."""
    starts, ends, first = T.word_bounds(buf, offsets, T.NONSPACE)
    return T.span_hashes(buf, starts, ends), first


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.sliced(batches):
        buf, offsets = T.text_bytes(batch["text"])
        shas = [hashlib.sha256(buf[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        lists = {c: [np.zeros(0, np.int64)] for c in BYTES + WORDS}
        counts = {c: [np.zeros(1, np.int64)] for c in ("places", "word_begins")}
        for _, _, part, offs in T.chunks(buf, offsets):
            words, first = _words(part, offs)
            for names, symbols, bounds, length, k in ((BYTES, part, offs, LENGTH, K), (WORDS, words, first, PASSAGE, PASSAGE_K)):
                places, lo, hi, anchor, region = anchors(symbols, bounds, length, k)
                own = np.diff(np.searchsorted(places, bounds))
                base = np.repeat(bounds[:-1], own)
                counts[names[0]].append(own)
                for c, values in zip(names, [places - base, lo - base, hi - base, anchor.view(np.int64), region.view(np.int64)][-len(names) :], strict=True):
                    lists[c].append(values)
        cuts = {c: pa.array(np.cumsum(np.concatenate(n)).astype(np.int32)) for c, n in counts.items()}
        columns = [pa.ListArray.from_arrays(cuts["places" if c in BYTES else "word_begins"], pa.array(np.concatenate(v))) for c, v in lists.items()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rid"], pa.array(np.diff(offsets)), pa.array(shas, pa.string()), *columns], names=["doc_id", "rid", "n_bytes", "sha256", *lists])


CHILD = "key long, region long, rid long, pos long, n long, i0 int, i1 int, lo long, hi long"


def _parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the wanted regions of each document, by where strings begin: strings that begin i bytes before the anchor, i0 <= i < i1."""
    width = -(-(REACH + 1) // PARTS)
    for batch in T.sliced(batches):
        buf, offsets = T.text_bytes(batch["text"])
        lists = batch["wanted"]
        flat, cuts = lists.flatten(), np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))).astype(np.int64)
        pos_, lo_, hi_, n_, anchor_ = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "lo", "hi", "n", "anchor"))
        rid_ = np.repeat(batch["rid"].to_numpy(), np.diff(cuts))
        for row, last, part, offs in T.chunks(buf, offsets):
            own = slice(cuts[row], cuts[last])
            base = np.repeat(offs[:-1], np.diff(cuts[row : last + 1]))
            pos, lo, hi = pos_[own] + base, lo_[own] + base, hi_[own] + base
            sums, inverse = _prefix(part)
            for i0 in range(0, REACH + 1, width):
                i1 = min(i0 + width, REACH + 1)
                # The least and the last place at which the region's strings of this part begin.
                begin, stop = np.maximum(lo, pos - (i1 - 1)), np.minimum(hi - LENGTH, pos - i0)
                use = np.flatnonzero(begin <= stop)
                core = _range_hash(sums, inverse, pos[use] - i0, pos[use] - (i1 - 1) + LENGTH)
                key = T.mix(core + anchor_[own][use].view(np.uint64) * _U(2 * i0 + 3))
                a, b = begin[use], stop[use] + LENGTH
                region = T.mix(_range_hash(sums, inverse, a, b) + (pos[use] - a).astype(np.uint64))
                many = [np.full(len(use), x, np.int32) for x in (i0, i1)]
                columns = [key.view(np.int64), region.view(np.int64), rid_[own][use], pos[use] - base[use], n_[own][use], *many, a - base[use], b - base[use]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "region", "rid", "pos", "n", "i0", "i1", "lo", "hi"])


def _fetched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the listed parts of each document."""
    for batch in batches:
        for text, rid, wanted in zip(batch["text"].to_pylist(), batch["rid"].to_pylist(), batch["wanted"].to_pylist(), strict=True):
            raw = (text or "").encode()
            yield _rows([(w["key"], rid, w["pos"], w["n"], w["m"], w["i0"], w["i1"], w["lo"], raw[w["lo"] : w["hi"]]) for w in wanted])


ROW = "key long, rid long, pos long, n long, m long, i0 int, i1 int, lo long, bytes binary"
_TYPES = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=["key", "rid", "pos", "n", "m", "i0", "i1", "lo", "bytes"])


def repeated_starts(regions: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """Of each region (document, place in it, bytes): the offsets at which a string of LENGTH starts that also starts elsewhere.

    One suffix array over all regions. Suffixes that share LENGTH bytes are
    neighbours; where they stand for one place only, nothing repeats.
    """
    sizes = np.array([len(b) for _, _, b in regions], np.int64)
    text = np.zeros(int((sizes + 1).sum()) + 1, np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    for s, (_, _, b) in zip(starts.tolist(), regions, strict=True):
        text[s : s + len(b)] = np.frombuffer(b, np.uint8).astype(np.int64) + 2
        text[s + len(b)] = 1
    sa = suffix_array(text)
    shared = common_prefixes(text, sa, LENGTH)[sa]
    region = np.searchsorted(starts, sa, side="right") - 1
    offset = sa - starts[region]
    whole = offset + LENGTH <= sizes[region]
    run = np.cumsum((shared < LENGTH) | ~whole | ~np.append(False, whole[:-1]))
    use = np.flatnonzero(whole)
    doc = np.array([d for d, _, _ in regions], np.int64)[region[use]]
    place = np.array([p for _, p, _ in regions], np.int64)[region[use]] + offset[use]
    order = np.lexsort((place, doc, run[use]))
    r, d, p = run[use][order], doc[order], place[order]
    other = (r[1:] == r[:-1]) & ((d[1:] != d[:-1]) | (p[1:] != p[:-1]))
    several = np.zeros(int(run[-1]) + 1, bool)
    several[r[1:][other]] = True
    hit = use[several[run[use]]]
    found = np.argsort(region[hit], kind="stable")
    cuts = np.searchsorted(region[hit][found], np.arange(len(regions) + 1))
    return [np.sort(offset[hit][found[a:b]]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated intervals of the regions that occur once, from shards of whole groups."""

    def intervals(held: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        out = []
        for (n, rid, lo, _), starts in zip(held, repeated_starts([h[1:] for h in held]), strict=True):
            if n == 1 and len(starts):
                cut = np.flatnonzero(np.diff(starts) > LENGTH)
                for a, b in zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist(), strict=True):
                    out.append((rid, lo + a, lo + b + LENGTH))
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rid", "a", "b"])

    held, size = [], 0
    for table in _blocks(batches, ["key"]):
        for n, rid, lo, raw in zip(*(table[c].to_pylist() for c in ("n", "rid", "lo", "bytes")), strict=True):
            held.append((n, rid, lo, raw))
            size += len(raw) + 1
        if size >= SHARD_BYTES:
            yield intervals(held)
            held, size = [], 0
    if held:
        yield intervals(held)


CHILD_BYTES = "key long, region long, rid long, pos long, n long, i0 int, i1 int, lo long, bytes binary"


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of regions by where strings begin, for parts whose core the document has."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            width = -(-(r["i1"] - r["i0"]) // PARTS)
            raw = r["bytes"]
            for i0 in range(r["i0"], r["i1"], width):
                i1 = min(i0 + width, r["i1"])
                # Strings that begin i bytes before the anchor, i0 <= i < i1; a and b bound their core.
                a, b = r["pos"] - i0 - r["lo"], r["pos"] - (i1 - 1) + LENGTH - r["lo"]
                if a < 0 or b > len(raw):
                    continue
                lo, hi = max(0, r["pos"] - (i1 - 1) - r["lo"]), min(len(raw), r["pos"] - i0 + LENGTH - r["lo"])
                key = hashlib.blake2b(b"%d %d " % (r["key"], i0) + raw[a:b], digest_size=8).digest()
                region = hashlib.blake2b(b"%d " % (a - lo) + raw[lo:hi], digest_size=8).digest()
                out.append((int.from_bytes(key, "little", signed=True), int.from_bytes(region, "little", signed=True), r["rid"], r["pos"], r["n"], i0, i1, r["lo"] + lo, raw[lo:hi]))
        columns = list(zip(*out, strict=True)) or [()] * 9
        types = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["key", "region", "rid", "pos", "n", "i0", "i1", "lo", "bytes"])


def _several(regions: DataFrame, key: str, name: str) -> DataFrame:
    """Keys of more than one different region, of which at least one occurs once: key and m, their number."""
    counted = regions.groupBy(key).agg(F.count("*").alias("m"), F.count_if(F.col("n") == 1).alias("open"))
    return written(counted.where("m > 1 and open > 0").select(key, "m"), name)


def _settled(parts: DataFrame, end: str) -> tuple[DataFrame, DataFrame]:
    """Of parts (key, region, rid, pos, n, lo): the intervals of those that are equal to another, and one of each different one that shares its core (n, m: occurrences, different ones)."""
    merged = written(parts.groupBy("key", "region").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "pos")).alias("rep")), "merged")
    same = parts.where("n = 1").join(merged.where("n > 1").select("key", "region"), ["key", "region"])
    left = merged.join(_several(merged, "key", "several"), "key").select("key", "region", F.col("n").alias("n_all"), "m", "rep.rid", "rep.pos")
    rows = parts.join(written(left, "left"), ["key", "region", "rid", "pos"]).drop("n").withColumnRenamed("n_all", "n")
    return same.select("rid", F.col("lo").alias("a"), F.expr(end).cast("long").alias("b")), rows


def _intervals(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """Intervals (rid, a, b) whose union is what repeats."""
    x = F.explode(F.arrays_zip("places", "begins", "ends", "anchors", "regions")).alias("x")
    names = {"places": "pos", "begins": "lo", "ends": "hi", "anchors": "anchor", "regions": "region"}
    every = seen.select("rid", x).select("rid", *[F.col(f"x.{k}").alias(v) for k, v in names.items()])
    repeated = written(every.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "repeated")
    every = written(every.join(repeated, "anchor"), "occurrences")
    regions = every.groupBy("anchor", "region").agg(F.count("*").alias("n"), F.min(F.struct("rid", "pos", "lo", "hi")).alias("rep"))
    regions = written(regions, "regions")
    equal = every.join(regions.where("n > 1").select("anchor", "region"), ["anchor", "region"])
    out = [equal.select("rid", F.col("lo").alias("a"), F.col("hi").alias("b"))]

    wanted = regions.join(_several(regions, "anchor", "several"), "anchor").select("anchor", "n", "rep.*")
    wanted = written(wanted.groupBy("rid").agg(F.collect_list(F.struct("anchor", "n", "pos", "lo", "hi")).alias("wanted")), "wanted")
    # Rows that repeat both doc_id and text share a rid: one of them is enough. The
    # ids grow with the corpus, so they are not broadcast.
    texts = written(docs.join(wanted.hint("merge"), "rid").groupBy("rid").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted")), "texts")
    parts = written(texts.mapInArrow(T.task(_parted), CHILD), "parts")
    same, rows = _settled(parts, "hi")
    out.append(same)
    wanted = rows.groupBy("rid").agg(F.collect_list(F.struct("key", "n", "m", "pos", "i0", "i1", "lo", "hi")).alias("wanted"))
    rows = written(texts.drop("wanted").join(wanted, "rid").select("rid", "text", "wanted").mapInArrow(T.task(_fetched), ROW), "rows")
    for level in range(3):
        small = rows.where(F.col("m") <= MOST).select("key", "n", "rid", "lo", "bytes")
        out.append(small.repartition("key").sortWithinPartitions("key").mapInArrow(T.task(_sharded), INTERVAL))
        hot = rows.where(F.col("m") > MOST)
        if level == 2 or hot.isEmpty():
            break
        same, rows = _settled(written(hot.drop("m").mapInArrow(T.task(_split), CHILD_BYTES), "parts"), "lo + octet_length(bytes)")
        out.append(same)
        rows = written(rows.select("key", "rid", "pos", "n", "m", "i0", "i1", "lo", "bytes"), "rows")
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return written(found, "intervals")


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each string of PASSAGE words in the wanted regions of each text, and where it begins."""
    for batch in T.sliced(batches):
        buf, offsets = T.text_bytes(batch["text"])
        wanted, rids = batch["wanted"].to_pylist(), batch["rid"].to_pylist()
        for row, last, part, offs in T.chunks(buf, offsets):
            words, first = _words(part, offs)
            if len(words) < PASSAGE:
                continue
            sums, inverse = _prefix(words)
            out = [(rids[d], w["a"], w["b"], w["many"], int(first[d - row])) for d in range(row, last) for w in wanted[d]]
            rid, a, b, many, base = (np.array(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 5
            n = b - a - PASSAGE + 1
            at = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = at + np.repeat(base, n)
            keys = _range_hash(sums, inverse, begin, begin + PASSAGE)
            columns = [pa.array(keys.view(np.int64)), pa.array(np.repeat(rid, n)), pa.array(at), pa.array(np.repeat(many, n).astype(bool))]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "rid", "a", "many"])


def _passages(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """rid and n_passages, the number of maximal runs of words of which each is in a string of PASSAGE words that another text has too; texts without any are left out."""
    x = F.explode(F.arrays_zip(*WORDS)).alias("x")
    names = {"word_begins": "a", "word_ends": "b", "word_anchors": "anchor", "word_regions": "region"}
    every = seen.select("rid", x).select("rid", *[F.col(f"x.{k}").alias(v) for k, v in names.items()])
    several = (F.min("rid").alias("least"), F.max("rid").alias("most"))
    met = written(every.groupBy("anchor").agg(*several).where("least < most").select("anchor"), "met")
    every = written(every.join(met, "anchor"), "met_regions")
    regions = every.groupBy("anchor", "region").agg(*several, F.min(F.struct("rid", "a", "b")).alias("rep"))
    regions = written(regions.withColumn("many", F.col("least") < F.col("most")), "regions")
    # A region that several texts have is a passage as a whole; of others, strings decide.
    whole = every.join(regions.where("many").select("anchor", "region"), ["anchor", "region"]).select("rid", "a", "b")
    open_ = written(regions.groupBy("anchor").agg(F.count("*").alias("m"), F.count_if(~F.col("many")).alias("alone")).where("m > 1 and alone > 0").select("anchor"), "open")
    wanted = regions.join(open_, "anchor").groupBy("rep.rid").agg(F.collect_list(F.struct("rep.a", "rep.b", "many")).alias("wanted"))
    # The ids grow with the corpus, so they are not broadcast; rows that repeat both doc_id and text share one.
    texts = docs.join(written(wanted, "wanted").hint("merge"), "rid").dropDuplicates(["rid"]).select("rid", "text", "wanted")
    strings = written(texts.mapInArrow(T.task(_strings), "key long, rid long, a long, many boolean"), "strings")
    shared = strings.groupBy("key").agg(*several, F.max("many").alias("any")).where("least < most or any").select("key")
    part = strings.where("not many").join(shared, "key").select("rid", "a", (F.col("a") + PASSAGE).alias("b"))
    runs = whole.unionByName(part).groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("runs"))
    counted = "aggregate(runs, named_struct('n', 0L, 'end', -1L), (s, x) -> named_struct('n', s.n + IF(x.a > s.end, 1L, 0L), 'end', greatest(s.end, x.b)), s -> s.n)"
    return written(runs.select("rid", F.expr(counted).alias("n_passages")), "passages")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, removed, spans, shas = [], [], [], []
        for text, runs in zip(pc.fill_null(batch["text"], "").to_pylist(), batch["runs"].to_pylist(), strict=True):
            raw = text.encode()
            r = np.array([(x["a"], x["b"]) for x in runs], np.int64).reshape(-1, 2)
            r = r[np.argsort(r[:, 0], kind="stable")]
            reach = np.maximum.accumulate(r[:, 1])
            first = np.append(True, r[1:, 0] > reach[:-1])
            a, b = r[first, 0], reach[np.append(first[1:], True)]
            kept, at = [], 0
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                kept.append(raw[at:x])
                at = y
            left = b"".join([*kept, raw[at:]])
            texts.append(left)
            removed.append(int((b - a).sum()))
            spans.append(len(a))
            shas.append(hashlib.sha256(left).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["rid"], batch["n_bytes"], pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.binary())],
            names=["doc_id", "rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def remove_repeats(docs: DataFrame, kept_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, and with kept_bytes the bytes kept, of every row of docs (doc_id, text).

    A byte is removed when a string of 400 bytes that also starts at another
    place of the corpus covers it, in the same document or another; matches
    never cross documents, and strings are judged on the input. n_spans counts
    the maximal removed runs.

    n_passages counts the runs of words (any bytes but ASCII white space, case
    kept) that are covered by strings of 51 words which a row of another
    doc_id or text has too, however long they are in bytes. They are told, not
    removed.

    Null and empty texts have no bytes. Rows that repeat a doc_id get a row
    each, and remove what they share from each other. A null doc_id stays null.
    Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    seen = written(docs.mapInArrow(T.task(_anchored), ANCHORED), "anchors")
    passages = _passages(docs, seen)
    runs = written(_intervals(docs, seen).groupBy("rid").agg(F.collect_list(F.struct("a", "b")).alias("runs")), "runs")
    columns = ["doc_id", "rid", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * kept_bytes]
    cut = docs.join(runs, "rid").select("doc_id", "rid", "text", F.octet_length("text").cast("long").alias("n_bytes"), "runs")
    cut = cut.mapInArrow(T.task(_cut), "doc_id long, rid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    rest = (docs if kept_bytes else seen).join(runs.select("rid"), "rid", "left_anti")
    zero = F.lit(0).cast("long")
    told = {"n_removed": zero, "n_spans": zero}
    if kept_bytes:
        raw = F.col("text").cast("binary")
        rest = rest.withColumns(told | {"n_bytes": F.octet_length("text").cast("long"), "kept_sha256": F.sha2(raw, 256), "kept": raw})
    else:
        rest = rest.withColumns(told).withColumnRenamed("sha256", "kept_sha256")
    out = cut.select(*columns).unionByName(rest.select(*columns)).join(passages, "rid", "left")
    return out.drop("rid").fillna(0, ["n_passages"])

"""Toxicity by a convolutional text classifier written in numpy.

A word is the sum of hashed embeddings: its own and those of its first bytes,
which stand for inflected forms. Filters of several widths slide over the
words, each filter keeps its maximum over the whole text, and a logistic layer
scores the maxima. A filter's value is a sum of table rows for the words under
it, so scoring needs only gathers and maxima: the products of embeddings and
filters are made once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

from . import textops as T
from .scratch import written

BUCKET_BITS, DIM, WIDTHS, FILTERS = 15, 16, (1, 2, 3), 8
#: First bytes of a word that have an embedding of their own, beside the whole word.
PREFIXES = (4, 6)
PARTS = 1 + len(PREFIXES)
#: Fitting takes at most this many labelled rows of each class, those first by
#: a hash of doc_id, with whole texts; gradients are summed over parts of a
#: minibatch of so many padded words at most, or of one text.
SAMPLE_PER_CLASS, PART_WORDS = 2500, 76_800
EPOCHS, LEAST_STEPS, BATCH, RATE, SEED = 12, 600, 64, 0.004, 7
#: One in so many of the chosen rows calibrates thresholds instead of training.
CALIBRATES = 6
#: Where there are more labelled rows, training goes on over all of them: so many
#: rounds, of an epoch and so many steps at least, in parts of about so many rows and bytes of ids; sums of parameters are
#: exact in units of 2 to the power of -UNIT_BITS, thresholds in units of a bin.
ROUNDS, ROUND_STEPS, PART_ROWS, PART_BYTES, UNIT_BITS, BINS = 3, 80, 5000, 1 << 26, 30, 4096
SCORE_AT = 0.7
#: Thresholds of a language are those that keep this precision on rows not trained on.
PRECISION, LEAST_ROWS = 0.97, 20


@dataclass
class Model:
    embedding: np.ndarray
    kernels: list[np.ndarray]  # of each width: (width, DIM, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def projected(self) -> np.ndarray:
        """Bucket -> the FILTERS values of each width and place in the filter, side by side."""
        return np.concatenate([self.embedding @ k for kernel in self.kernels for k in kernel], axis=1)


def word_buckets(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(words, PARTS) buckets, 1 and up; 0 is the padding."""
    spans = [ends, *(np.minimum(ends, starts + n) for n in PREFIXES)]
    low = T.LOWER[buf]
    hashes = [T.mix(T.span_hashes(low, starts, e) + np.uint64(i)) for i, e in enumerate(spans)]
    return np.stack([(h >> np.uint64(64 - BUCKET_BITS)).astype(np.int32) + 1 for h in hashes], axis=1)


def _word_chunks(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of words, and of each text its first word (and the number of words); words are runs of digits, letters and non-ASCII characters, lower-cased."""
    buf, offsets = T.text_bytes(column)
    for _, _, part, offs in T.chunks(buf, offsets):
        starts, ends, first = T.word_bounds(part, offs, T.ALNUM)
        yield word_buckets(part, starts, ends), first


def column_buckets(column: pa.Array) -> Iterator[np.ndarray]:
    for ids, first in _word_chunks(column):
        for i in range(len(first) - 1):
            yield ids[first[i] : first[i + 1]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(model: Model, table: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The scores of texts; one of no words scores as padding alone."""
    pad = max(WIDTHS) - 1
    nothing = np.tile(PARTS * table[0], (pad + 1, 1))
    words = table[ids[:, 0]]
    for part in range(1, PARTS):
        words = words + table[ids[:, part]]
    hidden = np.zeros((len(first) - 1, len(WIDTHS) * FILTERS), np.float32)
    for i in range(len(first) - 1):
        own = words[first[i] : first[i + 1]]
        own = np.concatenate([own, nothing[:pad]]) if len(own) else nothing
        n, at = len(own) - pad, 0
        for k, w in enumerate(WIDTHS):
            total = own[:n, at : at + FILTERS]
            for j in range(1, w):
                total = total + own[j : j + n, at + j * FILTERS : at + (j + 1) * FILTERS]
            hidden[i, k * FILTERS : (k + 1) * FILTERS] = total.max(axis=0)
            at += w * FILTERS
    return _sigmoid((np.maximum(hidden + model.bias, 0) @ model.weight + model.offset).astype(float))


def _parts(rows: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """rows, in order of length, in runs whose padded texts have PART_WORDS together at most."""
    first = 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or (i + 1 - first) * lengths[rows[i]] > PART_WORDS:
            yield rows[first:i]
            first = i


def _padded(rows: list[np.ndarray]) -> np.ndarray:
    pad = max(WIDTHS) - 1
    out = np.zeros((len(rows), max(max(map(len, rows)), 1) + pad, PARTS), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> Model:
    """Adam over shuffled minibatches, each row's loss times its weight over the mean weight; deterministic for the same rows."""
    weights = (weights / weights.mean() if len(weights) else weights).astype(np.float32)
    rng = np.random.default_rng(SEED)
    p = {"e": rng.normal(0, 0.1, ((1 << BUCKET_BITS) + 1, DIM)).astype(np.float32)}
    for w in WIDTHS:
        p[f"k{w}"] = rng.normal(0, (2 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32)
    p |= {"b": np.zeros(len(WIDTHS) * FILTERS, np.float32), "w": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "o": np.zeros(1, np.float32)}
    p["e"][0] = 0
    least = -(-LEAST_STEPS // max(1, -(-len(texts) // BATCH)))
    return _model(_learned(p, rng, texts, labels, weights, max(EPOCHS, least)))


def _model(p: dict) -> Model:
    return Model(p["e"], [p[f"k{w}"] for w in WIDTHS], p["b"], p["w"], float(p["o"][0]))


def _learned(p: dict, rng: np.random.Generator, texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int) -> dict:
    """p after so many epochs, changed in place."""
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    lengths = np.array([len(t) for t in texts], int)
    by_length = np.argsort(lengths, kind="stable")
    batches = [by_length[i : i + BATCH] for i in range(0, len(texts), BATCH)]
    step = 0
    for _ in range(epochs):
        for order in rng.permutation(len(batches)):
            rows = batches[order]
            step += 1
            grads, touched = _summed([(len(r) / len(rows), *_gradients(p, _padded([texts[i] for i in r]), labels[r].astype(np.float32), weights[r])) for r in _parts(rows, lengths)])
            grads["w"] = grads["w"] + 1e-4 * p["w"]
            for k, g in grads.items():
                at = touched if k == "e" else slice(None)
                m[k][at] = 0.9 * m[k][at] + 0.1 * g
                s[k][at] = 0.99 * s[k][at] + 0.01 * g * g
                p[k][at] -= RATE * (m[k][at] / (1 - 0.9**step)) / (np.sqrt(s[k][at] / (1 - 0.99**step)) + 1e-6)
            p["e"][0] = 0
    return p


def _summed(parts: list[tuple[float, dict, np.ndarray]]) -> tuple[dict, np.ndarray]:
    """The gradients of a minibatch from those of its parts (share of the rows, gradients, touched buckets)."""
    if len(parts) == 1:
        return parts[0][1:]
    grads = {k: sum(share * g[k] for share, g, _ in parts) for k in parts[0][1] if k != "e"}
    touched, at = np.unique(np.concatenate([t for _, _, t in parts]), return_inverse=True)
    grads["e"] = np.zeros((len(touched), DIM), np.float32)
    np.add.at(grads["e"], at.reshape(-1), np.concatenate([share * g["e"] for share, g, _ in parts]).astype(np.float32))
    return grads, touched


def _gradients(p: dict, ids: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[dict, np.ndarray]:
    rows, n = ids.shape[0], ids.shape[1] - max(WIDTHS) + 1
    who = np.arange(rows)[:, None]
    tops, places = [], []
    x = p["e"][ids[:, :, 0]]
    for part in range(1, PARTS):
        x = x + p["e"][ids[:, :, part]]
    for w in WIDTHS:
        total = sum(x[:, j : j + n] @ p[f"k{w}"][j] for j in range(w))
        at = total.argmax(axis=1)
        places.append(at)
        tops.append(np.take_along_axis(total, at[:, None], axis=1)[:, 0])
    hidden = np.concatenate(tops, axis=1) + p["b"]
    on = hidden > 0
    hidden = np.where(on, hidden, 0)
    d = (_sigmoid(hidden @ p["w"] + p["o"][0]) - y) * weights / rows
    back = d[:, None] * p["w"] * on
    grads = {"w": hidden.T @ d, "o": np.array([d.sum()], np.float32), "b": back.sum(axis=0)}
    used, values = [], []
    for i, w in enumerate(WIDTHS):
        g = back[:, i * FILTERS : (i + 1) * FILTERS]
        k = np.empty_like(p[f"k{w}"])
        for j in range(w):
            under = places[i] + j  # (rows, FILTERS): the word under place j of each filter's best
            k[j] = np.einsum("rfd,rf->df", x[who, under], g)
            used.append(ids[who, under].reshape(-1))
            values.append(np.repeat((g[:, :, None] * p[f"k{w}"][j].T[None]).reshape(-1, DIM), PARTS, axis=0))
        grads[f"k{w}"] = k
    touched, back_at = np.unique(np.concatenate(used), return_inverse=True)
    e = np.zeros((len(touched), DIM), np.float32)
    np.add.at(e, back_at.reshape(-1), np.concatenate(values))
    grads["e"] = e
    return grads, touched


def calibrated(scores: np.ndarray, labels: np.ndarray, langs: list, weights: np.ndarray, rows: np.ndarray | None = None) -> dict[str, float]:
    """Of each language: the lowest threshold, 0.3 at least, that keeps PRECISION among the labelled rows that the weights stand for; infinite, so that nothing is rejected, where none does.

    An entry is one labelled row, or as many as `rows` says. "" stands for all of them, and for languages of few positives; where all of
    them have few and no threshold keeps PRECISION, it is SCORE_AT.
    """

    def lowest(s: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
        order = np.argsort(-s, kind="stable")
        right = np.cumsum((y * w)[order]) / np.cumsum(w[order])
        good = np.flatnonzero((right >= PRECISION) & np.append(s[order][1:] != s[order][:-1], True))
        return max(float(s[order][good[-1]]), 0.3) if len(good) else math.inf

    if not len(scores):
        return {"": SCORE_AT}
    positives = labels if rows is None else labels * rows
    every = lowest(scores, labels, weights)
    out = {"": every if every < math.inf or positives.sum() >= LEAST_ROWS else SCORE_AT}
    tags = np.array([x or "" for x in langs])
    for lang in sorted(set(tags.tolist()) - {""}):
        mine = tags == lang
        if positives[mine].sum() >= LEAST_ROWS:
            out[lang] = lowest(scores[mine], labels[mine], weights[mine])
    return out


def _held_out() -> Column:
    """Whether nothing may be learned from the row; null without doc_id."""
    return F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 1


def _learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the usable labels that may be learned from."""
    return labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~_held_out())


def _labelled(docs: DataFrame, told: DataFrame) -> DataFrame:
    """(doc_id, ids, lang, toxic): the buckets of the words of the documents in told (doc_id, toxic), six bytes a word."""
    has_lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    # Texts of held-out rows, a third of all, are left out before the join moves them.
    rows = docs.where(~_held_out()).select("doc_id", F.col("text").cast("string").alias("text"), has_lang.alias("lang")).join(told, "doc_id")
    # A doc_id that repeats, any number of times, is one row: that of the least text by hash.
    rows = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text"), "text", "lang")).alias("row")).select("doc_id", "row.text", "row.lang", "toxic")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.sliced(batches):
            ids = [b.astype(np.uint16).tobytes() for b in column_buckets(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary()), batch["lang"], batch["toxic"]], names=["doc_id", "ids", "lang", "toxic"])

    return rows.mapInArrow(T.task(words), "doc_id long, ids binary, lang string, toxic int")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A first model, from a bounded sample of the labelled rows whose crc32(doc_id) mod 3 is not 1; part of them calibrate the thresholds.

    What reaches the driver is bounded by 2 * SAMPLE_PER_CLASS rows of whole texts, six bytes a word. A row of a class weighs as many labels as each chosen one of the class
    stands for, so loss and precision are those of the natural mixture of classes. Labels other than 0 and 1, and labels without a document, are left out.
    """
    told = _learnable(labels).withColumn("h", F.xxhash64("doc_id"))
    learnable = dict(told.groupBy("toxic").count().collect())
    stands_for = {y: n / min(n, SAMPLE_PER_CLASS) for y, n in learnable.items()}
    clean, bad = (told.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(SAMPLE_PER_CLASS) for y in (0, 1))
    chosen = clean.unionByName(bad)  # at most 2 * SAMPLE_PER_CLASS ids, a few hundred kB
    found = _labelled(docs, F.broadcast(chosen)).collect()
    found = sorted(found, key=lambda r: (r.doc_id, bytes(r.ids), r.lang or ""))
    ids = [np.frombuffer(bytes(r.ids), np.uint16).reshape(-1, PARTS) for r in found]
    y = np.array([r.toxic for r in found], int)
    weights = np.array([stands_for[r.toxic] for r in found], float)
    # Copies of a text, which have equal ids, all go to the same side.
    rest = np.array([zlib.crc32(i.tobytes()) % CALIBRATES == 0 for i in ids], bool)
    learn, rest = np.flatnonzero(~rest), np.flatnonzero(rest)
    model = train([ids[i] for i in learn], y[learn], weights[learn])
    table = model.projected()
    told = np.concatenate([np.zeros(0), *(scores(model, table, ids[i], np.array([0, len(ids[i])])) for i in rest)])
    model.thresholds = calibrated(told, y[rest], [found[i].lang for i in rest], weights[rest])
    return model


def fit_whole(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all labelled rows whose crc32(doc_id) mod 3 is not 1; those whose ids' crc32 is a multiple of CALIBRATES give the thresholds.

    It is that of fit where this has taken all rows. Otherwise training goes on
    from there: in each round, tasks learn from the current model over each
    part of the rows, and the parts' models are averaged by their rows, summed
    by tasks as integers, so the order of the parts does not count. A row's part
    follows from its doc_id and the number of rows; so many models are made and
    sent, into however many partitions the session deals out rows. Thresholds
    are taken from the counts of all remaining rows by language and bin of the
    score. What reaches the driver are sums of the size of a model, and counts
    by bin of the languages with LEAST_ROWS positive rows and of all together.
    """
    model = fit(docs, labels)
    told = written(_learnable(labels), "learnable")
    if not told.groupBy("toxic").count().where(F.col("count") > SAMPLE_PER_CLASS).count():
        return model
    rows = written(_labelled(docs, told.hint("merge")).withColumn("rest", F.crc32("ids") % CALIBRATES == 0), "labelled")
    n, size = rows.where("not rest").agg(F.count("*"), F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()
    parts = max(-(-n // PART_ROWS), -(-size // PART_BYTES), 1)
    learn = rows.where("not rest").select(F.pmod(F.hash(F.xxhash64("doc_id")), F.lit(parts)).alias("part"), "doc_id", "ids", "toxic")
    learn = learn.repartitionByRange(parts, "part").sortWithinPartitions("part").rdd  # shuffled once for all rounds
    for turn in range(ROUNDS if n else 0):  # labels may have no documents here
        model = _averaged(learn, model, turn)
    rest = rows.where("rest").select("ids", F.coalesce("lang", F.lit("")).alias("lang"), "toxic")
    table, small = model.projected(), Model(np.zeros((0, DIM), np.float32), [], model.bias, model.weight, model.offset)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b, np.uint16).reshape(-1, PARTS) for b in batch["ids"].to_pylist()]
            bins = [min(int(scores(small, table, i, np.array([0, len(i)]))[0] * BINS), BINS - 1) for i in ids]
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(bins, pa.int32()), batch["toxic"]], names=["lang", "bin", "toxic"])

    counts = written(rest.mapInArrow(T.task(binned), "lang string, bin int, toxic int").groupBy("lang", "bin", "toxic").agg(F.count("*").alias("n")), "bins")
    many = counts.where("toxic = 1 and lang != ''").groupBy("lang").agg(F.sum("n").alias("all")).where(F.col("all") >= LEAST_ROWS).select("lang")
    every = counts.groupBy("bin", "toxic").agg(F.sum("n").alias("n")).select(F.lit("").alias("lang"), "bin", "toxic", "n")

    def thresholds(found: list) -> dict[str, float]:
        found = sorted(found)
        y, n = np.array([r.toxic for r in found], int), np.array([r.n for r in found], float)
        return calibrated(np.array([r.bin / BINS for r in found]), y, [r.lang for r in found], n, n)

    own = thresholds(counts.join(many, "lang").select("lang", "bin", "toxic", "n").collect())
    model.thresholds = own | thresholds(every.collect())
    return model


def _averaged(learn: RDD, model: Model, turn: int) -> Model:
    """The mean, by rows, of the models that the parts of learn (part, doc_id, ids, toxic), each in one partition and in one run there, make of the given one in a round."""
    p = {"e": model.embedding, **{f"k{w}": k for w, k in zip(WIDTHS, model.kernels, strict=True)}, "b": model.bias, "w": model.weight, "o": np.array([model.offset], np.float32)}

    def models(rows: Iterator) -> Iterator[tuple[int, np.ndarray]]:
        for _, mine in groupby(rows, lambda r: r.part):
            part = sorted((r.doc_id, bytes(r.ids), r.toxic) for r in mine)
            texts = [np.frombuffer(ids, np.uint16).reshape(-1, PARTS) for _, ids, _ in part]
            epochs = -(-ROUND_STEPS // -(-len(part) // BATCH))
            own = _learned({k: v.copy() for k, v in p.items()}, np.random.default_rng(SEED + 1 + turn), texts, np.array([y for *_, y in part]), np.ones(len(part), np.float32), epochs)
            flat = np.concatenate([own[k].reshape(-1) for k in p]).astype(float)
            yield len(part), np.rint(flat * len(part) * 2.0**UNIT_BITS).astype(np.int64)

    n, units = learn.mapPartitions(models).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]))
    flat, at, out = (units / (n * 2.0**UNIT_BITS)).astype(np.float32), 0, {}
    for k, v in p.items():
        out[k] = flat[at : at + v.size].reshape(v.shape)
        at += v.size
    return _model(out)


def scored(docs: DataFrame, model: Model, score: str = "score", toxic: str = "toxic") -> DataFrame:
    """docs with a score (double, 0 to 1) and whether it is toxic (boolean, by the threshold of the row's lang).

    Columns of docs with the names of these two are replaced.
    """
    docs = docs.drop(score, toxic)
    table, thresholds = model.projected(), model.thresholds
    small = Model(np.zeros((0, DIM), np.float32), [], model.bias, model.weight, model.offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.sliced(batches):
            s = np.concatenate([np.zeros(0), *(scores(small, table, ids, first) for ids, first in _word_chunks(batch["text"]))])
            langs = batch["lang"].to_pylist() if "lang" in batch.schema.names else [None] * batch.num_rows
            at = np.array([thresholds.get(x or "", thresholds[""]) for x in langs])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64()), pa.array(s >= at, pa.bool_())], names=[*batch.schema.names, score, toxic])

    added = [StructField(score, DoubleType()), StructField(toxic, BooleanType())]
    return docs.mapInArrow(T.task(run), StructType([*docs.schema.fields, *added]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id, text; lang picks only thresholds).

    A score depends on the text alone; null and empty texts get the score of a
    text without words. held_out rows are never learned from. Rows that repeat
    a doc_id get a row each; a null doc_id is not held out. Without usable
    labels the scores are those of an untrained model. Other columns are
    ignored.
    """
    model = fit_whole(docs, labels)
    out = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= SCORE_AT).cast("int").alias("predicted"))

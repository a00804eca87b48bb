"""Mixing sources to target weights by iterative proportional fitting.

The corpus is first summed into cells of source, language and topic. The
cells' token weights are scaled to one marginal after the other until all
three meet their targets. A cell's ratio of fitted to actual weight, times a
factor that all cells share, is the probability with which each of its
documents is taken, 1 at most; the factor is such that the sample holds the
asked share of all tokens. So the expected tokens of the sample have the
target marginals as far as the corpus has the tokens for them, the size of the
sample does not hang on the rarest cell, and no document is repeated.

All of it is DataFrame operations. The cells are one row for each combination
that occurs, whatever the number of documents; those of a source are as many
as languages and topics allow, so sources may be any number.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

#: Topics by the first pattern found in a text, in this order; other texts are prose.
TOPICS = (
    ("code", r"(?i)(token|secret|password|api_?key) ?[:=]|[{};]\n|AKIA[A-Z0-9]{8}"),
    ("legal", r"(?i)licen[cs]e|copyright|all rights reserved"),
    ("contact", r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z]|[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}"),
)
#: Targets are the natural shares to these powers: below 1 they lift what is rare.
POWERS = {"source": 0.7, "lang": 0.85, "topic": 0.9}
#: Rounds of the three scalings in one job, how much a factor still moves when they end, and the most rounds.
ROUNDS, TOLERANCE, MOST = 4, 1e-9, 120
#: The share of all tokens that the sample holds, in expectation.
RATE = 0.5
#: Cells up to which the documents get them by broadcast, about 100 bytes each.
FEW_CELLS = 100_000
KEYS = ["source", "lang", "topic"]


def topic(text: Column) -> Column:
    out = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def n_tokens(text: Column) -> Column:
    """Words of a text, 1 at least, so that every document weighs something."""
    return F.greatest(F.regexp_count(text, F.lit("[^ \\t\\n\\r\\f]+")), F.lit(1)).cast("long")


def _over(column: str | Column, by: str) -> Column:
    return F.sum(column).over(Window.partitionBy(by))


def targets(cells: DataFrame, marginal: str, total: float) -> DataFrame:
    """The target share of each value of a marginal: its natural share to the power of POWERS, of their sum."""
    raised = written(cells.groupBy(marginal).agg(F.pow(F.sum("tokens") / F.lit(total), F.lit(POWERS[marginal])).alias("raised")), "raised")
    return raised.select(marginal, (F.col("raised") / F.lit(raised.agg(F.sum("raised")).first()[0])).alias(f"target_{marginal}"))


def _round(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (lang, topic, their targets and factor) after a scaling to each marginal: sources over all cells, then languages and topics over the pairs' sums."""
    weight = F.col("tokens") * F.col("factor")
    scaled = cells.join(pairs, ["lang", "topic"]).withColumn("fitted", weight * F.col("target_source") / _over(weight, "source"))
    same = [F.first(c).alias(c) for c in ("target_lang", "target_topic", "factor", "before")]
    now = scaled.groupBy("lang", "topic").agg(F.sum("fitted").alias("fitted"), *same)
    for m in ("lang", "topic"):
        step = F.col(f"target_{m}") / _over("fitted", m)
        now = now.withColumn("step", step).withColumn("fitted", F.col("fitted") * F.col("step")).withColumn("factor", F.col("factor") * F.col("step"))
    return now.drop("fitted", "step")


def rake(cells: DataFrame) -> DataFrame:
    """cells (source, lang, topic, tokens, documents) with `ratio`, fitted over actual weight, such that the marginals meet their targets.

    A factor of each pair of language and topic goes from round to round;
    sources need none, since theirs follows from it. Targets that cannot be met
    together are met as far as MOST rounds go, with a warning.
    """
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    cells = written(cells.join(targets(cells, "source", total), "source"), "cells")
    pairs = cells.select("lang", "topic").distinct().join(targets(cells, "lang", total), "lang").join(targets(cells, "topic", total), "topic")
    pairs = written(pairs.withColumn("factor", F.lit(1 / total)), "pairs")
    for _ in range(0, MOST, ROUNDS):
        now = pairs.withColumn("before", F.col("factor"))
        for _ in range(ROUNDS - 1):
            now = _round(cells, now)
        # What the last round of a job moves tells whether the rounds may end.
        pairs = written(_round(cells, now.withColumn("before", F.col("factor"))), "pairs")
        moved = pairs.agg(F.max(F.abs(F.col("factor") / F.col("before") - 1))).first()[0] or 0.0
        pairs = pairs.drop("before")
        if moved <= TOLERANCE:
            break
    else:
        warnings.warn(f"after {MOST} rounds a factor still moves by {moved:.3g} of itself (tolerance {TOLERANCE:g}): the targets cannot be met together", stacklevel=2)
    weight = F.col("tokens") * F.col("factor")
    ratio = F.col("factor") * F.col("target_source") / _over(weight, "source") * F.lit(total)
    return cells.join(pairs.select("lang", "topic", "factor"), ["lang", "topic"]).select(*KEYS, "tokens", "documents", ratio.alias("ratio"))


def calibrate(cells: DataFrame, rate: float = RATE) -> DataFrame:
    """A row for each cell: tokens, documents, ratio and probability; the probabilities, 1 at most, take `rate` of all tokens."""
    cells = written(rake(cells), "raked")
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    common, full = rate, -1
    while True:
        # Cells that reach 1 are taken whole, and the others make up for them.
        whole = F.col("ratio") * F.lit(common) >= 1
        n, held, rest = cells.agg(F.count_if(whole), F.sum(F.when(whole, F.col("tokens"))), F.sum(F.when(~whole, F.col("tokens") * F.col("ratio")))).first()
        if n == full or not rest:
            break
        full, common = n, (rate * total - (held or 0)) / rest
    return cells.withColumn("probability", F.least(F.col("ratio") * F.lit(common), F.lit(1.0)))


def uniform(doc_id: Column) -> Column:
    """A number from 0 to 1 that the doc_id alone decides."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _placed(docs: DataFrame, rate: float, text: bool) -> DataFrame:
    """docs with _mix (source, lang, topic, tokens) and _probability. Texts are read once: what they tell is written beside them, or in their place."""
    words = F.coalesce(F.col("text").cast("string"), F.lit(""))
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = docs.withColumn("_mix", F.struct(told("source"), told("lang"), topic(words).alias("topic"), n_tokens(words).alias("tokens")))
    docs = written(docs if text else docs.drop("text"), "weighed")
    cells = docs.select("_mix.*").groupBy(*KEYS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    cells = written(calibrate(written(cells, "summed"), rate).select(F.struct(*KEYS).alias("_cell"), F.col("probability").alias("_probability")), "calibrated")
    small = F.broadcast(cells) if cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS else cells
    return docs.join(small, [F.col(f"_mix.{k}") == F.col(f"_cell.{k}") for k in KEYS]).drop("_cell")


def _sampled() -> Column:
    return uniform(F.col("doc_id")) < F.col("_probability")


def mixed(docs: DataFrame, rate: float = RATE, text: bool = True) -> DataFrame:
    """docs (doc_id, text, source, lang) with topic, tokens, probability and sampled; without text, if so asked.

    A null source or language is the value "" of its marginal; null and empty
    texts are prose of one token. Rows that repeat a doc_id are taken or left
    together where their cells are the same. An empty table gives an empty one.
    Columns of docs with the names topic, tokens, probability, sampled, _mix,
    _cell and _probability are replaced.
    """
    added = {"topic": F.col("_mix.topic"), "tokens": F.col("_mix.tokens"), "probability": F.col("_probability"), "sampled": _sampled()}
    out = _placed(docs.drop(*added, "_mix", "_cell", "_probability"), rate, text)
    return out.withColumns(added).drop("_mix", "_probability")


def sample(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """The sampled rows of docs, with docs' own columns; those with the names _mix, _cell and _probability are not kept."""
    docs = docs.drop("_mix", "_cell", "_probability")
    return _placed(docs, rate, True).where(_sampled()).select(*docs.columns)

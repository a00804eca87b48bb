"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Counted as part of placeworks.llm. Each stage works on every document that the
one before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from placeworks.llm import decontaminate, mixing, near_dedup, tokens, toxicity
from placeworks.llm.queries import table, tokenizer_path
from placeworks.llm.scratch import bounded, written


@bounded
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, by the threshold of their language."""
    model = toxicity.fit_whole(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model, "_toxic_score", "_is_toxic").where("not _is_toxic").select(*docs.columns)


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    groups = near_dedup.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct()
    out = docs.join(groups, "doc_id", "left_anti").select(*docs.columns)
    # A doc_id that repeats is one node of the groups: of its equal texts one stays.
    repeated = written(docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id"), "repeated")
    copies = out.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return out.join(repeated, "doc_id", "left_anti").unionByName(copies.select(*docs.columns))


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@bounded
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample whose expected token weights have the target marginals."""
    return mixing.sample(docs)


@bounded
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document in the token files: doc_id, start, n_tokens, ids_crc32."""
    return tokens.token_output(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

#: The classifier's scores, and so everything after them, have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

"""The pipeline: every stage's decisions against plain code on its own input."""

import zlib

import corpus_pipeline
import numpy as np
import plain
from placeworks.llm import mixing, queries, toxicity
from tokenizers import Tokenizer


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        given = docs.collect()
        texts, before = [(r.doc_id, r.text) for r in given], {r.doc_id: r for r in given}
        assert len(before) == len(given)
        if name == "token_output":
            start = 0
            for r in sorted(out.collect(), key=lambda r: r.doc_id):
                ids = np.array([*tokenizer.encode(before.pop(r.doc_id).text or "", add_special_tokens=False).ids, 0], "<u4")
                assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
                start += len(ids)
            assert not before
            continue
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in out.collect()}
        assert out.count() == len(after) and all(before[d] == r for d, r in after.items())
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
            for r in given:
                over = plain.toxic_score(model, r.text) - model.thresholds.get(r.lang or "", model.thresholds[""])
                assert abs(over) < 1e-4 or (over < 0) == (r.doc_id in after)
        elif name == "near_dedup":
            assert set(after) == plain.kept_of_near_duplicates(texts, 5, 80)
        elif name == "decontamination":
            assert set(after) == plain.clean_of(texts, [r.text for r in bench.collect()])
        elif name == "mixing":
            assert set(after) == plain.sampled([(r.doc_id, r.text, r.source, r.lang) for r in given], mixing.RATE)
        docs = out


def test_odd_rows(spark, sf_dir, tmp_path):
    """Nulls, empty texts, repeated rows, clashing columns and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, topic string, toxic int, score double"
    rows = [(None, None, None, None, None, "t", 1, 0.0), (1, "", "en", "a", 0, "t", 1, 0.0), (2, "some words here", None, None, 3, None, None, None), (2, "some words here", None, None, 3, None, None, None), (2, "other words for the same id", "en", "b", 1, "t", 0, 0.0)]
    for at, given in (("some", rows), ("none", [])):
        docs = spark.createDataFrame(given, schema)
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{at}{k}")
            stage(spark, docs, sf_dir).write.parquet(path)
            if name != "token_output":
                docs = spark.read.schema(schema).parquet(path)
                assert docs.columns == [c.split()[0] for c in schema.split(", ")]
                if name == "near_dedup" and given:
                    assert docs.count() == 4


def test_decontamination_goes_by_row(spark, sf_dir):
    """A contaminated row without an id goes, a clean row with the id of a contaminated one stays."""
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("text is not null and length(text) > 100").first().text
    rows = [(None, leak), (None, "clean words"), (1, leak), (1, "other clean words"), (1, "other clean words")]
    out = corpus_pipeline.drop_contaminated(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf_dir).collect()
    assert sorted(map(tuple, out), key=str) == sorted((r for r in rows if r[1] != leak), key=str)

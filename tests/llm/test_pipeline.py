"""The pipeline next to plain versions of its stages, on the smallest tables."""

import corpus_pipeline
from tests.conftest import SMALL
from tests.llm.test_near_dup import _brute
from tests.llm.test_tokens import _check_packing
from turnloom.llm import quality, registry, toxicity


def test_against_plain_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = {r.doc_id for r in quality.score(docs, registry.quality_model(spark, SMALL)).collect() if r.kept}
    clean = {r.doc_id for r in toxicity.score(docs, registry.toxicity_machine(spark, SMALL)).collect() if not r.predicted}
    text = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: t for i, t in text.items() if i in good and i in clean}
    kept = {i: kept[i] for i, (_, _, first) in _brute(list(kept.items()), 80).items() if first}
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = {i: t for i, t in kept.items() if not any(item in " ".join(t.lower().split()) for item in items)}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(kept)
    _check_packing(rows, list(kept.items()), 1024)


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "toxicity", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert 0 < docs.count() <= 30


ODD = "doc_id long, text string, lang string, source string, n_chars long, kept_id long, own_id string, component long"


def test_stages_on_odd_rows(spark):
    """Nulls in every column, repeated rows, one id with several texts, columns with clashing names; and an empty table."""
    prose = " ".join(f"word{k}" for k in range(40))
    rows = [(1, prose, "en", "s"), (1, prose, "en", "s"), (1, "quite another text of the same id", None, None), (2, prose, "en", "s"), (None, prose, None, None), (None, None, None, None), (3, "", "en", "s"), (3, None, "en", "s")]
    docs = spark.createDataFrame([(i, t, lang, source, None, 7, None, 1) for i, t, lang, source in rows], ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL)
        assert kept.columns == docs.columns and kept.count() <= docs.count()
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    left = corpus_pipeline.near_dedup_stage(spark, docs, SMALL).collect()
    assert sorted(((r.doc_id or 0), r.text or "") for r in left) == sorted([(1, prose), (1, "quite another text of the same id"), (0, prose), (0, ""), (3, ""), (3, "")])
    pieces = corpus_pipeline.packing_stage(spark, docs, SMALL).collect()
    assert len(pieces) == len(rows)
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), SMALL).count() == 0

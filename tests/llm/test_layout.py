"""Tables of odd texts written one row a file, and tables whose layout must not change a result."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.conftest import ODD_TEXTS
from turnloom.llm import decontaminate, language_model, media, near_dup, packing, registry, substring_dedup, token_counts
from turnloom.llm.storage import new_path


@pytest.fixture()
def one_a_file(spark, make):
    """ODD_TEXTS, a file for each row."""
    path = new_path(spark, "odd")
    for row in ODD_TEXTS:
        make([row]).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path)


TOKENIZER = public_tokenizers.path(registry.TOKENIZER)


@pytest.mark.parametrize(
    "operator",
    [
        lambda docs: token_counts.token_counts(docs, TOKENIZER),
        lambda docs: packing.best_fit_packing(docs, TOKENIZER).where("piece = 0"),
        media.media_columns,
        near_dup.near_duplicates,
        language_model.score,
        lambda docs: substring_dedup.digests(substring_dedup.substring_dedup(docs)),
    ],
    ids=["op2", "op3", "op6", "op7", "op9", "op11"],
)
def test_one_row_a_file(spark, one_a_file, operator):
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        assert one_a_file.rdd.getNumPartitions() == len(ODD_TEXTS)
        assert {r.doc_id for r in operator(one_a_file).collect()} == {i for i, _ in ODD_TEXTS}
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_decontamination_one_row_a_file(spark, one_a_file):
    benchmark = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.keep_unmatched(one_a_file, benchmark).count() == len(ODD_TEXTS)


def test_lm_score_without_frequent_words(make):
    """All words are as frequent, and more than the head holds; counts are exact all the same."""
    rows = [(k, f"alpha{k} beta{k} gamma{k}") for k in range(1, 21)]
    got = language_model.score(make(rows), head_words=10).collect()
    assert len(got) == 20
    for r in got:
        assert r.n_tokens == 4 and r.n_known == (1 if r.held_out else 4)


def test_lm_score_of_any_layout(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    one, seven = ({r.doc_id: r.score for r in language_model.score(d).collect()} for d in (docs.coalesce(1), docs.repartition(7, F.xxhash64("text"))))
    assert seven == pytest.approx(one, rel=1e-4)

"""Physical plans: native expressions, pushed filters, pruned columns, no global window or product."""

import pytest

import __spark_entry__ as entry
from textguard.catalog import base as B
from textguard.operators import quality

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# these run Arrow functions by design
PYTHON = {
    "cooccurrence", "token_vector_lookup", "lockout", "word2vec_docs", "predict_word2vec", "tree_shap", "cached_embedding", "embed_batch",
}
NATIVE = sorted(set(ORACLES) - PYTHON)


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_products(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for bad in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in text, bad


def test_filters_and_columns_reach_the_scan(spark, sf):
    docs = B.table(spark, sf, "documents").where("lang = 'en'")
    text = plan(quality.duplicate_report(docs))
    assert "EqualTo(lang,en)" in text and "n_chars" not in text


def test_splitting_does_not_move_the_corpus(spark, sf):
    """Texts are compared with the cut value in place: no exchange carries them."""
    from textguard.operators.sampling import train_test_split

    docs = B.table(spark, sf, "documents").select("doc_id", "text")
    text = plan(train_test_split(docs, 0.2))
    exchanges = [block for block in text.split("\n\n") if "Exchange" in block.splitlines()[0]]
    assert exchanges and not any("text#" in block for block in exchanges)


def test_dedup_groups_by_digest_without_a_window(spark, sf):
    text = plan(quality.dedup_keep_first(B.table(spark, sf, "documents")))
    assert "Window" not in text and "partial_min(doc_id" in text
    exchanges = [block for block in text.split("\n\n") if block.split(") ")[-1].startswith("Exchange")]
    assert not any("text#" in block for block in exchanges)


def test_text_stays_out_of_the_vocabulary_shuffle(spark, sf):
    from textguard.functions.text import tokenize
    from textguard.operators.vectorize import vocabulary

    docs = B.table(spark, sf, "documents").select(tokenize("text").alias("tok"))
    text = plan(vocabulary(docs, "tok", max_features=10))
    assert "TakeOrderedAndProject" in text and "partial_sum" in text


def test_bigrams_are_exchanged_once(spark, sf):
    """Bigrams are counted by document where the document is; only the counts by bigram are exchanged."""
    text = plan(QUERIES["bigrams"](spark, sf))
    exchanges = [block for block in text.split("\n\n") if ") Exchange" in block.strip().split("\n")[0]]
    assert sum("gram#" in block for block in exchanges) == 1

"""Lexical search: equality with its SQL on odd rows and random corpora, terms against a regular expression."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from compare import differences
from textguard.llm import lexical_search as ls

DOCS = "doc_id long, text string, lang string, score double, term long, owner int, w long"
ITEMS = "item_id string, text string, doc_id long, rank int, uid long"
ROWS = [
    (1, "the Quick brown fox"), (2, None), (3, ""), (4, " .,! "), (None, "quick quick fox"), (None, "quick quick fox"), (5, "the the the"),
    (6, "ÉTÉ été straße_x"), (6, "ÉTÉ été straße_x"), (7, "zeta " * 60_000 + "omega"), (8, "a" * 700_000 + " fox"), (9, "été fox"),
]
ASKED = [("a", "the quick fox"), ("a", "the quick fox"), (None, "zeta omega"), ("b", None), ("c", " ."), ("d", "été ÉTÉ x " + "a" * 700_000), ("e", "absent")]


def oracle(docs, items):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.sql("CREATE TABLE benchmark (item_id VARCHAR, text VARCHAR)")
    for name, rows in (("documents", docs), ("benchmark", items)):
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES (?, ?)", [list(r) for r in rows])
    return con


def frames(spark, docs, items, parts=3):
    return (
        spark.createDataFrame([(i, t, "en", 0.5, 1, 2, 3) for i, t in docs], DOCS).repartition(parts),
        spark.createDataFrame([(i, t, 9, 9, 9) for i, t in items], ITEMS),
    )


@pytest.mark.parametrize("docs,items", [(ROWS, ASKED), ([], ASKED), (ROWS, []), ([(1, None)], [("a", "x")])])
def test_odd_rows_equal_sql(spark, docs, items):
    _, _, problems = differences(ls.query(*frames(spark, docs, items)), oracle(docs, items), ls.SQL)
    assert not problems


def test_random_corpus_equals_sql(spark):
    """Frequent and rare terms, many ties, more than ten documents in each shard: bundles are pruned on the way."""
    rng = random.Random(3)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 3000}"
    docs = [(k % 1900, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(2000)]
    items = [(f"i{k % 25}", " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(30)]
    docs += [(5000 + k, items[k][1]) for k in range(5)] * 4
    rows, _, problems = differences(ls.query(*frames(spark, docs, items)), oracle(docs, items), ls.SQL)
    assert not problems and rows > 250


def test_terms_equal_the_pattern():
    rng = np.random.default_rng(2)
    letters = list("aZ09_ -.éß \U0001f600\x7f\x1f")
    texts = ["".join(rng.choice(letters, rng.integers(0, 300))) for _ in range(200)] + ["b" * 500]
    want = [re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t.replace("Z", "z")) for t in texts]
    for chunk in (16, 1000, 1 << 18):
        owner, code = ls.codes_of_texts(list(pa.array(texts).cast(pa.large_binary())), chunk)
        names = {}
        for k, terms in enumerate(want):
            got = code[owner == k]
            assert len(got) == len(terms)
            for c, t in zip(got, terms):
                assert names.setdefault(int(c), t) == t
        assert len(names) == len({t for terms in want for t in terms})

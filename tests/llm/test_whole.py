"""No cut below the whole job: what a bounded table or sample leaves out still counts."""

import numpy as np
from pyspark.sql import functions as F

from freshet.llm import cotrain, suffix_tree

SF = "/root/testdata/sf0.001"


def test_suffix_tree_states_beyond_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.col("doc_id") % 7 == 2
    whole, cut, none = (
        {(r["doc_id"], r["n_tokens"]): r["score"] for r in suffix_tree.score_texts(docs, held, max_states=m).collect()} for m in (1 << 30, 40, 0)
    )
    assert len(whole) > 100 and whole.keys() == cut.keys() == none.keys()
    for other in (cut, none):
        assert np.allclose([whole[k] for k in whole], [other[k] for k in whole], rtol=1e-9, atol=1e-9)


def test_quality_exchanges_all_unlabelled_rows(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(("w" if i % 2 else "7") * int(n) for n in rng.integers(2, 9, 30)) for i in range(15_000)]  # both views tell the classes
    rows = spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    pool = cotrain.Pool(cotrain.feature_rows(rows), 5, 0.9)
    assert pool.size == 15_000
    labelled = cotrain.feature_rows(rows.where("doc_id < 200")).withColumns({"y": (F.col("doc_id") % 2).cast("int"), "hold": F.floor(F.col("doc_id") / 2) % 5 == 0})
    cotrain.co_train(labelled, pool, rounds=2, grow=0.2)
    # two rounds and views, a fifth of all rows each, in whole places; a sample of 12,000 rows has no more than 9,600
    assert 11_000 < sum(t.count() for t in pool.taken) <= 15_000
    y = np.concatenate([np.array(t.select("y").collect()).ravel() for t in pool.taken])
    assert 0.4 < y.mean() < 0.6


def test_quality_of_few_labels(spark):
    rows = spark.createDataFrame([(i, "good words in a line" if i % 2 else "77 88 || 99", "en", "s", 9) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, quality int")
    got = {r["doc_id"]: r["accepted"] for r in cotrain.with_quality(rows, cotrain.fit_quality(rows, labels)).collect()}
    assert all(got[i] == (i % 2 == 1) for i in range(40))

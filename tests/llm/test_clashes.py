"""Columns beside those that an operator reads, named like those it makes on the way, change nothing."""

import pytest
from pyspark.sql import functions as F

from freshet.llm import cotrain, decontam, exact_dedup, merkle, mixing, negatives, ngram_join, pii, secrets, simhash, suffix_tree, tokenbin

SF = "/root/testdata/sf0.001"
NAMES = """a accepted assign at base before bits block candidates clash component_id containment content_prob ctx digest domain draw email end epoch fp found gain group group_size
hash held_out hex hit item_id keep_id kept key kind known label leaf left level likely low n n_shingles n_tokens node nodes now part path place pos postings root row rows score
shard short size spans start state steps taken tile tokens top total total_tokens turn uid unit v w word words""".split()


def table(spark, name, clash):
    df = spark.read.parquet(f"{SF}/{name}.parquet")
    return df.withColumns({n: F.lit(f"clash {n}") for n in NAMES if n not in df.columns}) if clash else df


OPERATORS = {
    "op1": lambda s, t: ngram_join.jaccard_components(t("documents")),
    "op2": lambda s, t: suffix_tree.score_texts(t("documents"), F.col("doc_id") % 7 == 2).withColumns({c: F.round(c, 6) for c in ("base_score", "score")}),
    "op4": lambda s, t: mixing.mix(t("documents"), 1, 2, 3),
    "op5": lambda s, t: cotrain.with_quality(t("documents"), cotrain.fit_quality(t("documents"), t("labels"))).select("doc_id", "accepted"),
    "op6": lambda s, t: exact_dedup.exact_dedup(t("documents")),
    "op7": lambda s, t: tokenbin.token_output(t("documents")),
    "op8": lambda s, t: secrets.scan_secrets(t("documents")),
    "op9": lambda s, t: pii.find_personal_data(t("documents")),
    "op10": lambda s, t: decontam.drop_contaminated(t("documents"), t("benchmark")).select("doc_id", "text"),
    "op11": lambda s, t: negatives.hard_negatives(t("embeddings"), F.col("vec_id") % 100 == 0, label=F.col("label")),
    "op12": lambda s, t: merkle.verified(merkle.manifest(t("documents"), ["doc_id", "text"], "lang", "doc_id")),
    "op13": lambda s, t: simhash.near_components(t("documents")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    plain, clashing = (OPERATORS[name](spark, lambda t, c=c: table(spark, t, c)) for c in (False, True))
    assert clashing.columns == plain.columns
    assert sorted(map(repr, clashing.collect())) == sorted(map(repr, plain.collect())) != []

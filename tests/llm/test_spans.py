"""Spans of many matches: against Python's matches, and in proportion to their number."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from freshet.llm import pii, secrets
from freshet.llm.spans import clear_of, find_spans


def brute(pattern, text):
    last = 0
    for m in re.finditer(pattern, text or ""):
        yield m.start(), m.end(), m.group(), text[last : m.start()][-24:]
        last = m.end()


@pytest.mark.parametrize("pattern", ["[a-b]+", "1", "é|😀+"])
def test_spans_equal_matches(spark, pattern):
    rng = random.Random(1)
    texts = ["", "abc", None, *("".join(rng.choice("ab1é😀 ") for _ in range(rng.randrange(400))) for _ in range(200)), *("a1 " * n for n in (63, 64, 65, 4095, 4096, 4097))]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = frame.select("i", find_spans(F.col("t"), pattern).alias("s"))
    for r in got.collect():
        assert [tuple(s) for s in r["s"]] == list(brute(pattern, texts[r["i"]]))


def test_clear_spans_equal_a_search(spark):
    rng = random.Random(2)
    made = lambda n: [(a, a + rng.randrange(1, 30)) for a in (rng.randrange(3000) for _ in range(n))]
    rows = [(k, made(n), made(m)) for k, (n, m) in enumerate([(0, 0), (5, 0), (0, 5), (60, 1), (300, 150), (50, 70), (200, 4200)])]
    span = "array<struct<start:long,end:long>>"
    frame = spark.createDataFrame(rows, f"k int, x {span}, y {span}")
    for r in frame.select("k", clear_of(F.col("x"), F.col("y")).alias("c")).collect():
        _, x, y = rows[r["k"]]
        assert [tuple(s) for s in r["c"]] == [s for s in x if all(b <= s[0] or s[1] <= a for a, b in y)]


def test_many_spans_cost_in_proportion(spark):
    def took(n):
        texts = [" ".join(f"10.0.{i % 250}.{i % 199}" for i in range(n)), " ".join(f"deadbeef{i:08x} 555-123-{i % 9000 + 1000}" for i in range(n // 2))]
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()
        rows.count()
        began = time.time()
        found = {r["doc_id"]: r["n"] for r in pii.find_personal_data(rows).select("doc_id", F.size(F.filter("spans", lambda s: s["base"])).alias("n")).collect()}
        keys = {r["doc_id"]: r["n"] for r in secrets.scan_secrets(rows).select("doc_id", F.size("hex").alias("n")).collect()}
        assert found[0] == n and keys == {0: 0, 1: n // 2}
        return time.time() - began

    took(1000)
    small, large = took(50_000), took(200_000)
    assert large < 4 * 2.2 * small and large < 60

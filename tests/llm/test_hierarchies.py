"""Hard negatives, the Merkle manifest and the SimHash join: brute force, odd and empty input, many shapes."""

import hashlib
import itertools
import math
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from freshet.llm import merkle, negatives, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, pos int, n int, top string, steps string, root string, fp long, label int, low int"
LONG = " ".join(f"w{i % 97} x{i}" for i in range(400_000))


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(f"word{i}" for i in range(300))
    texts = [None, "", " \t\n", "one two", "One  TWO", "one two three", base, base + " more", base.replace("word30 ", "zap "), LONG, LONG + " end", "héllo wörld 😀", "x" * 3_000_000]
    rows = [(i, t, ("en", None, "é")[i % 3], f"src{i % 2}" if i % 5 else None, None if i % 4 == 0 else 10) for i, t in enumerate(texts)]
    rows += [(None, "one two", None, None, 2**63 - 1), (3, "one two", "en", "src0", 3), (3, "one two", "en", "src0", 3), (-7, "seven", "lonely", "", 0)]
    return spark.createDataFrame([(*r, "n", 1, 2, "t", "s", "r", 5, 6, 7) for r in rows], DOCS).repartition(3)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_manifest(rows, fanout=2):
    """Rows of (doc_id, source, lang, n_chars, text) to sorted result rows."""

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([h(*now[k : k + fanout]) for k in range(0, len(now), fanout)])
        return levels

    def siblings(levels, at):
        for level in levels[:-1]:
            first = at // fanout * fanout
            yield level[first:at], level[at + 1 : first + fanout]
            at //= fanout

    leaf = lambda r: h(*map(framed, r))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    for own in langs.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {x: grow([leaf(r) for r in langs[x]]) for x in names}
    top = grow([trees[x][-1][0] for x in names])
    for k, x in enumerate(names):
        for i, r in enumerate(langs[x]):
            steps = [*siblings(trees[x], i), *siblings(top, k)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            found = leaf((*r[:3], r[3] + 1, r[4])) if hit else leaf(r)
            for before, after in steps:
                found = h(*before, found, *after)
            yield r[0], leaf(r), trees[x][-1][0], top[-1][0], h(*(s for b, a in steps for s in b + a)), found, found == top[-1][0]


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def manifest(df, **more):
    marked = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    plus = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    got = merkle.verified(merkle.manifest(df, COLUMNS, "lang", "doc_id", {"n_chars": plus}, marked, **more))
    return got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()


@pytest.mark.parametrize(("fanout", "levels"), [(2, 10), (2, 2), (3, 2), (5, 1)])
def test_manifest_equals_trees_by_hand(spark, docs, fanout, levels):
    more = spark.range(57).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") < 40, "en").alias("lang"), F.lit("s").alias("source"), F.col("id").alias("n_chars"))
    df = docs.select(COLUMNS).unionByName(more)
    want = list(brute_manifest([tuple(r) for r in df.collect()], fanout))
    assert sorted(map(repr, map(tuple, manifest(df, fanout=fanout, levels=levels)))) == sorted(map(repr, want))
    assert {w[-1] for w in want} == {True, False}


def test_manifest_ignores_clashing_columns(docs):
    assert sorted(map(repr, manifest(docs))) == sorted(map(repr, manifest(docs.select(COLUMNS))))


def test_manifest_of_one_row_and_of_none(spark, docs):
    (row,) = manifest(docs.where("lang = 'lonely'"))
    assert row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == h()
    assert manifest(spark.createDataFrame([], docs.schema)) == []


def test_a_group_of_equal_rows_is_split(spark):
    same = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    got = manifest(same, levels=6)
    want = list(brute_manifest([(None, "s", "en", 1, "t")] * 3000))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = min(4, len(w))
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def brute_classes(prints, budget=4):
    label = list(range(len(prints)))
    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= budget and label[a] != label[b]:
            old, new = max(label[a], label[b]), min(label[a], label[b])
            label = [new if x == old else x for x in label]
    return label


def test_fingerprints_of_odd_texts(docs):
    got = simhash.near_components(docs).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert len(got) == 17
    for r in got:
        if r["doc_id"] not in (9, 10):
            assert r["fp"] & (2**64 - 1) == brute_print(texts[r["doc_id"]])
    assert {r["component_id"] for r in got if r["doc_id"] in (0, 1, 2)} == {0}
    assert {r["component_id"] for r in got if r["doc_id"] in (None, 3, 4)} == {3}
    assert {r["component_id"] for r in got if r["doc_id"] in (9, 10)} == {9}


def test_long_texts_are_read_in_pieces(monkeypatch):
    text = " ".join(f"w{i * i % 101}" for i in range(500))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PIECE", 7)
    assert simhash.fingerprint(text) == whole == brute_print(text)


def test_without_ids_a_component_has_none(spark):
    got = simhash.near_components(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")).collect()
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(None, None)] * 2
    assert simhash.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def clustered(rng, centres=60, spread=6, n=25):
    out = [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)]
    for c in rng.integers(0, 2**64, centres, dtype=np.uint64):
        for _ in range(int(rng.integers(1, n))):
            out.append(int(c) ^ sum(1 << int(b) for b in set(rng.integers(0, 64, int(rng.integers(1, spread))).tolist())))
    return sorted(set(out))


@pytest.mark.parametrize("most", [300, 1 << 18])
def test_trie_finds_every_link(most):
    rng = np.random.default_rng(most)
    prints = clustered(rng)
    label = list(range(len(prints)))
    for turn in (0, 1):
        keys = simhash._turned(np.array(prints, np.uint64), turn)
        order = np.argsort(keys)
        keys, cut = keys[order], len(prints) // 3
        for a, b in (((0, cut), (0, cut)), ((cut, None), (cut, None)), ((0, cut), (cut, None))):
            x, i = keys[slice(*a)], order[slice(*a)]
            y, i = (x, i) if a == b else (keys[slice(*b)], np.concatenate([i, order[slice(*b)]]))
            for p, q in simhash.linked(x, y, 4, most):
                one, other = label[i[p]], label[i[q]]
                label = [min(one, other) if v in (one, other) else v for v in label]
    assert label == brute_classes(prints)


@pytest.mark.parametrize("cap", [8, 16_384])
def test_trie_of_cells_finds_every_link(spark, monkeypatch, cap):
    """A cap of eight splits the dense part of the trie far below the rest."""
    dense = [0x1234_5678_9ABC_DEF0 ^ (a << 3) ^ (b << 40) for a in range(20) for b in (0, 1, 2, 5)]
    prints = sorted({*clustered(np.random.default_rng(7), 12, 6, 8), *dense, 0})
    rows = spark.createDataFrame([(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, n, seed: docs)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_components(rows, cap=cap).collect()}
    assert [got[i] for i in range(len(prints))] == brute_classes(prints)


VECTORS = "vec_id long, label int, embedding array<float>, uid long, place long, tile long, nth long, window int, score long"


def brute_negatives(rows, positives=5, negatives=10):
    kept = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, label, [math.floor(256 * x) for x in v]))
    last = lambda r: (r[1] is None, r[1] or 0)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for k, (i, label, v) in enumerate(kept):
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, m == label) for n, (j, m, w) in enumerate(kept) if n != k]
        scored.sort(key=lambda r: (-r[0], *last(r)))
        for ps, p, _ in [r for r in scored if r[2]][:positives]:
            inside = [r for r in scored if not r[2] and 30 * ps <= 100 * r[0] <= 90 * ps]
            yield from ((i, p, n, j, ps, s) for n, (s, j, _) in enumerate(inside[:negatives], 1))


def mined(df, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label=label, **more)


@pytest.mark.parametrize("shape", [{}, {"block": 16, "tile": 4, "slab": 3, "lane": 2}])
def test_negatives_equal_brute_force(spark, shape):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 6))
    rows = [(i, int(i % 12 % 10), (centres[i % 12] + rng.normal(size=6) * 0.4).astype(np.float32).tolist()) for i in range(900)]
    rows += [(900, None, [1.0] * 6), (1000, 3, None), (1001, 3, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, 3, [float("nan")] * 6), (1100, 3, [float("inf")] * 6)]
    rows += [(None, 4, rows[4][2]), (200, 5, rows[17][2]), (200, 5, rows[17][2]), (1200, 5, rows[200][2][:3]), (1300, 2, [])]
    rows += [(2000 + i, i % 3, rows[100][2]) for i in range(40)]  # ties
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, 6) for r in rows], VECTORS).repartition(5)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in mined(df, **shape).select(names).collect()]
    want = list(brute_negatives(rows))
    assert len(want) > 300 and sorted(map(repr, got)) == sorted(map(repr, want))


def test_negatives_of_large_numbers_and_of_none(spark):
    rng = np.random.default_rng(2)
    big = [(i, i % 2, (rng.normal(size=4) * 2.0**18).tolist()) for i in range(0, 400, 20)]
    df = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    got = sorted(tuple(r) for r in mined(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    assert got == sorted(brute_negatives(big)) and got
    assert mined(df.where("false")).count() == 0
    assert mined(df.select("vec_id", "label", F.array().cast("array<double>").alias("embedding"))).where("positive_score <> 0 or negative_score <> 0").count() == 0


def test_bounds_hold_all_products_and_skip_blocks():
    rng = np.random.default_rng(3)
    a = rng.integers(-50, 50, (30, 5))
    boxes = [rng.integers(-40, 40, 5) + rng.integers(0, 6, (20, 5)) for _ in range(12)]
    low, high = (np.stack([f(b, axis=0) for b in boxes]) for f in (np.min, np.max))
    for x_low, x_high in ((a, a), (a.min(0)[None], a.max(0)[None])):
        least, most = negatives.bounds(x_low, x_high, low, high)
        for k, b in enumerate(boxes):
            s = a @ b.T
            assert (least[:, k] <= (s.min(1) if x_low is a else s.min())).all() and (most[:, k] >= (s.max(1) if x_low is a else s.max())).all()


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (5, 2)])
def test_hilbert_order_steps_to_neighbours(dims, bits):
    points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = negatives.hilbert_keys(points, bits)
    order = sorted(range(len(points)), key=keys.__getitem__)
    assert len(set(keys)) == len(points) and (np.abs(np.diff(points[order], axis=0)).sum(1) == 1).all()

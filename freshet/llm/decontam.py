"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so symmetric MinHash similarity is
useless; what counts is containment ``|item & doc| / |item|``. Items are put in
partitions by shingle count (powers of two). A partition whose largest item has
``n`` shingles sketches each item by its ``m`` smallest shingle hashes, its
MinHash values, with ``m = n - ceil(t * n) + 1``. A document that contains a
share ``t`` of an item holds at least one of any ``m`` of its shingles, so
probing a document's shingles against the sketches misses nothing. Candidates
are verified by exact shingle containment while the document is at hand.

The item table is a stated query set. It is broadcast in blocks of at most
``block_hashes`` shingles, whose size is checked as they are formed, and each
block meets all rows; more items mean more passes, not a larger broadcast.

Defined results: an item or text without words, or null, matches nothing. An
item of fewer than five words is its whole word sequence, found anywhere in a
text. Very long texts are searched whole. Repeated items and rows each give their
own result rows, so there are no ties; a null id is carried through. Empty tables give an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import ngram_hashes, word_hashes, words_of

SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def item_shingles(text: str | None, n: int) -> tuple[int, np.ndarray]:
    h = word_hashes(words_of(text))
    size = min(n, len(h))
    return size, np.unique(ngram_hashes(h, size)) if size else np.empty(0, np.uint64)


def sketch_sizes(counts: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sketch size for each item, one for each partition by powers of two."""
    part = np.floor(np.log2(counts)).astype(int)
    largest = {p: counts[part == p].max() for p in np.unique(part)}
    return np.array([n - -(-num * n // den) + 1 for n in (largest[p] for p in part)])


class Index:
    """Sketches and whole shingle sets of one block of items, as flat sorted arrays."""

    def __init__(self, ids: list, sets: list[tuple[int, np.ndarray]], num: int, den: int):
        self.ids, self.sets, self.num, self.den = ids, [s for _, s in sets], num, den
        self.lengths = sorted({k for k, _ in sets})
        sizes = sketch_sizes(np.array([len(s) for s in self.sets]), num, den)
        keys = [s[:m] for s, m in zip(self.sets, sizes, strict=True)]
        flat = np.concatenate(keys)
        owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.uniq = np.unique(self.flat)
        #: one bit for each of 2^22 hash prefixes: most shingles stop here
        self.gate = np.zeros(1 << 22, bool)
        self.gate[self.uniq >> np.uint64(42)] = True

    def matches(self, word_hash: np.ndarray):
        shingles = [ngram_hashes(word_hash, k) for k in self.lengths if k <= len(word_hash)]
        if not shingles:
            return
        every = np.concatenate(shingles)
        near = every[self.gate[every >> np.uint64(42)]]
        near = near[self.uniq[np.minimum(np.searchsorted(self.uniq, near), len(self.uniq) - 1)] == near] if len(near) else near
        if not len(near):
            return
        near = np.unique(near)
        lo, hi = np.searchsorted(self.flat, near), np.searchsorted(self.flat, near, "right")
        every = np.unique(every)
        for i in np.unique(np.concatenate([self.owner[a:b] for a, b in zip(lo, hi, strict=True)])):
            own = self.sets[i]
            at = np.minimum(np.searchsorted(every, own), len(every) - 1)
            shared = int((every[at] == own).sum())
            if self.den * shared >= self.num * len(own):
                yield self.ids[i], len(own), shared


def item_blocks(items, n: int, num: int, den: int, block_hashes: int):
    """Indexes over runs of items with at most ``block_hashes`` shingles (one item at least)."""
    ids, sets, held = [], [], 0
    for row in items:
        size, s = item_shingles(row["text"], n)
        if not size:
            continue
        if ids and held + len(s) > block_hashes:
            yield Index(ids, sets, num, den)
            ids, sets, held = [], [], 0
        ids.append(row["item_id"])
        sets.append((size, s))
        held += len(s)
    if ids:
        yield Index(ids, sets, num, den)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    num: int = 3,
    den: int = 4,
    shingle: int = 5,
    block_hashes: int = 2_000_000,
) -> DataFrame:
    """Pairs of document and item with containment of ``num / den`` or more (0.75)."""
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    query_set = items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()
    out = []
    for index in item_blocks(query_set, shingle, num, den, block_hashes):
        shared = spark.sparkContext.broadcast(index)

        def probe(batches, shared=shared):
            index = shared.value
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    words = words_of(text.as_py())
                    for item_id, n_item, n_shared in index.matches(word_hashes(words)):
                        found.append((doc_id, item_id, n_item, n_shared, n_shared / n_item))
                if found:
                    names = ["doc_id", "item_id", "n_item", "n_shared", "containment"]
                    types = [pa.int64()] * 4 + [pa.float64()]
                    cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, names=names)

        out.append(rows.mapInArrow(probe, SCHEMA))
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], SCHEMA)


def drop_contaminated(
    docs: DataFrame, items: DataFrame, num: int = 3, den: int = 4, shingle: int = 5, block_hashes: int = 2_000_000
) -> DataFrame:
    """The rows of ``docs`` that contain ``num / den`` of no item."""
    import pyarrow as pa

    query_set = items.select(F.col("item_id").cast("long").alias("item_id"), "text").toLocalIterator()
    place = docs.columns.index("text")
    for index in item_blocks(query_set, shingle, num, den, block_hashes):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches, shared=shared):
            for b in batches:
                texts = (word_hashes(words_of(t.as_py())) for t in b.column(place))
                yield b.filter(pa.array([next(shared.value.matches(h), None) is None for h in texts], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_SHINGLES = """
  SELECT {id}, list_distinct(CASE
      WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM (SELECT {id}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table})"""

SQL = f"""
WITH d AS (SELECT doc_id, unnest(s) AS g FROM ({_SHINGLES.format(id="doc_id", table="documents")})),
i AS (SELECT item_id, len(s) AS n_item, unnest(s) AS g FROM ({_SHINGLES.format(id="item_id", table="benchmark")}))
SELECT d.doc_id, i.item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared,
       count(*) / any_value(n_item)::DOUBLE AS containment
FROM d JOIN i USING (g) GROUP BY d.doc_id, i.item_id HAVING 4 * count(*) >= 3 * any_value(n_item)
"""

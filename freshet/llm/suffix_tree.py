"""Language-model scores from a probabilistic suffix tree over bytes.

A text is its words, lower-cased, each with a space after it, and an end symbol.
Contexts are up to ``DEPTH`` bytes long. A context becomes a state of the tree
when it is frequent enough and a divergence test says that its next-symbol
distribution differs from its suffix's by more than chance: the log-likelihood
it gains, count times divergence, must exceed ``nats`` for each symbol it adds.
Distributions are smoothed by absolute discounting into the next shorter state,
and every byte is scored in its longest state. The probabilities of all texts
add up to one.

Counts cover all training text. N-grams are counted per task and summed by a
shuffle; the levels of the tree, their divergences and the states are DataFrame
work. What a scoring task loads from the shared folder is a table of the
``max_states`` states that gain most, and a bitmap of fixed size over all other
states. Bytes whose context may end in one of those are scored by ordinary joins
with the whole tree, so every state that passes the tests counts.

Word counts for the unigram base are summed by a shuffle too. Words among the
``max_words`` most frequent are looked up in a table of that size; all others go
to the word-count table by an ordinary join.

Defined results: a null text counts as empty and consists of the end symbol; a
null id counts as text '' for the held-out rule; rows that repeat an id are each
trained on and scored; without training text the base score is 0 and the tree is
the uniform distribution. Very long texts are counted and scored whole, in pieces
of some megabytes. States of equal gain go by length and context. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import opened
from .scratch import Scratch
from .shingles import word_hashes, words_of

DEPTH = 5
END = b"\n"
DISCOUNT = 0.6
_CHUNK = 2 << 20
_SLOTS = 22
_BITS = 27
_WORD, _GRAM, _DOCS = 0, 1, 2


def chunks(texts):
    """Lists of word lists, of about ``_CHUNK`` bytes each, from an Arrow column of texts."""
    held, size = [], 0
    for t in texts:
        words = words_of(t.as_py())
        held.append(words)
        size += sum(map(len, words)) + len(words)
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def gram_keys(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The key of each symbol with its context, the symbol in the lowest byte; symbols in each text."""
    data = b"".join(END * DEPTH + b" ".join([*words, END]) for words in docs)
    sizes = np.array([sum(map(len, words)) + len(words) + 1 for words in docs])
    buf = np.frombuffer(data, np.uint8)
    keys = buf.astype(np.uint64)
    for k in range(1, DEPTH + 1):
        keys[k:] |= buf[:-k].astype(np.uint64) << np.uint64(8 * k)
    starts = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]])
    real = np.ones(len(buf), bool)
    real[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
    return keys[real], sizes


def _sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(n, at)


def count_rows(docs: DataFrame) -> DataFrame:
    """kind, key, n: words, n-grams and rows of training text, summed per task."""
    import pyarrow as pa

    names = ["kind", "key", "n"]

    def batch(kind, keys, n):
        cols = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(np.asarray(keys, np.uint64).view(np.int64)), pa.array(np.asarray(n, np.int64))]
        return pa.RecordBatch.from_arrays(cols, names=names)

    def pieces(kind, keys, n, step=100_000):
        for i in range(0, len(keys), step):
            yield batch(kind, keys[i : i + step], n[i : i + step])

    def count(batches):
        words: Counter = Counter()
        grams, held, rows = [], 0, 0
        for b in batches:
            for docs in chunks(b.column(0)):
                rows += len(docs)
                for ws in docs:
                    words.update(ws)
                grams.append(_sorted_counts(gram_keys(docs)[0]))
                held += len(grams[-1][0])
                if held > 4_000_000:
                    grams = [_merged(grams)]
                    held = len(grams[0][0])
                    if held > 3_000_000:
                        yield from pieces(_GRAM, *grams[0])
                        grams, held = [], 0
                if len(words) > 1_000_000:
                    yield from pieces(_WORD, word_hashes(list(words)), np.fromiter(words.values(), np.int64, len(words)))
                    words.clear()
        if words:
            yield from pieces(_WORD, word_hashes(list(words)), np.fromiter(words.values(), np.int64, len(words)))
        if grams:
            yield from pieces(_GRAM, *_merged(grams))
        if rows:
            yield batch(_DOCS, [0], [rows])

    return docs.mapInArrow(count, "kind int, key long, n long")


def suffix_levels(grams: DataFrame) -> list[DataFrame]:
    """For each context length: key, n, ctx, total (of the context), kinds (its distinct symbols)."""
    levels, now = [], grams
    for k in range(DEPTH, -1, -1):
        if k < DEPTH:
            now = now.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1)).alias("key")).agg(F.sum("n").alias("n"))
        by = Window.partitionBy("ctx")
        level = now.withColumn("ctx", F.shiftright("key", 8))
        if k:
            level = level.withColumn("total", F.sum("n").over(by)).withColumn("kinds", F.count(F.lit(1)).over(by))
        levels.append(level)
    return levels[::-1]


def states_of(levels: list[DataFrame], all_symbols: int, least: int, nats: float) -> DataFrame:
    """k, ctx, total, kinds, gain of the contexts that pass the count and divergence tests."""
    out = []
    for k in range(1, DEPTH + 1):
        shorter = levels[k - 1]
        if k == 1:
            shorter = shorter.withColumn("total", F.lit(all_symbols))
        shorter = shorter.select(F.col("key").alias("suffix"), (F.col("n") / F.col("total")).alias("q"))
        suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))
        level = levels[k].where(F.col("total") >= least).withColumn("suffix", suffix).join(shorter, "suffix")
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / F.col("q")))
        tested = level.groupBy("ctx").agg(F.first("total").alias("total"), F.first("kinds").alias("kinds"), gain.alias("gain"))
        out.append(tested.where(F.col("gain") >= nats * F.col("kinds")).select(F.lit(k).alias("k"), "ctx", "total", "kinds", "gain"))
    return reduce(DataFrame.unionByName, out)


def _bits(k, ctx: np.ndarray) -> np.ndarray:
    """The place of states in the bitmap."""
    return ((ctx.astype(np.uint64) << np.uint64(3) | np.asarray(k).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def bitmap_rows(states: DataFrame) -> DataFrame:
    """word, bits: the words of the bitmap that have any of these states."""
    import pyarrow as pa

    def make(batches):
        for b in batches:
            at = _bits(*(b.column(i).to_numpy() for i in (0, 1)))
            bits = np.uint64(1) << (at & np.uint64(63))
            cols = [pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, names=["word", "bits"])

    rows = states.select("k", "ctx").mapInArrow(make, "word long, bits long")
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def key_logs(keys: DataFrame, states: DataFrame, symbols: DataFrame, root: np.ndarray) -> DataFrame:
    """key, log: what ``Tree.log10`` gives of these distinct keys, by joins with the whole tree."""
    first = keys.sparkSession.createDataFrame([(i, float(p)) for i, p in enumerate(root)], "symbol long, p double")
    out = keys.withColumn("symbol", F.col("key").bitwiseAND(F.lit(255))).join(F.broadcast(first), "symbol").drop("symbol")
    for k in range(1, DEPTH + 1):
        gram = F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        st = states.where(F.col("k") == k).select("ctx", "total", "kinds")
        sy = symbols.where(F.col("k") == k).select(F.col("key").alias("gram"), "n")
        out = out.withColumn("gram", gram).withColumn("ctx", F.shiftright("gram", 8)).join(st, "ctx", "left").join(sy, "gram", "left")
        seen = F.coalesce(F.col("n") - DISCOUNT, F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("p")).otherwise((seen + DISCOUNT * F.col("kinds") * F.col("p")) / F.col("total"))
        out = out.select("key", p.alias("p"))
    return out.select("key", F.log10("p").alias("log"))


def root_of(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probabilities of the symbols without context."""
    root = np.ones(256)
    root[keys] += n
    return root / root.sum()


class Tree:
    """States and their symbols as sorted arrays; log10 probabilities of keys.

    The probability of a key that may meet a state of ``others`` only is nan.
    """

    def __init__(self, states: list, symbols: list, root: np.ndarray, others: np.ndarray | None = None):
        self.states, self.symbols, self.root, self.others = states, symbols, root, others
        self.keys = np.full(1 << _SLOTS, ~np.uint64(0), np.uint64)
        self.logs = np.zeros(1 << _SLOTS)

    @classmethod
    def load(cls, uri: str, partial: bool = False) -> Tree:
        import pyarrow.parquet as pq

        system, path = opened(uri)
        st, sy = (pq.read_table(f"{path}/{t}", filesystem=system) for t in ("states", "symbols"))

        def by_level(table, key):
            cols = {c: table[c].to_numpy() for c in table.column_names}
            out = []
            for k in range(DEPTH + 1):
                at = np.flatnonzero(cols["k"] == k)
                at = at[np.argsort(cols[key][at], kind="stable")]
                out.append({c: v[at] for c, v in cols.items()})
            return out

        states, symbols = by_level(st, "ctx"), by_level(sy, "key")
        others = None
        if partial:
            words = pq.read_table(f"{path}/others", filesystem=system)
            others = np.zeros(1 << _BITS - 6, np.uint64)
            others[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
        return cls(states, symbols, root_of(symbols[0]["key"], symbols[0]["n"]), others)

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        """From the root down: each state that a context ends in discounts into what came before."""
        p = self.root[(keys & np.uint64(255)).astype(np.int64)]
        signed = keys.astype(np.int64)
        for k in range(1, DEPTH + 1):
            st, sy = self.states[k], self.symbols[k]
            gram = signed & ((1 << 8 * (k + 1)) - 1)
            ctx = gram >> 8
            if self.others is not None:
                at = _bits(k, ctx)
                p = np.where(self.others[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1), np.nan, p)
            if not len(st["ctx"]):
                continue
            at = np.minimum(np.searchsorted(st["ctx"], ctx), len(st["ctx"]) - 1)
            there = st["ctx"][at] == ctx
            total, kinds = st["total"][at].astype(float), st["kinds"][at]
            hit = np.minimum(np.searchsorted(sy["key"], gram), len(sy["key"]) - 1)
            seen = np.where(sy["key"][hit] == gram, sy["n"][hit] - DISCOUNT, 0.0)
            p = np.where(there, (seen + DISCOUNT * kinds * p) / total, p)
        return p

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Through a table of keys met before."""
        slot = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        out = self.logs[slot]
        new = np.flatnonzero(self.keys[slot] != keys)
        if len(new):
            uniq, back = np.unique(keys[new], return_inverse=True)
            logs = np.log10(self.probabilities(uniq))
            out[new] = logs[back]
            at = ((uniq * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOTS)).astype(np.int64)
            self.keys[at], self.logs[at] = uniq, logs
        return out


_LOADED: dict[str, tuple] = {}


def loaded(uri: str, partial: bool) -> tuple[Tree, np.ndarray, np.ndarray]:
    """The tree and the frequent words' hashes and counts; kept for a worker's next task."""
    import pyarrow.parquet as pq

    if uri not in _LOADED:
        _LOADED.clear()
        system, path = opened(uri)
        top = pq.read_table(f"{path}/frequent", filesystem=system)
        hashes = top["key"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        _LOADED[uri] = Tree.load(uri, partial), hashes[order], top["n"].to_numpy()[order]
    return _LOADED[uri]


def score_rows(docs: DataFrame, folder: str, rows_trained: int, partial: bool) -> DataFrame:
    """Per text: counts, the parts of the base score of frequent words and of the score by loaded states, the other words and keys."""
    import pyarrow as pa

    def score(batches):
        tree, top, top_n = loaded(folder, partial)
        logs = np.log10(top_n + 1.0)
        end_log, end_known = math.log10(rows_trained + 1), int(rows_trained > 0)
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for docs in chunks(b.column(2)):
                keys, sizes = gram_keys(docs)
                each = tree.log10(keys)
                open_ = np.isnan(each)
                out[4].append(np.add.reduceat(np.where(open_, 0.0, each), np.cumsum(sizes) - sizes))
                out[6].append((keys[open_].view(np.int64), np.add.reduceat(open_.astype(np.int64), np.cumsum(sizes) - sizes)))
                flat = [w for ws in docs for w in ws]
                h = word_hashes(flat)
                owner = np.repeat(np.arange(len(docs)), [len(ws) for ws in docs])
                spot = np.minimum(np.searchsorted(top, h), max(len(top) - 1, 0))
                known = top[spot] == h if len(top) else np.zeros(len(h), bool)
                out[0].append(np.array([len(ws) + 1 for ws in docs]))
                out[1].append(np.bincount(owner[known], minlength=len(docs)) + end_known)
                weights = logs[spot[known]] if len(top) else None
                out[2].append(np.bincount(owner[known], weights, minlength=len(docs)) + end_log)
                rest, whose = h[~known], owner[~known]
                cuts = np.searchsorted(whose, np.arange(len(docs) + 1))
                out[5].append((rest.view(np.int64), np.diff(cuts)))
            if not b.num_rows:
                continue
            cols = [b.column(0), b.column(1), *[pa.array(np.concatenate(out[k])) for k in (0, 1)]]
            cols += [pa.array(np.concatenate(out[k]).astype(float)) for k in (2, 4)]
            for k in (5, 6):
                offsets = np.concatenate([[0], np.cumsum(np.concatenate([c for _, c in out[k]]))]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r for r, _ in out[k]]))))
            names = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rest", "open"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rest array<long>, open array<long>"
    return docs.mapInArrow(score, schema)


def score_texts(
    docs: DataFrame, held_out, max_states: int = 300_000, max_words: int = 200_000, least: int = 8, nats: float = 2.0
) -> DataFrame:
    """Train on the rows where ``held_out`` (a Column) is false, score all rows.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    counted = count_rows(rows.where(~F.col("held_out")).select("text"))
    counts = scratch.keep(counted.groupBy("kind", "key").agg(F.sum("n").alias("n")), "counts")
    sums = {r["kind"]: (r["n"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect()}
    trained, symbols = sums.get(_DOCS, (0, 0))[0], sums.get(_GRAM, (0, 0))[0]
    train_tokens = sums.get(_WORD, (0, 0))[0] + trained
    vocabulary = sums.get(_WORD, (0, 0))[1] + int(trained > 0)

    grams = counts.where(F.col("kind") == _GRAM).select("key", "n")
    levels = [scratch.keep(x, f"level{k}") for k, x in enumerate(suffix_levels(grams))]
    states = scratch.keep(states_of(levels, symbols, least, nats), "all_states")
    entries = [levels[0].select(F.lit(0).alias("k"), "key", "n")]
    for k in range(1, DEPTH + 1):
        own = states.where(F.col("k") == k).select("ctx")
        entries.append(levels[k].join(own, "ctx", "left_semi").select(F.lit(k).alias("k"), "key", "n"))
    entries = reduce(DataFrame.unionByName, entries)
    partial = states.count() > max_states
    if partial:
        entries = scratch.keep(entries, "all_symbols")
        top = scratch.keep(states.orderBy(F.desc("gain"), "k", "ctx").limit(max_states), "states")
        scratch.keep(bitmap_rows(states.join(top, ["k", "ctx"], "left_anti")), "others")
        near = entries.withColumn("ctx", F.shiftright("key", 8)).join(top.select("k", "ctx"), ["k", "ctx"], "left_semi")
        scratch.keep(near.select("k", "key", "n").unionByName(entries.where("k = 0")), "symbols")
    else:
        scratch.keep(states, "states")
        scratch.keep(entries, "symbols")
    words = counts.where(F.col("kind") == _WORD).select("key", "n")
    scratch.keep(words.orderBy(F.desc("n"), "key").limit(max_words), "frequent")
    scratch.drop(*[f"level{k}" for k in range(DEPTH + 1)])

    scored = scratch.keep(score_rows(rows, scratch.root, trained, partial).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("key")).join(words, "key")
    rest = rest.groupBy("row").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more"))
    out = scored.drop("rest", "open").join(rest, "row", "left")
    if partial:
        opened_ = scratch.keep(scored.select("row", F.explode("open").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times")), "open")
        first = entries.where("k = 0").select("key", "n").collect()  # one row a symbol
        root = root_of(np.array([r["key"] for r in first], int), np.array([r["n"] for r in first], int))
        logs = opened_.join(key_logs(opened_.select("key").distinct(), states, entries, root), "key")
        logs = logs.groupBy("row").agg(F.sum(F.col("times") * F.col("log")).alias("more_score"))
        out = out.join(logs, "row", "left").withColumn("score", F.col("score") + F.coalesce("more_score", F.lit(0.0))).drop("more_score")
    norm = math.log10(train_tokens + vocabulary + 1)
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )


def op2_suffix_tree(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2)

"""Token-id shards with Elias-Fano encoded document boundaries.

Documents are dealt into ranges of ascending id and each range becomes one
shard, written as it is tokenised. A shard is

    ids (uint16, or uint32 for a larger vocabulary), concatenated
    Elias-Fano sequence of document ends
    Elias-Fano sequence of document ids (less the smallest)
    footer of fixed length

An Elias-Fano sequence of ``n`` values below ``u`` takes about
``2 + log2(u / n)`` bits a value; ``select`` finds a value by way of sampled
positions of ones, so no table of 64-bit offsets exists on disk or in memory.

Defined results: a null text counts as empty and has the end id alone; rows
with a null id come first, repeated ids follow each other ordered by text; a very
long text is coded whole, in one piece; an empty table gives no shard and an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .files import opened, written
from .scratch import Scratch, small_batches

MAGIC = b"EFTOKEN1"
_FOOT = "<8sQQQQQQqQ"  # magic, width, tokens, docs, null ids, bytes of ends, bytes of ids, least id, reserved
_EVERY = 256
MANIFEST = "shard int, path string, n_docs long, n_tokens long"


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        # positions of every 256th one, relative to the words they are in: 32-bit samples
        ones = np.bitwise_count(high).cumsum(dtype=np.int64) if len(high) else np.empty(0, np.int64)
        self.samples = np.searchsorted(ones, np.arange(0, n, _EVERY), "right").astype(np.uint32)
        self.before = (ones[self.samples] - np.bitwise_count(high[self.samples])).astype(np.uint32) if n else self.samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        bits = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        if bits:
            at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
            part = values & np.uint64((1 << bits) - 1)
            word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            np.bitwise_or.at(low, word, part << shift)
            over = shift + np.uint64(bits) > np.uint64(64)
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        high = np.zeros(int(ones[-1]) // 64 + 1 if n else 0, np.uint64)
        np.bitwise_or.at(high, (ones >> np.uint64(6)).astype(np.int64), np.uint64(1) << (ones & np.uint64(63)))
        return cls(n, bits, low, high)

    def select(self, i: int) -> int:
        """The ``i``-th value."""
        word = int(self.samples[i // _EVERY])
        seen = int(self.before[i // _EVERY])
        while seen + (c := int(np.bitwise_count(self.high[word]))) <= i:
            seen, word = seen + c, word + 1
        bits = int(self.high[word])
        for _ in range(i - seen):
            bits &= bits - 1
        one = word * 64 + (bits & -bits).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def _low(self, i: int) -> int:
        if not self.low_bits:
            return 0
        word, shift = divmod(i * self.low_bits, 64)
        both = int(self.low[word]) | int(self.low[word + 1]) << 64
        return both >> shift & ((1 << self.low_bits) - 1)

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQQ", self.n, self.low_bits, len(self.high))
        return head + self.low.astype("<u8").tobytes() + self.high.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, words = struct.unpack_from("<QQQ", data)
        lows = (n * bits + 63) // 64 + 1
        low = np.frombuffer(data, "<u8", lows, 24)
        return cls(n, bits, low, np.frombuffer(data, "<u8", words, 24 + 8 * lows))


#: Characters by which a text's pieces can't be told here: those past Latin Extended-A, the dotted capital I, white space
#: other than the usual six, and the start of a special token's string. (For RE2.)
_HARD = r"[^\x00-\x1b\x20-\x{84}\x{86}-\x{9f}\x{a1}-\x{12f}\x{131}-\x{17f}]|<\|"
_LETTER, _NUMBER = "a-zªµºß-öø-ÿĀ-ſ", "0-9²³¹¼½¾"
#: The tokenizer's own pieces, for such characters in lower case; and a line's end.
_PIECE = re.compile(f"\n|'(?:s|t|re|ve|m|ll|d)|[{_LETTER}]+|[{_NUMBER}]|[^\\s{_LETTER}{_NUMBER}]+")


def _gathered(table: np.ndarray, sizes: np.ndarray, which: np.ndarray, together: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``table`` (run k has ``sizes[k]`` items) in the order of ``which``, end to end; and where each ends.

    So many runs are placed ``together``: places take eight bytes an item, an item two or four.
    """
    ends = np.cumsum(sizes[which])
    starts = np.cumsum(sizes) - sizes
    out = np.empty(ends[-1] if len(ends) else 0, table.dtype)
    for i in range(0, len(which), together):
        part = which[i : i + together]
        n, base = sizes[part], int(ends[i - 1]) if i else 0
        places = np.repeat(starts[part] - ends[i : i + together] + n + base, n)
        places += np.arange(len(places))
        out[base : base + len(places)] = table[places]
    return out, ends


class WordCoder:
    """Ids of whole texts from ids of their distinct words, and those from ids of distinct pieces.

    The tokenizer lowers case, drops white space and cuts words into pieces
    (letters, a number, marks) that it codes each by itself. New pieces are coded
    many at a time: each ends in one token that has the end-of-word suffix, which
    tells where its ids end; if the counts don't agree, each is coded alone. Texts
    with characters that might be cut in another way are coded as they are.

    Pieces are kept with their ids as bytes: those of the last ``most`` met or so.
    """

    def __init__(self, path: str, dtype: str, most: int = 250_000, suffix: str = "</w>"):
        from tokenizers import Tokenizer

        self.coder, self.dtype, self.most = Tokenizer.from_file(path), np.dtype(dtype), most
        vocabulary = self.coder.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        # one by one: the coder's own record of a text takes some hundred bytes a token
        coded = (self.coder.encode_batch_fast([t], add_special_tokens=False)[0] for t in texts)
        return [np.array(e.ids, self.dtype).tobytes() for e in coded]

    def _together(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), 1000):
            part = pieces[i : i + 1000]
            ids = np.array(self.coder.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            marks = np.flatnonzero(self.last[ids])
            if len(marks) != len(part):
                out += self._alone(part)
                continue
            data, width, at = ids.tobytes(), ids.itemsize, 0
            for end in ((marks + 1) * width).tolist():
                out.append(data[at:end])
                at = end
        return out

    def _coded(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces. What ``now`` lacks may still be in ``before``, from where it comes back."""
        now, before = self.now, self.before
        new = []
        for p in pieces:
            if p not in now:
                if p in before:
                    now[p] = before[p]
                else:
                    new.append(p)
        now.update(zip(new, self._together(new), strict=True))
        out = [now[p] for p in pieces]
        if len(now) > self.most // 2:
            self.before, self.now = now, {}
        return out

    def _plain(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without hard characters, and where each text ends."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
        words = split.flatten().dictionary_encode()
        cut = pa.array(_PIECE.findall("\n".join([*words.dictionary.to_pylist(), ""])), pa.string()).dictionary_encode()
        pieces = cut.dictionary.to_pylist()
        end = pieces.index("\n") if "\n" in pieces else -1
        coded = self._coded(pieces[:end] + pieces[end + 1 :] if end >= 0 else pieces)
        if end >= 0:
            coded.insert(end, b"")
        width = self.dtype.itemsize
        sizes = np.array([len(c) // width for c in coded], np.int64)
        which = cut.indices.to_numpy()
        table, ends = _gathered(np.frombuffer(b"".join(coded), self.dtype), sizes, which)
        ends = ends[which == end]  # of words
        ids, ends = _gathered(table, np.diff(ends, prepend=0), words.indices.to_numpy())
        return ids, np.concatenate([[0], ends])[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()]

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of an Arrow column of texts, end to end, and how many each text has; null counts as empty."""
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        marked = pc.match_substring_regex(texts, _HARD)
        hard = marked.to_numpy(zero_copy_only=False)
        if not hard.any():
            ids, ends = self._plain(texts)
            return ids, np.diff(ends, prepend=0)
        counts, parts = np.zeros(len(texts), np.int64), [np.empty(0, self.dtype)] * 2
        if not hard.all():
            parts[0], ends = self._plain(texts.filter(pc.invert(marked)))
            counts[~hard] = np.diff(ends, prepend=0)
        coded = self._alone(texts.filter(marked).to_pylist())
        parts[1] = np.frombuffer(b"".join(coded), self.dtype)
        counts[hard] = [len(c) // self.dtype.itemsize for c in coded]
        ids, own = np.empty(counts.sum(), self.dtype), np.repeat(hard, counts)
        ids[~own], ids[own] = parts
        return ids, counts

    def stream(self, columns, size: int = 3 << 20):
        """``encode`` of about ``size`` bytes of texts at a time, from Arrow columns one after the other."""
        import pyarrow as pa
        import pyarrow.compute as pc

        held, n = [], 0
        for column in columns:
            total = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(column):
                end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size - n, "right")))
                held.append(column.slice(at, end - at))
                n += int(total[end - 1] - (total[at - 1] if at else 0))
                at = end
                if n >= size or at < len(column):
                    yield self.encode(pa.concat_arrays(held))
                    held, n = [], 0
        if held:
            yield self.encode(pa.concat_arrays(held))


_CODERS: dict[tuple[str, str], WordCoder] = {}


def word_coder(path: str, dtype: str) -> WordCoder:
    """The coder of this worker, kept with its words for the next task."""
    if (path, dtype) not in _CODERS:
        _CODERS.clear()
        _CODERS[path, dtype] = WordCoder(path, dtype)
    return _CODERS[path, dtype]


def write_shards(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, wide: bool = False) -> DataFrame:
    """Write ``docs`` (doc_id, text) as shards below ``folder``; a row of ``MANIFEST`` for each. Lazy: keep the result."""
    import pyarrow as pa

    dtype = "<u4" if wide else "<u2"

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        coder = word_coder(tokenizer or default_tokenizer(), dtype)
        end = np.array(end_id, dtype)
        shard = TaskContext.get().partitionId()
        path, ids, ends, nulls, total = f"{folder}/shard-{shard:06d}.eft", [], [], 0, 0
        with written(path) as out:
            def texts():
                nonlocal nulls
                for batch in _chain(first, batches):
                    keys = batch.column(0)
                    nulls += keys.null_count
                    ids.append(keys.drop_null().to_numpy(zero_copy_only=False))
                    yield batch.column(1)

            for flat, counts in coder.stream(texts()):
                out.write(np.insert(flat, np.cumsum(counts), end).tobytes())
                ends.append(total + np.cumsum(counts + 1))
                total = int(ends[-1][-1])
            keys, ends = np.concatenate(ids), np.concatenate(ends)
            least = int(keys[0]) if len(keys) else 0
            b_ends = EliasFano.encode(ends.astype(np.uint64)).to_bytes()
            b_keys = EliasFano.encode((keys - least).astype(np.uint64)).to_bytes()
            out.write(b_ends + b_keys)
            out.write(struct.pack(_FOOT, MAGIC, end.itemsize, total, len(ends), nulls, len(b_ends), len(b_keys), least, 0))
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "n_docs": [len(ends)], "n_tokens": [total]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the head of the text splits what repeats an id, or has none
    return rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST)


def _chain(first, rest):
    yield first
    yield from rest


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Shard:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size, foot = self.file.size(), struct.calcsize(_FOOT)
        magic, self.width, self.n_tokens, self.n_docs, self.nulls, n_ends, n_keys, self.least, _ = struct.unpack(_FOOT, 
            self.file.read_at(foot, size - foot)
        )
        if magic != MAGIC:
            raise ValueError(f"not a token shard: {uri}")
        body = self.width * self.n_tokens
        self.ends = EliasFano.from_bytes(self.file.read_at(n_ends, body))
        self.keys = EliasFano.from_bytes(self.file.read_at(n_keys, body + n_ends))

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.keys.select(i - self.nulls)

    def ids(self, start: int, end: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at((end - start) * self.width, start * self.width), f"<u{self.width}")


def read_shards(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shard files."""
    import pyarrow as pa

    # one row for each shard file: running totals over the file list, not over documents
    total = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.withColumn("base", F.coalesce(total, F.lit(0)))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard, rows = Shard(path), []
                for i in range(shard.n_docs):
                    a, b = shard.span(i)
                    rows.append((shard.key(i), base + a, b - a, zlib.crc32(shard.ids(a, b).astype("<u4").tobytes())))
                    if len(rows) == 8192 or i + 1 == shard.n_docs:
                        cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
                        yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                        rows = []

    n = max(1, manifest.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return shards.select("path", "base").repartition(n).mapInArrow(read, schema)


def token_output(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write ``docs`` as shards in the shared folder and read them back."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "tokens")
    with small_batches(spark, 500):  # a worker holds the tokenizer and its words besides
        manifest = scratch.keep(write_shards(docs, scratch.path("shards"), tokenizer, end_id), "manifest")
    return read_shards(spark, manifest)


def op7_token_binary(spark, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))

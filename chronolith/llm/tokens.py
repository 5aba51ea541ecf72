"""Token counts from pre-token frequencies: each distinct pre-token is counted once.

One pass cuts texts into pre-tokens and writes, per block of documents, its
distinct pre-tokens, numbered and packed by bucket (a hash of the pre-token),
and the documents' frequencies as packed arrays of those numbers (postings).
Buckets of all blocks meet, where each distinct pre-token is counted once; the
counts go back to the blocks, are joined to the frequencies there, and frequency
times pieces is summed per document. Ids are never materialised, and a frequent
pre-token costs an entry per block, not per document. A task holds the distinct
pre-tokens of one bucket at a time; buckets, each a partition, are as many as the
bytes of text ask for.

Defined results: null and empty texts have 0 bytes and 0 tokens; rows are told
apart by their place in a block, so repeated rows and repeated or null ids each
keep their own row; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import chunks, texts, tune, written
from chronolith.llm.pretokens import Splitter

#: Bytes of text in one block, and documents in one row of its postings.
BLOCK_BYTES = 32_000_000
SLICE_DOCS = 1000
#: Bytes of text in the corpus for one bucket of distinct pre-tokens.
BUCKET_BYTES = 32_000_000

_POSTINGS = "block long, bucket int, packed_words binary, doc_ids array<long>, sizes array<long>, fixed array<long>, lengths array<int>, packed binary"


class Counts:
    """A tokenizer file with its pre-token splitter and its special strings."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        pre = self.tokenizer.pre_tokenizer
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

        def kind(c: str) -> str:
            spans = [x[1] for x in pre.pre_tokenize_str(f"a{c}1")]
            return "L" if spans[0] == (0, 2) else "N" if spans[-1] == (1, 3) else "O"

        self.splitter = Splitter(pattern, kind)

    def cut(self, text: str) -> tuple[Counter, int]:
        """Frequencies of pre-tokens and the number of special strings."""
        if self.special is None or not self.special.search(text):
            return Counter(self.splitter.split(text)), 0
        parts = self.special.split(text)
        return Counter(w for p in parts for w in self.splitter.split(p)), len(parts) - 1

    def count(self, pieces: list[str]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


_COUNTS: dict[tuple[str, str], Counts] = {}


def counts(path: str, pattern: str) -> Counts:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if (path, pattern) not in _COUNTS:
        _COUNTS[path, pattern] = Counts(path, pattern)
    return _COUNTS[path, pattern]


class _Block:
    """Pre-tokens and postings of one block as it is read."""

    def __init__(self, block: int):
        self.block, self.number, self.bytes = block, {}, 0
        self.docs: list[tuple[int | None, int, int, np.ndarray, np.ndarray]] = []

    def add(self, c: Counts, doc_id: int | None, text: str) -> None:
        freq, special = c.cut(text)
        at, n = self.number, len(freq)
        numbers = np.fromiter((at.setdefault(w, len(at)) for w in freq), np.int32, n)
        times = np.fromiter(freq.values(), np.int32, n)
        order = np.argsort(numbers)
        size = len(text.encode("utf-8"))
        self.bytes += size
        self.docs.append((doc_id, size, special, numbers[order], times[order]))

    def rows(self, buckets: int) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        pack = zstandard.ZstdCompressor(3).compress
        schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("packed_words", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("fixed", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("packed", pa.binary())])
        words = [w.encode("utf-8") for w in self.number]
        bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words), dtype=np.int32)  # numbers run through the buckets in order
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            part = [words[i] for i in order[ends[k] : ends[k + 1]].tolist()]
            body = np.array([len(part), *map(len, part)], np.uint32).tobytes() + b"".join(part)
            yield pa.RecordBatch.from_arrays([pa.array([self.block], pa.int64()), pa.array([k], pa.int32()), pa.array([pack(body)], pa.binary()), *[pa.nulls(1, schema.field(i).type) for i in range(3, 8)]], schema=schema)
        for a in range(0, len(self.docs), SLICE_DOCS):
            part = self.docs[a : a + SLICE_DOCS]
            numbers, times = [], []
            for _, _, _, n, t in part:
                n = rank[n]
                o = np.argsort(n)
                numbers.append(np.diff(n[o], prepend=np.int32(0)).tobytes())
                times.append(t[o].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array([self.block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), *[pa.array([[d[i] for d in part]], pa.list_(pa.int64())) for i in range(3)], pa.array([[len(d[3]) for d in part]], pa.list_(pa.int32())), pa.array([pack(b"".join(numbers + times))], pa.binary())],
                schema=schema,
            )


def _unpacked(blob: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw[:4], np.uint32)[0])
    size = np.frombuffer(raw[4 : 4 + 4 * n], np.uint32)
    ends = (np.cumsum(size, dtype=np.int64) + 4 + 4 * n).tolist()
    return [raw[a:b] for a, b in zip([4 + 4 * n, *ends], ends)]


def postings(docs: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """Rows (block, bucket, packed words) of each block's distinct pre-tokens, and rows of packed postings (bucket null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        c = counts(path, pattern)
        held = _Block(TaskContext.get().partitionId() << 24)
        for part in chunks(batches):
            for doc_id, text in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), texts(part.column("text")).to_pylist()):
                held.add(c, doc_id, text)
            if held.bytes >= BLOCK_BYTES:
                yield from held.rows(buckets)
                held = _Block(held.block + 1)
        yield from held.rows(buckets)

    return docs.select("doc_id", "text").mapInArrow(run, _POSTINGS)


def piece_counts(words: DataFrame, path: str, pattern: str, buckets: int) -> DataFrame:
    """block, bucket, packed counts of the pieces. Buckets come one after another, so each distinct pre-token is counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        c = counts(path, pattern)
        bucket, known = None, {}
        for part in batches:
            packed = []
            for k, blob in zip(part.column("bucket").to_pylist(), part.column("packed_words").to_pylist()):
                if k != bucket:
                    bucket, known = k, {}
                words = _unpacked(blob)
                new = [w for w in words if w not in known]
                known.update(zip(new, c.count([w.decode("utf-8") for w in new])))
                packed.append(zstandard.ZstdCompressor(3).compress(np.fromiter((known[w] for w in words), np.int32, len(words)).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("block"), part.column("bucket"), pa.array(packed, pa.binary())], names=["block", "bucket", "counts"])

    return words.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, "block long, bucket int, counts binary")


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts and postings of a block meet: its counts come first, then rows of postings."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    block, found, pieces = None, [], None
    for part in batches:
        for i, (own, blob) in enumerate(zip(part.column("block").to_pylist(), part.column("counts").to_pylist())):
            if own != block:
                block, found, pieces = own, [], None
            if blob is not None:
                found.append(np.frombuffer(unpack(blob), np.int32))
                continue
            if pieces is None:
                pieces = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            length = np.array(part.column("lengths")[i].as_py(), dtype=np.int64)
            raw = np.frombuffer(unpack(part.column("packed")[i].as_py()), np.int32)
            delta, times = raw[: len(raw) // 2].astype(np.int64), raw[len(raw) // 2 :]
            at = np.cumsum(delta)
            start = np.cumsum(length) - length
            base = np.where(start > 0, at[np.maximum(start - 1, 0)], 0) if len(at) else start * 0
            at = at - np.repeat(base, length)
            total = np.concatenate([[0], np.cumsum(pieces[at] * times)])
            n = total[start + length] - total[start] + np.array(part.column("fixed")[i].as_py(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_ids")[i].values, part.column("sizes")[i].values, pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, path: str, pattern: str, limit: int = 512) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    tune(spark)
    # Buckets follow the bytes of text, so that what one of them holds doesn't grow with the corpus.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    rows = written(postings(docs, path, pattern, buckets), "postings")
    counted = piece_counts(rows.where("bucket is not null").select("block", "bucket", "packed_words"), path, pattern, buckets)
    both = counted.unionByName(rows.where("bucket is null").drop("packed_words"), allowMissingColumns=True)
    met = both.repartition("block").sortWithinPartitions("block", F.asc_nulls_last("bucket"))
    out = met.mapInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)

"""Phrases of words that occur together, mined depth-first on position bitmaps.

Texts are cut into pieces and words and kept in shards of one language: a dictionary and
the words' codes, with a gap between pieces. In a shard each word has a bitmap of its
positions, compressed to the 64-bit blocks that hold a bit. A phrase has a bitmap of its
first positions; it is extended, depth first, by ANDing the bitmap of the next word shifted
back by the phrase's length, for all words that may follow at once. Popcount is the shard's
count, and the counts of all shards are summed by phrase. A gap keeps a phrase inside its piece.

What to extend is pruned for the whole corpus, as no phrase is more frequent than its
parts: words and pairs, then triples and quadruples of frequent pairs, are counted in a
table of hashed counters of fixed size, whose slots under the limit rule a phrase out
everywhere. Such a table only names candidates (collisions let more pass); every count
in the result is a sum of popcounts.

A frequency, score or product is exact: sums are 64-bit, products decimals.

Defined results: null or empty texts have no words; a null language counts as ``und``;
repeated rows count again; documents are cut by piece, so very long texts need no more
memory than a shard; an empty table gives no phrases; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import chunks, texts, tune, written
from chronolith.llm.words import U, mix

#: Bytes of text of one shard, and of all shards that a task holds open.
SHARD_BYTES, OPEN_BYTES = 8_000_000, 24_000_000
#: Shards of one file, which a reader holds at once.
FILE_SHARDS = 8
#: Words of the longest phrase.
LONGEST = 4
#: Slots of a counter table: a power of two near the text's bytes over 8, within these bounds. A table is a bit per slot where it is broadcast.
SLOTS = (1 << 20, 1 << 30)
#: Slots of one slice, the unit in which counters are summed, and slices of a table from which on they grow.
SLICE, SLICES = 1 << 16, 1 << 12
#: Blocks from which on a word's bitmap is also kept as a plain row.
WIDE = 2048
#: Bytes of all plain rows of one level; the words with most blocks have them.
PLAIN_BYTES = 16_000_000
#: Next words of a phrase from which on they are met together.
FEW = 8
#: Bytes of text in the corpus for one bucket of phrases, whose counts are summed in one go.
BUCKET_BYTES = 16_000_000
#: Salts of the final ranking, so that no task sorts a whole language.
SALTS = 64

_WORD, _SPACE, _CUT = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = _SPACE
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# ---- shards --------------------------------------------------------------------------------------------------------


def _cut(column: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Lower-cased words of all texts, and for each whether it begins a piece."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    body = column.buffers()[2]
    data = _LOWER[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body is not None else np.zeros(0, np.uint8)
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets - offsets[0]] = True
    word = np.concatenate([[False], kind == _WORD, [False]])
    start = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    end = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    cuts = np.cumsum((kind == _CUT).astype(np.int64) + edge[:-1])
    begins = np.ones(len(start), bool)
    if len(start):
        begins[1:] = np.diff(cuts[start]) > 0
    packed = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    held = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(packed), pa.py_buffer(data[word[1:-1]])])
    return held, begins


def _shard(lang: str, parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
    found = pa.chunked_array([p[0] for p in parts]).combine_chunks().dictionary_encode()
    codes, begins = found.indices.to_numpy().astype(np.int32), np.concatenate([p[1] for p in parts])
    laid = np.full(len(codes) + int(begins.sum()), -1, np.int32)  # a gap before each piece
    laid[np.arange(len(codes)) + np.cumsum(begins)] = codes
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([found.dictionary.cast(pa.large_string()).to_pylist()], pa.list_(pa.string())), pa.array([laid.tobytes()], pa.binary())], names=["lang", "words", "codes"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: dict[str, list] = {}
    size: dict[str, int] = {}
    for batch in chunks(batches):
        lang = batch.column("lang").dictionary_encode()
        for k, name in enumerate(lang.dictionary.to_pylist()):
            held, begins = _cut(texts(batch.column("text").filter(pc.equal(lang.indices, k))))
            if len(begins):
                parts.setdefault(name, []).append((held, begins))
                size[name] = size.get(name, 0) + held.nbytes
        while parts and (max(size.values()) >= SHARD_BYTES or sum(size.values()) >= OPEN_BYTES):
            name = max(size, key=size.get)
            del size[name]
            yield _shard(name, parts.pop(name))
    for name, held in parts.items():
        yield _shard(name, held)


def shards(docs: DataFrame) -> DataFrame:
    """lang, words (the dictionary), codes (int32 of each position; -1 is a gap)."""
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(_shards, "lang string, words array<string>, codes binary")


def _key(words: list[np.ndarray]) -> np.ndarray:
    """A hash for each row of word hashes."""
    key = np.full(len(words[0]), len(words), U)
    for h in words:
        key = mix(key * U(0x9E3779B97F4A7C15) + h)
    return key


class Shard:
    """Codes by position, and the hash of each word, which also tells languages apart."""

    def __init__(self, lang: str, words: pa.Array, codes: bytes):
        import xxhash

        self.lang, self.words, self.codes = lang, words.to_pylist(), np.frombuffer(codes, np.int32)
        salt = xxhash.xxh64_intdigest(lang)
        self.hash = np.fromiter((xxhash.xxh64_intdigest(w, salt) for w in self.words), U, len(self.words))

    def keys(self, at: np.ndarray, n: int) -> np.ndarray:
        """A hash for each run of n words from the given positions on."""
        return _key([self.hash[self.codes[at + k]] for k in range(n)])

    def linked(self, pairs: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions where a frequent pair starts, and where three and four words start whose pairs are all frequent."""
        word = self.codes >= 0
        two = np.flatnonzero(word[:-1] & word[1:])
        two = two[_has(pairs, self.keys(two, 2))]
        link = np.zeros(len(word) + LONGEST, bool)
        link[two] = True
        return two, np.flatnonzero(link[:-1] & link[1:]), np.flatnonzero(link[:-2] & link[1:-1] & link[2:])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield Shard(batch.column("lang")[k].as_py(), batch.column("words")[k].values, batch.column("codes")[k].as_py())


# ---- hashed counters -----------------------------------------------------------------------------------------------


def _has(table: bytes, keys: np.ndarray) -> np.ndarray:
    """Whether the slot of each key is set in a table of bits."""
    bits = np.frombuffer(table, np.uint8)
    slot = keys & U(8 * len(bits) - 1)
    return (bits[(slot >> U(3)).astype(np.int64)] >> (slot & U(7)).astype(np.uint8)) & 1 > 0


def _width(slots: int) -> int:
    """Slots of a slice of a table."""
    return max(SLICE, slots // SLICES)


def _counters(found: Iterator[np.ndarray], slots: int) -> Iterator[pa.RecordBatch]:
    """For each array of keys a row for each slice: packed slots and counts."""
    import zstandard

    pack, width = zstandard.ZstdCompressor(1).compress, _width(slots)
    for keys in found:
        slot, times = np.unique((keys & U(slots - 1)).astype(np.int64), return_counts=True)
        ends = np.searchsorted(slot, np.arange(0, slots + 1, width))
        some = np.flatnonzero(np.diff(ends))
        packed = [pack(np.concatenate([(slot[ends[k] : ends[k + 1]] - k * width).astype(np.uint32), times[ends[k] : ends[k + 1]].astype(np.uint32)]).tobytes()) for k in some.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["slice", "packed"])


def _summed(least: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        now, total = None, np.zeros(width, np.int64)

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())], names=["slice", "bits"])

        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("packed").to_pylist()):
                if k != now:
                    if now is not None:
                        yield row()
                    now, total = k, np.zeros(width, np.int64)
                raw = np.frombuffer(unpack(blob), np.uint32)
                total[raw[: len(raw) // 2]] += raw[len(raw) // 2 :]
        if now is not None:
            yield row()

    return run


def _table(counted: DataFrame, slots: int, least: int) -> bytes:
    """The slots whose sum reaches the limit, as bits: a table of fixed size, whatever the corpus."""
    width = _width(slots)
    # Stored, as an iterator would sum up one partition after the other.
    slices = written(counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(_summed(least, width), "slice int, bits binary"), "slots")
    out = bytearray(slots // 8)
    for r in slices.toLocalIterator():
        out[r.slice * (width // 8) : (r.slice + 1) * (width // 8)] = r.bits
    return bytes(out)


# ---- bitmaps -------------------------------------------------------------------------------------------------------


class Bitmaps:
    """Position bitmaps of the words of a shard, all shifted back by some places.

    A bitmap is compressed to the numbers of the 64-bit blocks that hold a bit, and these blocks;
    the bitmaps stand one after another by code. Words with many blocks are also spread to plain rows.
    """

    def __init__(self, codes: np.ndarray, by_code: np.ndarray, of: np.ndarray, back: int = 0, wide: int | None = None):
        """by_code: positions with a word in order of code; of: for each code whether its bitmap is wanted. A position less than ``back`` goes."""
        at = by_code[of[codes[by_code]] & (by_code >= back)]
        code, at = codes[at], at - back
        block = at >> 6
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(code) != 0) | (np.diff(block) != 0)
        first = np.flatnonzero(new)
        self.blocks = block[first]
        self.bits = np.bitwise_or.reduceat(U(1) << (at & 63).astype(U), first) if len(at) else np.zeros(0, U)
        self.bounds = np.searchsorted(code[first], np.arange(len(of) + 1))
        self.size = np.diff(self.bounds)
        self.span = (len(codes) >> 6) + 1
        wide = np.flatnonzero(self.size > (WIDE if wide is None else wide))
        wide = np.sort(wide[np.argsort(-self.size[wide], kind="stable")[: PLAIN_BYTES // (8 * self.span)]])
        self.row = np.full(len(of), -1)
        self.row[wide] = np.arange(len(wide))
        self.plain = np.zeros((len(wide), self.span), U)
        for k, c in enumerate(wide.tolist()):
            blocks, bits = self.word(c)
            self.plain[k, blocks] = bits

    def word(self, code: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.bounds[code], self.bounds[code + 1]
        return self.blocks[a:b], self.bits[a:b]

    def one(self, x: tuple[np.ndarray, np.ndarray], code: int) -> tuple[np.ndarray, np.ndarray]:
        """A bitmap ANDed with that of one word; blocks may be empty."""
        if self.row[code] >= 0:
            return x[0], self.plain[self.row[code]][x[0]] & x[1]
        y = self.word(code)
        if len(x[0]) > len(y[0]):
            x, y = y, x
        if not len(x[0]):
            return x
        at = y[0].searchsorted(x[0])
        return x[0], np.where(y[0].take(at, mode="clip") == x[0], y[1].take(at, mode="clip") & x[1], U(0))

    def met(self, x: tuple[np.ndarray, np.ndarray], codes: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, list]:
        """Popcounts of a bitmap ANDed with those of some words, and for each word how to get the AND itself.

        room: a row of zeros, one for each block, which is left as it was.
        """
        blocks, bits = x
        if len(codes) < FEW:
            parts = [self.one(x, c) for c in codes.tolist()]
            return np.array([int(np.bitwise_count(p[1]).sum()) for p in parts]), parts
        counts = np.zeros(len(codes), np.int64)
        parts: list = [None] * len(codes)
        wide = self.row[codes]
        some = np.flatnonzero(wide >= 0)
        if len(some):
            both = self.plain[wide[some][:, None], blocks] & bits
            counts[some] = np.bitwise_count(both).sum(axis=1)
            for k, row in zip(some.tolist(), both):
                parts[k] = (blocks, row)
        some = np.flatnonzero(wide < 0)
        if len(some):
            size = self.size[codes[some]]
            ends = np.cumsum(size)
            at = np.arange(ends[-1]) + np.repeat(self.bounds[codes[some]] - ends + size, size)
            room[blocks] = bits
            both = room[self.blocks[at]] & self.bits[at]
            room[blocks] = 0
            total = np.concatenate([[0], np.cumsum(np.bitwise_count(both), dtype=np.int64)])
            counts[some] = total[ends] - total[ends - size]
            for k, a, b in zip(some.tolist(), (ends - size).tolist(), ends.tolist()):
                parts[k] = (self.blocks[at[a:b]] if b - a < 64 else (self.blocks, at[a:b]), both[a:b])
        return counts, parts


def held(part: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The bitmap of a part that ``met`` names, without empty blocks."""
    blocks, bits = part
    if isinstance(blocks, tuple):
        blocks = blocks[0][blocks[1]]
    some = np.flatnonzero(bits)
    return blocks[some], bits[some]


def _children(parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (parent, next word), in order of parent, and the number of the one of each occurrence."""
    found, number = np.unique((parent.astype(np.int64) << 32) + word, return_inverse=True)
    return found >> 32, found & 0xFFFFFFFF, number


def _mined(shard: Shard, pairs: bytes, longer: bytes) -> tuple[list[str], list[int]]:
    """Counts of frequent words and of the candidate phrases that occur in a shard, depth-first."""
    codes, words = shard.codes, shard.words
    size = len(codes)
    two, three, four = shard.linked(pairs)
    three, four = three[_has(longer, shard.keys(three, 3))], four[_has(longer, shard.keys(four, 4))]
    frequent = _has(pairs, _key([shard.hash]))
    # The candidates by level: which words may follow a phrase.
    a, b, at = _children(codes[two], codes[two + 1])
    number = np.full(size, -1, np.int64)
    number[two] = at
    pair, c, at = _children(number[three], codes[three + 2])
    number = np.full(size, -1, np.int64)
    number[three] = at
    four = four[number[four] >= 0]
    triple, d, _ = _children(number[four], codes[four + 3])
    of_word, of_pair, of_triple = (np.searchsorted(x, np.arange(n + 1)).tolist() for x, n in ((a, len(words)), (pair, len(a)), (triple, len(pair))))
    # A phrase's bitmap has its first positions; the bitmap of its k-th word is shifted back by k to meet it.
    by_code = np.flatnonzero(codes >= 0)
    by_code = by_code[np.argsort(codes[by_code], kind="stable")]
    firsts = Bitmaps(codes, by_code, frequent, wide=size)  # these are read by word only
    wanted = np.zeros((3, len(words)), bool)
    for k, x in enumerate((b, c, d)):
        wanted[k, x] = True
    levels = [Bitmaps(codes, by_code, wanted[k], k + 1) for k in range(3)]
    room = np.zeros((size >> 6) + 1, U)
    phrases, counts = [], []

    def extend(bitmap: tuple[np.ndarray, np.ndarray], text: str, level: int, lo: int, hi: int) -> None:
        follow = (b, c, d)[level][lo:hi]
        found, parts = levels[level].met(bitmap, follow, room)
        below = (of_pair, of_triple)[level] if level < 2 else None
        for k, (w, n) in enumerate(zip(follow.tolist(), found.tolist())):
            own = f"{text} {words[w]}"
            phrases.append(own)
            counts.append(n)
            if below and below[lo + k] < below[lo + k + 1]:
                extend(held(parts[k]), own, level + 1, below[lo + k], below[lo + k + 1])

    for w in np.flatnonzero(frequent).tolist():
        bitmap = firsts.word(w)
        phrases.append(words[w])
        counts.append(int(np.bitwise_count(bitmap[1]).sum()))
        if of_word[w] < of_word[w + 1]:
            extend(bitmap, words[w], 0, of_word[w], of_word[w + 1])
    extend = None  # it refers to itself, which would keep the shard's arrays until garbage is collected
    return phrases, counts


def _packed(lang: str, phrases: list[str], counts: list[int], buckets: int) -> pa.RecordBatch:
    """A row for each bucket of phrases: the phrases in order, a line each, and their counts."""
    import xxhash
    import zstandard

    pack = zstandard.ZstdCompressor(3).compress
    order = sorted(range(len(phrases)), key=phrases.__getitem__)
    by: dict[int, list[int]] = {}
    for k in order:
        by.setdefault(xxhash.xxh64_intdigest(phrases[k]) % buckets, []).append(k)
    rows = [(k, pack("\n".join([phrases[i] for i in own]).encode()), pack(np.array([counts[i] for i in own], np.int64).tobytes())) for k, own in by.items()]
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), *[pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]], names=["lang", "bucket", "phrases", "counts"])


def _totals(least: int):
    """Sums of the packed counts, which come by language and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        now, total = None, {}

        def rows() -> Iterator[pa.RecordBatch]:
            kept = [(p, n) for p, n in total.items() if n >= least or not p]
            for k in range(0, len(kept), 50_000):
                part = kept[k : k + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(part), pa.string()), pa.array([p or None for p, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64())], names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, bucket, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "phrases", "counts"))):
                if (lang, bucket) != now:
                    yield from rows()
                    now, total = (lang, bucket), {}
                for p, n in zip(unpack(phrases).decode().split("\n"), np.frombuffer(unpack(counts), np.int64).tolist()):
                    total[p] = total.get(p, 0) + n
        yield from rows()

    return run


# ---- the corpus ----------------------------------------------------------------------------------------------------


def phrase_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """lang, phrase, f: words and phrases of up to ``LONGEST`` words that occur ``least`` times; the row without a phrase counts all words."""
    spark = docs.sparkSession
    tune(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slots = min(max(1 << (max(int(size), 1) // 8).bit_length(), SLOTS[0]), SLOTS[1])
    cut = written(shards(docs), "shards", maxRecordsPerFile=FILE_SHARDS)

    def ones_and_twos(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for s in _each(batches):
                word = s.codes >= 0
                yield np.concatenate([s.keys(np.flatnonzero(word), 1), s.keys(np.flatnonzero(word[:-1] & word[1:]), 2)])

        return _counters(keys(), slots)

    pairs = spark.sparkContext.broadcast(_table(cut.mapInArrow(ones_and_twos, "slice int, packed binary"), slots, least))

    def threes_and_fours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[np.ndarray]:
            for s in _each(batches):
                _, three, four = s.linked(pairs.value)
                yield np.concatenate([s.keys(three, 3), s.keys(four, 4)])

        return _counters(keys(), slots)

    longer = spark.sparkContext.broadcast(_table(cut.mapInArrow(threes_and_fours, "slice int, packed binary"), slots, least))

    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // BUCKET_BYTES))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _each(batches):
            phrases, counts = _mined(s, pairs.value, longer.value)
            yield _packed(s.lang, ["", *phrases], [int((s.codes >= 0).sum()), *counts], buckets)  # the empty phrase counts all words

    found = cut.mapInArrow(mine, "lang string, bucket int, phrases binary, counts binary")
    return found.repartition(buckets, "lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(_totals(least), "lang string, phrase string, f long")


def _part(words: str, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def _wide(name: str) -> str:
    return f"cast({name} as decimal(20,0))"


def collocations(docs: DataFrame, least: int = 30, limit: int = 2000, share: int = 80) -> DataFrame:
    """Each language's first ``limit`` phrases of 2 to ``LONGEST`` words: lang, rank, phrase, a, l, r, n, score.

    A phrase goes if a longer one with its words in a row has ``share`` percent of its frequency.
    """
    counts = written(phrase_counts(docs, least), "phrases")
    f = counts.where("phrase is not null")
    words = f.withColumn("w", F.split("phrase", " ")).withColumn("size", F.size("w")).where("size > 1")
    # Both parts of every cut are as frequent as the phrase, so they are in the table.
    cuts = words.select("lang", "phrase", F.col("f").alias("a"), "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("w", F.lit(1), F.col("k")).alias("left"), _part("w", F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    cuts = cuts.join(f.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(f.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"cast(2000000 as decimal(10,0)) * {_wide('a')} div ({_wide('l')} + {_wide('r')})")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = words.where("size > 2").select("lang", "w", "f", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("n"))
    inner = inner.select("lang", "w", "f", "n", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)).alias("i")).select("lang", _part("w", F.col("i"), F.col("n")).alias("phrase"), "f")
    inside = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(inside, ["lang", "phrase"], "left").where(f"longer is null or 100 * {_wide('longer')} < {share} * {_wide('a')}")
    rows = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # The best of each salt first, so that no task sorts a whole language.
    near = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= limit)
    top = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= limit)
    total = counts.where("phrase is null").select("lang", F.col("f").alias("n"))
    return top.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded and verified.

Texts become weighted sets of five-word shingles, weight = times in the text x
idf. Document frequencies cover the whole corpus and are exact where they matter:
the idf is ``1 + STRENGTH * ln(N / df) / ln(1 / SHARE)``, where a frequency under
``SHARE`` of all texts counts as that. So the frequent shingles alone are to be
known, their number has a bound whatever the corpus (``frequencies``), and two
texts weigh the same in a corpus of any size of equal make. A large group of
copies does not lose its members for being large. Improved consistent weighted
sampling draws ``BANDS * ROWS`` samples a text; texts that agree on all samples of
a band share a bucket.

Copies (equal word sequences) are one node. Buckets up to ``SMALL`` nodes give
their pairs. A larger bucket gives its *pivot*, the node whose buckets are
largest, paired with every other; nodes that turn out unlike the pivot are
compared with the rest of the bucket in blocks, leaving out blocks that the
triangle inequality of the Jaccard distance rules out. So no candidate is
dropped and no group is expanded into rows of pairs. Every candidate is verified
by the weighted Jaccard similarity of the whole texts; links at or above the
threshold are joined to classes by alternating stars on distributed edges.

Defined results: texts without words form no class with others; texts under five
words are one shingle; rows with a null id keep class null; repeated rows share
a class; the class id is the smallest id of the class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm import words as W
from chronolith.llm.common import chunks, texts, tune, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 8, 3
#: Counters in a row of the sketch that tells which shingles can be frequent.
WIDTH = 1 << 19
#: Shingles in less than this share of all texts weigh alike, the most.
SHARE = 0.002
#: A shingle of no text but one weighs 1 + STRENGTH, one of all texts 1.
STRENGTH = 0.5
#: Buckets up to this size give all their pairs.
SMALL = 8
#: Nodes in a block when a pivot or the rest of a bucket is compared with others, and of the side that is held in memory.
BLOCK, HELD = 1024, 256
#: Width of the bins of distance to a pivot.
BIN = 0.1
_PART = 16_384  # counters in one row of the sketch's sum
_TABLE = 1 << 16  # entries of a sample's table of random triples


@dataclass
class Weights:
    """Exact document frequencies of the frequent shingles; any other counts as if in ``share`` of all texts."""

    shingle: np.ndarray  # sorted
    df: np.ndarray
    texts: int
    share: float

    def idf(self, h: np.ndarray) -> np.ndarray:
        least = max(self.share * self.texts, 1.0)
        df = np.full(len(h), least)
        if len(self.shingle):
            at = np.minimum(np.searchsorted(self.shingle, h), len(self.shingle) - 1)
            df = np.where(self.shingle[at] == h, np.maximum(self.df[at], least), df)
        return 1 + STRENGTH * np.log(max(self.texts, 1) / df) / -np.log(self.share)


def _slot(h: np.ndarray, k: int) -> np.ndarray:
    return ((h >> W.U(8 + 28 * k)) & W.U(WIDTH - 1)).astype(np.int64)


def shingles(w: W.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: text number, hash, times. Texts of under k words are one shingle."""
    h = w.hashes()
    n = w.counts
    at = W.valid_windows(w.first, k)
    value = W.windows(h, k, 41)[at] if len(at) else np.zeros(0, W.U)
    doc = np.searchsorted(w.first, at, side="right") - 1
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        prefix, down = W.prefixes(h, 42)
        a, b = w.first[short], w.first[short + 1]
        value = np.concatenate([value, W.mix((prefix[b] - prefix[a]) * down[a], 42)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    return doc[begin], value[begin], np.diff(np.append(begin, len(value)))


def _sketch(docs: DataFrame) -> tuple[np.ndarray, int, int]:
    """Counters (2, WIDTH) of how many texts hold the shingles of each slot, the number of texts and that of their distinct shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, n, held = np.zeros((2, WIDTH), np.int32), 0, 0
        for part in chunks(batches):
            w = W.split(texts(part.column("text")))
            _, h, _ = shingles(w)
            n += int((w.counts > 0).sum())
            held += len(h)
            for k in range(2):
                total[k] += np.bincount(_slot(h, k), minlength=WIDTH).astype(np.int32)
        slot = TaskContext.get().partitionId() % 64
        parts = total.astype(np.int64).reshape(-1, _PART)
        yield pa.RecordBatch.from_arrays([pa.array([slot] * (len(parts) + 1), pa.int32()), pa.array(np.arange(-1, len(parts)), pa.int32()), pa.array([np.array([n, held]).tobytes(), *[p.tobytes() for p in parts]])], names=["slot", "part", "counts"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, np.int64) for x in rows["counts"])
        return pd.DataFrame({"slot": [0], "part": rows["part"].iloc[:1].values, "counts": [total.tobytes()]})

    schema = "slot int, part int, counts binary"
    found = docs.select("text").mapInArrow(count, schema)
    # Two steps, so that no task adds up the rows of more than a 64th of all tasks.
    for keys in (("slot", "part"), ("part",)):
        found = found.groupBy(*keys).applyInPandas(add, schema)
    got = {r.part: np.frombuffer(r.counts, np.int64) for r in found.collect()}  # 2 * WIDTH counters, whatever the corpus
    if not got:
        return np.zeros((2, WIDTH), np.int64), 0, 0
    return np.concatenate([got[i] for i in range(2 * WIDTH // _PART)]).reshape(2, WIDTH), int(got[-1][0]), int(got[-1][1])


def frequencies(docs: DataFrame) -> Weights:
    """Exact document frequencies of every shingle in at least ``share`` of all texts.

    A slot's counter never falls below the frequency of a shingle in it, so the sketch leaves out only
    shingles below the share; those that pass are counted exactly in a second pass. ``share`` is ``SHARE``,
    or more where texts are so long that the mean counter would come near it, so at most WIDTH / 4 shingles
    can reach it: the table broadcast has a bound, and weights do not change with the size of the corpus.
    """
    counters, n, held = _sketch(docs)
    share = min(max(SHARE, 4 * held / max(n, 1) / WIDTH), 0.5)
    context = docs.sparkSession.sparkContext
    often = context.broadcast((counters >= max(share * n, 2)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            _, h, _ = shingles(W.split(texts(part.column("text"))))
            hot = often.value
            h, times = np.unique(h[hot[0][_slot(h, 0)] & hot[1][_slot(h, 1)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(times)], names=["h", "n"])

    counted = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(share * n, 2))
    got = counted.toPandas()  # at most WIDTH / 4 rows
    shingle, df = got["h"].to_numpy(np.int64).view(W.U), got["n"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return Weights(shingle[order], df[order], n, share)


_RANDOM: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def _random(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r ~ Gamma(2, 1), ln c with c ~ Gamma(2, 1), and beta uniform, for each entry of sample k's table."""
    if k not in _RANDOM:
        g = np.random.Generator(np.random.PCG64(1000 + k))
        _RANDOM[k] = (g.gamma(2, 1, _TABLE).astype(np.float32), np.log(g.gamma(2, 1, _TABLE)).astype(np.float32), g.random(_TABLE).astype(np.float32))
    return _RANDOM[k]


def samples(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Improved consistent weighted sampling: numbers of the texts that have shingles, and a value per text and sample."""
    begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(doc))))
    out = np.empty((len(begin), n), W.U)
    log_w = np.log(weight).astype(np.float32)
    for k in range(n):
        r, c, beta = (t[i] for i in [(h * W.U(2 * k * 0x9E3779B97F4A7C15 + 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF | 1)) >> W.U(48)] for t in _random(k))
        t = np.floor(log_w / r + beta)
        a = c + r * (beta - t - 1)
        low = np.minimum.reduceat(a, begin) if len(begin) else a
        hit = np.flatnonzero(a == low[owner])
        hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])] if len(hit) else hit
        out[:, k] = W.mix(h[hit] + t[hit].astype(np.int64).astype(W.U) * W.U(0xC2B2AE3D27D4EB4F), k)
    return doc[begin], out


def signatures(docs: DataFrame, model) -> DataFrame:
    """doc_id, a 128-bit hash of the word sequence, and a bucket per band (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = W.split(texts(part.column("text")))
            doc, h, times = shingles(w)
            who, value = samples(doc, h, times * model.value.idf(h), BANDS * ROWS)
            band = np.zeros((len(who), BANDS), W.U)
            for b in range(BANDS):
                for r in range(ROWS):
                    band[:, b] = W.mix(band[:, b] * W.U(0x9FB21C651E98DF25) + value[:, b * ROWS + r], 50 + b)
            sizes = np.zeros(part.num_rows, np.int64)
            sizes[who] = BANDS
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.array(band.ravel().view(np.int64)))
            hashes = w.hashes()
            both = []
            for salt in (43, 44):
                prefix, down = W.prefixes(hashes, salt)
                both.append(pa.array(W.mix((prefix[w.first[1:]] - prefix[w.first[:-1]]) * down[w.first[:-1]] + w.counts.astype(W.U), salt).view(np.int64)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *both, lists], names=["doc_id", "c1", "c2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, c1 long, c2 long, bands array<long>")


def _elements(w: W.Words, model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weighted sets as plain ones: the i-th occurrence of a shingle is an element of weight idf. Text, element, weight."""
    doc, h, times = shingles(w)
    weight = model.value.idf(h)
    which = np.repeat(np.arange(len(h)), times)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return doc[which], W.mix(h[which] + nth.astype(W.U), 45), weight[which]


class _Left:
    """The left texts of a group, indexed by element, to meet one right text at a time."""

    def __init__(self, rows: list[tuple[int, np.ndarray, np.ndarray]]):
        self.nodes = [n for n, _, _ in rows]
        self.total = np.array([x.sum() for _, _, x in rows])
        owner = np.repeat(np.arange(len(rows)), [len(e) for _, e, _ in rows])
        element = np.concatenate([e for _, e, _ in rows])
        order = np.argsort(element, kind="stable")
        element = element[order]
        self.owner = owner[order]
        self.begin = np.flatnonzero(np.append(True, element[1:] != element[:-1])) if len(element) else np.zeros(0, np.int64)
        self.name = element[self.begin]
        self.size = np.diff(np.append(self.begin, len(element)))

    def similarity(self, element: np.ndarray, weight: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.name, element)
        hit = np.flatnonzero(self.name[np.minimum(at, len(self.name) - 1)] == element)
        at = at[hit]
        size = self.size[at]
        place = np.repeat(self.begin[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        both = np.bincount(self.owner[place], np.repeat(weight[hit], size), len(self.nodes))
        return both / np.maximum(self.total + weight.sum() - both, 1e-12)


def _similar(batches: Iterator[pa.RecordBatch], model, threshold: float, every: bool) -> Iterator[pa.RecordBatch]:
    """Compare left rows with right rows of each group; rows come sorted by group, left ones (HELD at most) first.

    With ``every`` all similarities of (left, right) are returned, else the links of a spanning forest of the group.
    """
    group, rows, left, root = None, [], None, {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for part in chunks(batches):
        w = W.split(texts(part.column("text")))
        doc, element, weight = _elements(w, model)
        ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
        keys = list(zip(*(part.column(c).to_pylist() for c in ("g1", "g2", "g3"))))
        out = []
        for i, (key, side, node) in enumerate(zip(keys, part.column("left").to_pylist(), part.column("node").to_pylist())):
            if key != group:
                group, rows, left, root = key, [], None, {}
            mine = element[ends[i] : ends[i + 1]], weight[ends[i] : ends[i + 1]]
            if side:
                if not rows or rows[-1][0] != node:  # a repeated row of one id
                    rows.append((node, *mine))
                continue
            left = left or _Left(rows)
            sim = left.similarity(*mine)
            for k in range(len(sim)) if every else np.flatnonzero(sim >= threshold):
                if every or find(left.nodes[k]) != find(node):
                    root[find(left.nodes[k])] = find(node)
                    out.append((left.nodes[k], node, float(sim[k])))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["a", "b", "sim"])


def _compare(rows: DataFrame, docs: DataFrame, model, threshold: float, every: bool) -> DataFrame:
    """rows: g1, g2, g3 (the group), left (bool), node (a doc_id) -> a, b, sim."""
    held = rows.hint("merge").join(docs, "node").select("g1", "g2", "g3", "left", "node", "text")
    # Candidates grow with the corpus, so both sides are dealt by node at every size.
    dealt = held.repartition("g1", "g2", "g3").sortWithinPartitions("g1", "g2", "g3", F.desc("left"), "node")
    return dealt.mapInArrow(lambda batches: _similar(batches, model, threshold, every), "a long, b long, sim double")


def links(docs: DataFrame, nodes: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """Verified links (a, b) between nodes that share a bucket; enough of them to connect all that are linked."""
    in_bucket = nodes.select("node", F.explode(F.array_distinct("bands")).alias("bucket"))
    sizes = in_bucket.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(in_bucket.join(sizes, "bucket"), "near-buckets")
    small = members.where(F.col("n") <= SMALL)
    pairs = small.alias("x").join(small.select("bucket", F.col("node").alias("other")).alias("y"), "bucket").where("node < other").select(F.col("node").alias("p"), F.col("other").alias("q"))
    large = members.where(F.col("n") > SMALL)
    fame = large.groupBy("node").agg(F.sum("n").alias("fame"))
    ranked = large.join(fame, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("fame", -F.col("node"))).alias("top")).select("bucket", (-F.col("top.col2")).alias("pivot"))
    starred = written(large.join(pivots, "bucket").where("node <> pivot"), "near-stars")
    pairs = pairs.union(starred.select(F.col("pivot"), "node")).distinct()
    pairs = written(pairs, "near-pairs")
    # Texts of candidates only, found in one merge join: their ids grow with the corpus and are never broadcast.
    wanted = members.select("node").distinct().hint("merge")
    docs = written(docs.select(F.col("doc_id").alias("node"), "text").join(wanted, "node", "left_semi"), "near-texts")
    # A pivot's partners are dealt to blocks; the pivot goes to each of them.
    blocks = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("q"), F.col("blocks"))
    right = pairs.join(blocks, "p").select(F.col("p").alias("g1"), block.alias("g2"), F.lit(0).alias("g3"), F.lit(False).alias("left"), F.col("q").alias("node"))
    left = right.select("g1", "g2", "g3").distinct().select("*", F.lit(True).alias("left"), F.col("g1").alias("node"))
    compared = written(_compare(right.unionByName(left), docs, model, threshold, True), "near-compared")
    found = compared.where(F.col("sim") >= threshold).select("a", "b")

    # What is unlike its bucket's pivot is compared with the others of the bucket, block by block.
    far = starred.join(compared.select(F.col("a").alias("pivot"), F.col("b").alias("node"), "sim"), ["pivot", "node"]).withColumn("bin", F.floor(F.round((1 - F.col("sim")) / BIN, 9)).cast("int"))
    far = written(far.select("bucket", "node", "sim", "bin"), "near-far")
    fan = far.groupBy("bucket", "bin").agg(F.count(F.lit(1)).alias("nodes"))
    spread = lambda n: F.pmod(F.xxhash64("node", F.lit(1)), F.ceil(F.col("nodes") / n)).cast("int") + F.col("bin") * 1_000_000
    placed = written(far.join(fan, ["bucket", "bin"]).withColumn("id", spread(HELD)).withColumn("id2", spread(BLOCK)), "near-placed")
    asks = placed.where(F.col("sim") < threshold).select("bucket", "bin", "id").distinct()
    answers = placed.select("bucket", F.col("bin").alias("bin2"), "id2").distinct()
    # |d(x, pivot) - d(y, pivot)| <= d(x, y): bins further apart than the threshold hold no links. Where all of both bins ask, one direction is enough.
    reach = int(np.ceil((1 - threshold) / BIN - 1e-9))
    meet = asks.join(answers, "bucket").where((F.abs(F.col("bin") - F.col("bin2")) <= reach) & ~((F.col("bin2") > reach) & (F.col("bin2") < F.col("bin"))))
    meet = written(meet.select("bucket", "id", "id2"), "near-meet")
    asking = placed.where(F.col("sim") < threshold).drop("id2").join(meet, ["bucket", "id"]).select("bucket", "id", "id2", F.lit(True).alias("left"), "node")
    answering = placed.select("bucket", "id2", "node").join(meet, ["bucket", "id2"]).select("bucket", "id", "id2", F.lit(False).alias("left"), "node")
    rest = asking.unionByName(answering).select(F.col("bucket").alias("g1"), F.col("id").alias("g2"), F.col("id2").alias("g3"), "left", "node")
    more = _compare(rest, docs, model, threshold, False).where("a <> b").select("a", "b")
    return found.union(more)


def components(edges: DataFrame) -> DataFrame:
    """node -> root, the smallest node it is connected to, by alternating large and small stars."""
    edges = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    seen = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "near-edges")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id for every row."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(frequencies(docs))
    signed = written(signatures(docs, model), "near-signatures")
    nodes = signed.where("doc_id is not null and size(bands) > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    nodes = written(nodes, "near-nodes")
    roots = components(links(docs, nodes, model, threshold))
    named = nodes.select("c1", "c2", "node").join(roots, "node", "left").select("c1", "c2", F.coalesce("root", "node").alias("class_id"))
    rows = signed.select("doc_id", "c1", "c2", (F.size("bands") > 0).alias("some")).join(named, ["c1", "c2"], "left")
    return rows.select("doc_id", F.when(F.col("doc_id").isNull(), None).when(F.col("some"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, that of its smallest id; rows with a null id all stay."""
    found = written(classes(docs, threshold), "near-classes")
    keep = found.where("doc_id = class_id").select("doc_id").distinct().hint("merge")  # as many as documents, so never broadcast
    kept = docs.join(keep, "doc_id", "left_semi")
    if found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text (never its label, language, source or id) are binned
by quantiles of the training sample; trees grow on histograms of gradients,
level by level, with logistic loss. The forest is flattened into arrays of
feature, threshold and children, walked for all rows and trees at once.

Fitting uses at most ``SAMPLE`` labelled rows, those of lowest hash, which is
the documented bound on what reaches the driver; scoring covers every row.

Defined results: null and empty texts have all statistics 0 and get a score;
unlabelled corpora (no training rows) score the constant 0.5; repeated label
rows each count; null labels and ids don't train.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm import words as W
from chronolith.llm.common import chunks, texts, tune

#: Most labelled rows that a fit reads.
SAMPLE = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.12
L2 = 2.0
#: A document is predicted good from this score on.
CUT = 0.3

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>!@^~_={}[]+/\\"]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:?"]] = True

FEATURES = (
    "log_words", "mean_word", "sd_word", "alpha", "upper", "digit", "symbol", "punct", "bars", "bangs", "newline", "distinct_words", "top_word",
    "repeat_pair", "repeat_triple", "same_next", "words_per_line", "distinct_lines", "short_words", "long_words", "word_end_symbol", "upper_words",
)


def statistics(column: pa.Array) -> np.ndarray:
    """Statistics of each text, one row per text and one column per name in FEATURES."""
    w = W.split(column)
    n, docs = w.counts, len(column)
    size = np.diff(w.text)
    at = w.text[:-1]

    def share(mask: np.ndarray, by: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[w.text[1:]] - c[at]) / np.maximum(by, 1)

    def per_word(values: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
        return (c[w.first[1:]] - c[w.first[:-1]]) / np.maximum(n, 1)

    length = (w.end - w.start).astype(np.float64)
    mean = per_word(length)
    h = w.hashes()
    doc = np.repeat(np.arange(docs), n)

    def distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: how many distinct values, the count of the most frequent, the number with a repeated value."""
        order = np.lexsort((values, owner))
        v, o = values[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        begin = np.flatnonzero(new)
        count = np.diff(np.append(begin, len(v)))
        top = np.zeros(docs)
        np.maximum.at(top, o[begin], count)
        return np.bincount(o[begin], minlength=docs), top, np.bincount(o[begin], weights=np.where(count > 1, count, 0), minlength=docs)

    words, top, _ = distinct(h, doc)
    pair, triple = W.windows(h, 2, 11), W.windows(h, 3, 12)
    two, three = W.valid_windows(w.first, 2), W.valid_windows(w.first, 3)
    _, _, pairs = distinct(pair[two], doc[two]) if len(two) else (0, 0, np.zeros(docs))
    _, _, triples = distinct(triple[three], doc[three]) if len(three) else (0, 0, np.zeros(docs))
    same = np.bincount(doc[two], weights=h[two] == h[two + 1], minlength=docs) if len(two) else np.zeros(docs)
    newline = w.data == 10
    lines = share(newline, np.ones(docs)) + 1
    first_of_line = np.zeros(len(h), bool)
    if len(h):
        c = np.cumsum(newline)
        first_of_line[0] = True
        first_of_line[1:] = c[w.start[1:]] != c[w.start[:-1]]
        first_of_line[w.first[:-1][n > 0]] = True
    starts = np.flatnonzero(first_of_line)
    line_hash = np.zeros(0, W.U)
    if len(starts):
        prefix, down = W.prefixes(h, 13)
        ends = np.append(starts[1:], len(h))
        line_hash = W.mix((prefix[ends] - prefix[starts]) * down[starts], 13)
    many = np.bincount(doc[starts], minlength=docs)
    lines_distinct = distinct(line_hash, doc[starts])[0] if len(starts) else np.zeros(docs)
    last = w.data[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    upper = np.concatenate([[0], np.cumsum(_UPPER[w.data])])
    all_upper = (upper[w.end] - upper[w.start]) * 2 > length
    per = np.maximum(n, 1)
    return np.column_stack(
        [
            np.log1p(n), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), share(_ALPHA[w.data] | (w.data >= 128), size), share(_UPPER[w.data], size), share(_DIGIT[w.data], size), share(_SYMBOL[w.data], size),
            share(_PUNCT[w.data], size), share(w.data == ord("|"), size), share(w.data == ord("!"), size), share(newline, size), words / per, top / per, pairs / per, triples / per, same / per, n / lines,
            lines_distinct / np.maximum(many, 1), per_word(length <= 2), per_word(length >= 12), per_word(_SYMBOL[last]), per_word(all_upper),
        ]
    )


@dataclass
class Forest:
    """Flat trees: node i of a tree goes to left[i] or left[i] + 1; a leaf points to itself."""

    feature: np.ndarray  # (trees, nodes) int
    threshold: np.ndarray  # (trees, nodes) float
    left: np.ndarray  # (trees, nodes) int
    value: np.ndarray  # (trees, nodes) float
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.feature)), dtype=np.int64)
        for _ in range(self.depth):
            f = self.feature[tree, node]
            go = self.left[tree, node] + (x[row, np.maximum(f, 0)] > self.threshold[tree, node])
            node = np.where(f < 0, node, go)
        total += self.value[tree, node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = 20) -> Forest:
    """Boost logistic loss with trees grown level by level on histograms."""
    nodes = 2 ** (depth + 1) - 1
    feature = np.full((trees, nodes), -1)
    threshold, value, left = np.zeros((trees, nodes)), np.zeros((trees, nodes)), np.zeros((trees, nodes), dtype=np.int64)
    if not len(y) or y.min() == y.max():
        level = 0.5 if not len(y) else (y.sum() + 1) / (len(y) + 2)
        return Forest(feature, threshold, left, value, float(np.log(level / (1 - level))), depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw = np.full(len(y), base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        at = 1
        for level in range(depth):
            for k in np.unique(node):
                if level and left[t, k]:
                    continue
                rows = np.flatnonzero(node == k)
                best = (1e-6, -1, 0)
                gs, hs = g[rows].sum(), h[rows].sum()
                for j, e in enumerate(edges):
                    if not len(e) or len(rows) < 2 * least:
                        continue
                    b = binned[rows, j]
                    n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gl, hl = np.cumsum(np.bincount(b, g[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(b, h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + L2) + (gs - gl) ** 2 / (hs - hl + L2) - gs**2 / (hs + L2)
                    gain[(n < least) | (len(rows) - n < least)] = 0
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, i)
                if best[1] >= 0:
                    feature[t, k], threshold[t, k], left[t, k] = best[1], edges[best[1]][best[2]], at
                    node[rows] = at + (binned[rows, best[1]] > best[2])
                    at += 2
        total_g, total_h = np.bincount(node, g, nodes), np.bincount(node, h, nodes)
        value[t] = rate * total_g / (total_h + L2)
        raw += value[t][node]
    return Forest(feature, threshold, left, value, base, depth)


def _stats_udf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches):
        x = statistics(texts(part.column("text")))
        yield pa.RecordBatch.from_arrays([part.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["quality", "x"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Fit on at most ``sample`` labelled documents, none held out (crc32 of the id as text, mod 5, is 0)."""
    tune(docs.sparkSession)
    chosen = labels.where("quality in (0, 1) and doc_id is not null and crc32(cast(doc_id as string)) % 5 <> 0").select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(sample)  # the bound that lets it be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(_stats_udf, "quality int, x array<double>").collect()
    # The order of rows differs between runs and would move float sums; a sort makes the forest repeatable.
    rows = sorted((tuple(r.x), r.quality) for r in rows)
    return fit(np.array([x for x, _ in rows]).reshape(-1, len(FEATURES)), np.array([q for _, q in rows], dtype=float))


def scored(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest)  # a few hundred KB, fixed by TREES and DEPTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            s = model.value.score(statistics(texts(part.column("text"))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.expr("crc32(cast(doc_id as string)) % 5 = 0").alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, forest: Forest, cut: float = CUT) -> DataFrame:
    """The documents with a score of at least ``cut``, all columns as they were."""
    tune(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            yield part.filter(pa.array(model.value.score(statistics(texts(part.column("text")))) >= cut))

    return docs.mapInArrow(run, docs.schema)

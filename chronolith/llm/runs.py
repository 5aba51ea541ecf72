"""Periodic runs of words by harmonic grid probing.

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` long,
that no neighbour extends. For a period p the grid is the word numbers 0, p, 2p, ...
of a document. A run of period p covers four grid points in a row, so words that are
equal at jp and (j+1)p three times running name a candidate; the grids of all periods
hold n (1 + 1/2 + 1/3 + ...) points. Survivors are extended to both sides by comparing
chunks of growing length. Periods go upwards, and four grid points inside one found run
are skipped: what they could start has a shorter period. Grids of a batch of documents
are probed together, in blocks of bounded size, so that a long document needs no more
memory than its words and one block.

Words are compared by dictionary codes, not by hashes.

Defined results: a null or empty text has no words and no runs; repeated rows each give
a row; a null id counts as no edit (see ``edited``); other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.llm import words as W
from chronolith.llm.common import chunks, texts, tune

#: A run repeats its period so often at least, and is so long at least.
REPEATS, LEAST = 4, 6
#: Grid points that are probed in one block.
BLOCK = 2_000_000
#: Words that are compared at once before a survivor is extended, and the first chunk of the extension.
AHEAD, CHUNK = 16, 64

_OUT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"


def _matching(a: np.ndarray, b: np.ndarray) -> int:
    """Number of equal words at the front of two stretches of one length, chunk by chunk."""
    at, step = 0, CHUNK
    while at < len(a):
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, min(2 * step, 1 << 16)
    return len(a)


def _grids(n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (document, period, grid number j) in order of period, j with four grid points from jp on inside the document."""
    order = np.argsort(-n, kind="stable")
    sizes = n[order]
    period, last = 1, int(sizes[0]) // REPEATS if len(n) else 0
    while period <= last:
        # So many periods that the block holds its share: documents shorter than four periods have no grid.
        docs, periods, points = [], [], 0
        while period <= last and (not points or points < BLOCK):
            live = int(np.searchsorted(-sizes, -REPEATS * period, side="right"))
            docs.append(order[:live])
            periods.append(np.full(live, period))
            points += int(((sizes[:live] - 1) // period - 2).sum())
            period += 1
        doc, per = np.concatenate(docs), np.concatenate(periods)
        count = (n[doc] - 1) // per - 2
        first = np.cumsum(count) - count
        for a in range(0, points, BLOCK):  # one short period of a long document may be more than a block
            b = min(a + BLOCK, points)
            lo, hi = int(np.searchsorted(first, a, side="right")) - 1, int(np.searchsorted(first, b, side="left"))
            begin, end = np.maximum(first[lo:hi], a), np.minimum(first[lo:hi] + count[lo:hi], b)
            take = np.maximum(end - begin, 0)
            which = np.repeat(np.arange(lo, hi), take)
            j = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take) + np.repeat(begin - first[lo:hi], take)
            yield doc[which], per[which], j


def find(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Runs of several documents: rows (document, start, length, period), starts within the document.

    codes: word codes of all documents; first: index of each document's first word, one more at the end.
    """
    n = np.diff(first)
    reach = np.zeros(len(codes), np.int64)  # end of the furthest found run that covers a word
    found: list[tuple[int, int, int, int]] = []
    for doc, p, j in _grids(n):
        x = first[doc] + j * p
        at = np.flatnonzero(codes[x] == codes[x + p])
        for k in (1, 2):
            at = at[codes[x[at] + k * p[at]] == codes[x[at] + (k + 1) * p[at]]]
        for k in range(1, AHEAD):  # all words from the first to the third grid point have their like one period on
            step = np.minimum(k, 2 * p[at])
            at = at[codes[x[at] + step] == codes[x[at] + step + p[at]]]
        if not len(at):
            continue
        at = at[np.lexsort((x[at], p[at]))]
        ends = np.append(np.flatnonzero(np.diff(p[at])) + 1, len(at))
        begin = 0
        for end in ends.tolist():
            q = int(p[at[begin]])
            rest = at[begin:end]
            begin = end
            rest = rest[reach[x[rest]] <= x[rest] + 3 * q]
            while len(rest):
                here, d = int(x[rest[0]]), int(doc[rest[0]])
                lo, hi = int(first[d]), int(first[d + 1])
                right = here + _matching(codes[here : hi - q], codes[here + q : hi]) + q
                if right <= here + 3 * q:  # the grid points alone are equal; a run has four of its own
                    rest = rest[1:]
                    continue
                left = here - _matching(codes[lo:here][::-1], codes[lo + q : here + q][::-1])
                if right - left >= max(LEAST, REPEATS * q):
                    found.append((d, left - lo, right - left, q))
                    np.maximum(reach[left:right], right, out=reach[left:right])
                    rest = rest[reach[x[rest]] <= x[rest] + 3 * q]
                else:
                    rest = rest[1:]
    out = np.array(sorted(found), dtype=np.int64).reshape(-1, 4)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def dropped(runs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which words lie in a run after its first period."""
    edge = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(edge, first[runs[:, 0]] + runs[:, 1] + runs[:, 3], 1)
    np.add.at(edge, first[runs[:, 0]] + runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(edge[:-1]) > 0


def edited(first: np.ndarray, ids: list[int | None]) -> np.ndarray:
    """Index of the word that stands at each place once a tenth of the documents, by id, repeat a part of their own to the end."""
    at = np.arange(int(first[-1]))
    for k, i in enumerate(ids):
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        n = int(first[k + 1] - first[k])
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            at[first[k] + a : first[k + 1]] = first[k] + a + np.arange(n - a) % p
    return at


def periodic_runs(docs: DataFrame, edit: bool = False) -> DataFrame:
    """Per document: number of runs, the longest (ties: smallest start, then period), digests of all runs and of the words kept, counts.

    edit: repeat a part of every tenth document first (see ``edited``), which plants long runs.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, limit=2_000_000):
            ids = part.column("doc_id").cast(pa.int64()).to_pylist()
            w = W.split(texts(part.column("text")))
            codes, distinct = W.coded(w)
            first = w.first.astype(np.int64)
            if edit:
                codes = codes[edited(first, ids)]
            runs = find(codes, first)
            keep = ~dropped(runs, first)
            held = distinct.to_pylist()
            own = np.searchsorted(runs[:, 0], np.arange(len(ids) + 1))
            rows = []
            for k, i in enumerate(ids):
                mine = runs[own[k] : own[k + 1], 1:]
                a, b = int(first[k]), int(first[k + 1])
                best = min(mine.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in mine.tolist())
                body = b" ".join([held[c] for c in codes[a:b][keep[a:b]].tolist()])
                rows.append((i, len(mine), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(body).hexdigest(), b - a, b - a - int(keep[a:b].sum())))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split(" ")[0] for f in _OUT.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, _OUT)

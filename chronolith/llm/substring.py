"""Substring dedup by relative Lempel-Ziv parsing of every document against the indexed corpus.

The corpus is its own reference, cut into blocks by content: each window of
``length`` words is anchored by the smallest hash among its ``GRAM``-word pieces,
so equal windows have equal anchors wherever they stand, and the anchor names the
block that indexes it. A document's windows fall into *phrases*, runs of
consecutive windows with one anchor, about twenty windows each. So a document
meets every block that can hold a factor of ``length`` words, and no other.

1. *Copies.* A phrase that stands as a whole in a document of smaller id (by a
   128-bit hash of anchor and words) is a factor as it is. Most repeats stop here.
2. *Parsing.* Where a block holds different phrases, their words meet in it in order
   of id. The block's windows of smaller ids are its index; from a place whose
   window is indexed, a factor is extended greedily, word by word, against the
   indexed place until the words differ or one of the texts ends. Factors of
   ``length`` words and more are duplicate spans.
3. *Boundaries.* Parsing goes on with the first window that reaches over a factor's
   end, so no match that straddles two factors is lost.

A block with more than ``BLOCK`` different phrases is cut finer: each of its windows
goes to the block of that window's own hash. Blocks are parsed as a stream, which
keeps only texts that added to the index. Neighbouring factors join to spans;
words under a span are removed.

Defined results: null text has no words; a null id neither gives nor loses
words; rows with equal ids don't remove from each other, whatever their texts;
repeated rows each get a row with the same result; texts under ``length`` words
stay whole; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm import words as W
from chronolith.llm.common import chunks, texts, tune, written

LENGTH = 50
GRAM = 8
#: Different phrases up to which an anchor is one block.
BLOCK = 8192


def _phrases(w: W.Words, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Phrases of a chunk: text number, first window (word in text), windows, anchor, hash of all words under it."""
    h = W.strong(w)
    at = W.valid_windows(w.first, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(W.U), none.astype(W.U)
    anchor = W.sliding_min(W.windows(h, gram, 21), length - gram + 1)[at]
    doc = np.searchsorted(w.first, at, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(at)))
    first = at[begin]
    prefix, down = W.prefixes(h, 22)
    whole = W.mix((prefix[first + count + length - 1] - prefix[first]) * down[first], 22)
    return doc[begin], first - w.first[doc[begin]], count, anchor[begin], whole


def _once(doc: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray, whole: np.ndarray) -> tuple:
    """Each text's distinct phrases by their first place, and the list of their further places."""
    order = np.lexsort((start, whole, anchor, doc))
    same = np.zeros(len(order), bool)
    if len(order):
        d, a, p = doc[order], anchor[order], whole[order]
        same[1:] = (d[1:] == d[:-1]) & (a[1:] == a[:-1]) & (p[1:] == p[:-1])
    first = order[~same]
    ends = np.append(np.flatnonzero(~same), len(order))
    offsets = np.concatenate([[0], np.cumsum(np.diff(ends) - 1)]).astype(np.int32)
    again = pa.ListArray.from_arrays(offsets, pa.array(start[order][same].astype(np.int32)))
    return doc[first], start[first], n[first], anchor[first], whole[first], again


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key, text; the key is a hash of the text and tells rows of equal id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def phrases(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """anchor, phrase, doc_id, key, start (word of the first window), n (windows), again (starts of repeats in the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = W.split(texts(part.column("text")))
            doc, start, n, anchor, whole, again = _once(*_phrases(w, length, gram))
            ids, keys = (part.column(c).cast(pa.int64()).take(pa.array(doc)) for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays([_signed(anchor), _signed(whole), ids, keys, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), again], names=["anchor", "phrase", "doc_id", "key", "start", "n", "again"])

    return keyed(docs).where("doc_id is not null").mapInArrow(run, "anchor long, phrase long, doc_id long, key long, start int, n int, again array<int>")


_SEGMENT = "block long, doc_id long, key long, start int, again array<int>, words string"


def _segments(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """The words of each phrase asked for; the windows one by one where the anchor has more than ``most`` phrases."""
    for part in chunks(batches):
        w = W.split(texts(part.column("text")))
        body, start, end = w.data.tobytes(), w.start, w.end
        names = W.windows(W.strong(w), length, 31).view(np.int64)
        ids, keys = part.column("doc_id").to_pylist(), part.column("key").to_pylist()
        out: list[tuple] = []
        size = 0
        for i, asked in enumerate(part.column("asked").to_pylist()):
            first = int(w.first[i])
            for x in asked:
                pieces = [(x["anchor"], 0, x["n"])] if x["kinds"] <= most else [(int(names[first + x["start"] + k]), k, 1) for k in range(x["n"])]
                for block, k, n in pieces:
                    at = first + x["start"] + k
                    last = at + n + length - 2
                    # Words as they stand, joined by one space.
                    words = b" ".join([body[a:b] for a, b in zip(start[at : last + 1].tolist(), end[at : last + 1].tolist())])
                    out.append((block, ids[i], keys[i], x["start"] + k, [y + k for y in x["again"]], words.decode("utf-8")))
                    size += len(words)
                if size > 2_000_000:
                    yield _rows(out)
                    out, size = [], 0
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"block": pa.int64(), "doc_id": pa.int64(), "key": pa.int64(), "start": pa.int32(), "again": pa.list_(pa.int32()), "words": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds.values())], names=list(kinds))


def _common(w: W.Words, i: int, r: int, a: int, b: int) -> int:
    """Number of equal words from word i of text a and word r of text b on."""
    x = w.data[w.start[i] : w.text[a + 1]]
    y = w.data[w.start[r] : w.text[b + 1]]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    same = int(differ[0]) if len(differ) else n
    # Words of x that end within the equal bytes; one that ends with them must end in y as well.
    k = int(np.searchsorted(w.end, w.start[i] + same, side="right")) - i
    if k > 0 and int(w.end[i + k - 1] - w.start[i]) == same and same < len(y) and y[same] != 0x20:
        k -= 1
    return min(k, int(w.first[a + 1]) - i)


def factors(words: pa.Array, block: np.ndarray, doc: np.ndarray, length: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Factors (text, first window, windows) of texts sorted by block and id, and which texts add to the index."""
    w = W.split(words)
    at = W.valid_windows(w.first, length)
    text = np.searchsorted(w.first, at, side="right") - 1
    name = W.mix(W.windows(W.strong(w), length, 31)[at] + W.mix(block[text].view(W.U), 33), 34)
    order = np.lexsort((at, name))  # texts stand in order of id, so the first place of a window has the smallest id
    new = np.append(True, name[order][1:] != name[order][:-1]) if len(order) else np.zeros(0, bool)
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    known = np.flatnonzero(doc[text] > doc[text[first]])
    adds = np.zeros(len(words), bool)
    adds[text[np.setdiff1d(np.arange(len(at)), known, assume_unique=True)]] = True
    out, places, owner, refs = [], at[known], text[known], first[known]
    j = 0
    while j < len(known):
        i, a = int(places[j]), int(owner[j])
        n = _common(w, i, int(at[refs[j]]), a, int(text[refs[j]]))
        if n < length:  # equal hashes of different words
            adds[a] = True
            j += 1
            continue
        out.append((a, i - int(w.first[a]), n - length + 1))
        j = int(np.searchsorted(places, i + n - length + 1))
    return out, adds


def _parsed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Parse blocks as they come, sorted by block and id; a block that goes on keeps the texts of its index."""
    held: list[pa.Table] = []
    old = size = 0  # rows that are parsed already and serve as index, bytes held

    def parse(table: pa.Table, old: int) -> tuple[pa.RecordBatch, np.ndarray]:
        table = table.combine_chunks()
        block, doc, key, start = (table.column(c).to_numpy() for c in ("block", "doc_id", "key", "start"))
        found, adds = factors(table.column("words").combine_chunks() if isinstance(table.column("words"), pa.ChunkedArray) else table.column("words"), block, doc, length)
        rows: list[tuple[int, int, int, int]] = []
        again = table.column("again")
        for t, k, n in found:
            if t >= old:
                rows += [(int(doc[t]), int(key[t]), s + k, n) for s in [int(start[t]), *(again[t].as_py() or ())]]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "key", "start", "n"]), adds

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        size += batch.nbytes
        if size >= 4_000_000:
            table = pa.concat_tables(held)
            out, adds = parse(table, old)
            yield out
            block = table.column("block").to_numpy()
            keep = table.filter(pa.array(adds & (block == block[-1])))
            held, old, size = [keep], keep.num_rows, 0
    if held:
        yield parse(pa.concat_tables(held), old)[0]


def spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = BLOCK) -> DataFrame:
    """doc_id, key -> spans, an array of (start, n): windows start .. start + n - 1 are duplicates of a smaller id."""
    tune(docs.sparkSession)
    rows = written(phrases(docs, length, gram), "substring-phrases")
    # One entry per distinct phrase with its smallest id, and the number of phrases of its anchor.
    index = written(rows.groupBy("anchor", "phrase").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")), "substring-index")
    mixed = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("least").alias("low"), F.max("least").alias("high")).where("kinds > 1 and high > low").select("anchor", "kinds")
    known = index.join(mixed, "anchor", "left").where("last > least or kinds is not null").select("anchor", "phrase", "least", F.coalesce("kinds", F.lit(0)).alias("kinds"))
    met = written(rows.join(known, ["anchor", "phrase"]).where("doc_id > least or kinds > 0"), "substring-met")
    copies = met.where("doc_id > least").select("doc_id", "key", F.explode(F.concat(F.array("start"), "again")).alias("start"), "n")
    # Smallest ids of a phrase, of which there may be several rows, may share windows with other phrases of the block.
    asked = met.where("doc_id = least").groupBy("doc_id", "key").agg(F.collect_list(F.struct("anchor", "kinds", "start", "n", "again")).alias("asked"))
    segments = keyed(docs).join(asked, ["doc_id", "key"]).mapInArrow(lambda b: _segments(b, length, most), _SEGMENT)
    dealt = segments.repartition("block").sortWithinPartitions("block", "doc_id")
    parsed = dealt.mapInArrow(lambda b: _parsed(b, length), "doc_id long, key long, start int, n int")
    return copies.unionByName(parsed).groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def _kept(count: int, found: list, length: int) -> np.ndarray:
    """Which of ``count`` words stay."""
    edge = np.zeros(count + 1, np.int64)
    if found:
        a = np.array([x["start"] for x in found])
        b = a + np.array([x["n"] for x in found]) + length - 1
        if (b > count).any():
            raise ValueError("a span ends beyond its text")
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
    return np.cumsum(edge)[:count] == 0


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and with ``text`` the kept words joined by one space."""
    found = spans(docs, length, gram)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            w = W.split(texts(part.column("text")))
            body = w.data.tobytes()
            kept, n = [], []
            for i, f in enumerate(part.column("spans").to_pylist()):
                stay = np.flatnonzero(_kept(int(w.counts[i]), f or [], length)) + w.first[i]
                n.append(len(stay))
                kept.append(b" ".join([body[a:b] for a, b in zip(w.start[stay].tolist(), w.end[stay].tolist())]))
            cols = [part.column("doc_id").cast(pa.int64()), pa.array(w.counts.astype(np.int64)), pa.array(w.counts - np.array(n, dtype=np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays(cols + [pa.array([k.decode("utf-8") for k in kept])] * text, names=["doc_id", "n_words", "n_removed", "kept_sha256", *["text"] * text])

    return keyed(docs).join(found, ["doc_id", "key"], "left").mapInArrow(run, schema)

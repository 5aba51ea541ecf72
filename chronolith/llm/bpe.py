"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

Every distinct pre-token of a partition becomes rows (word, position, token),
one per byte. A recursive query joins neighbouring rows with the merge table and
contracts each word's leftmost pair of minimum rank until no pair is left; an
ordered aggregation yields the ids. A document's ids are its pre-tokens' ids in
order. Decoding takes nothing but the ids: rows (document, position, token) join
the vocabulary and their bytes are aggregated in order of position.

Memory is bounded: words go to DuckDB in lots of bounded recursion size, and the
word cache of a worker drops what was not used among the last ``CACHE_WORDS`` new words.

Defined results: a null or empty text has no tokens; repeated rows each give a
row; other columns pass through untouched unless they clash with the outputs,
which then win.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronolith.llm.common import chunks, texts, tune
from chronolith.llm.pretokens import Splitter

#: Words of one generation of the cache; two generations are kept in one Python worker.
CACHE_WORDS = 400_000
#: Rows that one recursive query may hold over all its steps.
LOT_ROWS = 1_200_000
#: Longer words are cut into overlapping windows; a window longer than this keeps only its current rows (keyed recursion).
LONG_BYTES = 200
#: Bytes in the first windows of a long word.
WINDOW = 64

#: Rows carry one key, word << 20 | position; ``rank << 20 | position`` finds the leftmost pair of minimum rank.
_ALL_STEPS = """
WITH RECURSIVE state(step, k, tok) AS (
    SELECT 0::INTEGER, (w << 20) + pos, tok FROM start
  UNION ALL
    (WITH p AS MATERIALIZED (SELECT step, k, tok, (tok << 20) + lead(tok) OVER o AS ab, lead(k) OVER o AS nk FROM state WINDOW o AS (ORDER BY k)),
    j AS MATERIALIZED (SELECT p.k, p.nk, m.rank, m.new, m.bulk FROM p JOIN merges m ON m.ab = p.ab WHERE p.k >> 20 = p.nk >> 20),
    b AS MATERIALIZED (SELECT k >> 20 AS w, min((rank << 20) + (k & 1048575)) AS best FROM j GROUP BY 1),
    h AS MATERIALIZED (SELECT j.k, j.nk, j.new FROM j JOIN b ON b.w = j.k >> 20 WHERE j.rank = b.best >> 20 AND (j.bulk OR (j.k & 1048575) = (b.best & 1048575)))
    SELECT p.step + 1, p.k, coalesce(h.new, p.tok)
    FROM p SEMI JOIN b ON b.w = p.k >> 20 LEFT JOIN h ON h.k = p.k ANTI JOIN h g ON g.nk = p.k)
)
SELECT s.k >> 20 AS w, list(s.tok ORDER BY s.k) AS ids
FROM state s JOIN (SELECT k >> 20 AS w, max(step) AS last FROM state GROUP BY 1) m ON m.w = s.k >> 20 AND m.last = s.step GROUP BY 1
"""

#: The same contraction, where a row replaces its forerunner and -1 marks a position that is gone.
_KEYED = """
WITH RECURSIVE state(w, pos, tok) USING KEY (w, pos) AS (
    SELECT w, pos, tok FROM start
  UNION
    SELECT w, unnest([pos, npos]) AS pos, unnest([new, -1]) AS tok
    FROM (SELECT p.*, m.rank, m.new, m.bulk, min(m.rank * 4294967296 + p.pos) OVER (PARTITION BY w) AS best
          FROM (SELECT w, pos, tok, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, lead(pos) OVER (PARTITION BY w ORDER BY pos) AS npos
                FROM recurring.state WHERE tok >= 0) p
          JOIN merges m ON m.a = p.tok AND m.b = p.nxt)
    WHERE rank = best // 4294967296 AND (bulk OR pos = best % 4294967296)
)
SELECT s.w, list(s.tok ORDER BY s.pos) AS ids FROM state s WHERE s.tok >= 0 GROUP BY 1
"""

_DECODE = "SELECT row, list(v.bytes ORDER BY pos) AS parts FROM coded JOIN vocab v USING (tok) GROUP BY row"


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken-style file: base64 bytes and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Codec:
    """Encoder and decoder of one rank file, with its own in-memory DuckDB."""

    def __init__(self, path: str, pattern: str):
        import duckdb

        self.ranks = load_ranks(path)
        self.splitter = Splitter(pattern, self._kind(pattern))
        self.bytes_id = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False})
        rows = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        a, b, rank = (np.array(x, dtype=np.int64) for x in zip(*rows))
        low = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, a, rank)
        np.minimum.at(low, b, rank)
        # All occurrences of a pair may go in one step if they can't overlap and what they make starts no earlier pair.
        merges = pa.table({"a": a, "b": b, "ab": (a << 20) + b, "rank": rank, "new": rank, "bulk": (a != b) & (low[rank] > rank)})  # noqa: F841
        vocab = pa.table({"tok": pa.array(list(self.ranks.values()), pa.int64()), "bytes": pa.array(list(self.ranks), pa.binary())})  # noqa: F841
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges; CREATE TABLE vocab AS SELECT * FROM vocab")
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.vocab = {r: t for t, r in self.ranks.items()}
        self.lengths = np.zeros(max(self.vocab) + 1, np.int64)
        self.lengths[list(self.vocab)] = [len(t) for t in self.vocab.values()]

    @staticmethod
    def _kind(pattern: str):
        """Class of a character by the library: a byte pair that merges only inside one pre-token tells."""
        import tiktoken

        one = {bytes([i]): i for i in range(256)}
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=one | {bytes([x, f]): 256 + 256 * k + f for k, x in enumerate(b"a1") for f in range(256)}, special_tokens={})
        return lambda c: "L" if len(probe.encode_ordinary("a" + c)) <= len(c.encode()) else "N" if len(probe.encode_ordinary("1" + c)) <= len(c.encode()) else "O"

    def _lots(self, words: list[bytes]) -> Iterator[tuple[str, list[int]]]:
        """Numbers of words whose recursion holds a bounded number of rows, with the query for them."""
        lot, rows = [], 0
        for i in sorted(range(len(words)), key=lambda i: len(words[i])):
            n = len(words[i])
            cost = 1 if words[i] in self.ranks else n * n if n <= LONG_BYTES else n
            if lot and (rows + cost > LOT_ROWS or (n > LONG_BYTES) != (len(words[lot[0]]) > LONG_BYTES)):
                yield (_KEYED if len(words[lot[0]]) > LONG_BYTES else _ALL_STEPS), lot
                lot, rows = [], 0
            lot.append(i)
            rows += cost
        if lot:
            yield (_KEYED if len(words[lot[0]]) > LONG_BYTES else _ALL_STEPS), lot

    def _contract(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as little-endian uint32, by recursion over its bytes."""
        done: list[bytes] = [b""] * len(words)
        for query, lot in self._lots(words):
            whole = np.array([self.ranks.get(words[i], -1) for i in lot])  # a word that is a token as a whole starts as that one row
            size = np.where(whole >= 0, 1, [len(words[i]) for i in lot])
            first = np.cumsum(size) - size
            tok = np.empty(size.sum(), np.int64)
            tok[first[whole >= 0]] = whole[whole >= 0]
            tok[np.repeat(whole < 0, size)] = self.bytes_id[np.frombuffer(b"".join([words[lot[k]] for k in np.flatnonzero(whole < 0).tolist()]), dtype=np.uint8)]
            start = pa.table({"w": np.repeat(np.arange(len(lot)), size), "pos": np.arange(size.sum()) - np.repeat(first, size), "tok": tok})  # noqa: F841
            for part in self.con.sql(query).to_arrow_table().combine_chunks().to_batches():
                ids = part.column("ids")
                at, numbers = ids.offsets.to_numpy(), ids.values.to_numpy().astype("<u4").tobytes()
                for w, a, b in zip(part.column("w").to_pylist(), (4 * at[:-1]).tolist(), (4 * at[1:]).tolist()):
                    done[lot[w]] = numbers[a:b]
        return done

    def _joined(self, word: bytes, starts: range, windows: dict[bytes, bytes], width: int) -> tuple[list[int], list[tuple[int, int]]] | None:
        """Ids of a long word from those of its overlapping windows, cut where two windows have a token end in common."""
        ids: list[int] = []
        seams: list[tuple[int, int]] = []
        begin, mine = 0, np.frombuffer(windows[word[:width]], "<u4")
        ends = np.cumsum(self.lengths[mine])
        for s in starts[1:]:
            other = np.frombuffer(windows[word[s : s + width]], "<u4")
            theirs = s + np.cumsum(self.lengths[other])
            both = np.intersect1d(ends, np.append(theirs, s), assume_unique=True)
            both = both[both > begin]
            if not len(both):
                return None
            cut = both[np.abs(both - (s + width // 4)).argmin()]
            keep = mine[(ends > begin) & (ends <= cut)]
            rest = other[theirs > cut]
            ids += keep.tolist()
            if len(rest):
                seams.append((int(keep[-1]), int(rest[0])))
            begin, mine, ends = int(cut), other, theirs
        return ids + mine[ends > begin].tolist(), seams

    def _long(self, words: list[bytes]) -> list[bytes]:
        """Ids of long words in time linear in their length.

        A sequence of tokens is the encoding of its bytes exactly if each neighbouring pair is the
        encoding of that pair's bytes. Windows are encoded by the recursion, so pairs inside them hold;
        the pairs at the seams are encoded to see. A word with a seam that doesn't hold, or windows
        without a token end in common, is tried again with wider windows, at last as a whole.
        """
        done: list[bytes] = [b""] * len(words)
        todo, width = list(range(len(words))), WINDOW
        while todo:
            starts = {i: range(0, max(len(words[i]) - width // 2, 1), width // 2) for i in todo}
            distinct = list({words[i][s : s + width] for i in todo for s in starts[i]})
            windows = dict(zip(distinct, self._contract(distinct)))
            joined = {i: self._joined(words[i], starts[i], windows, width) for i in todo}
            pairs = list({p for x in joined.values() if x for p in x[1]})
            held = dict(zip(pairs, self._contract([self.vocab[a] + self.vocab[b] for a, b in pairs])))
            again = []
            for i in todo:
                if joined[i] and all(held[p] == np.array(p, "<u4").tobytes() for p in joined[i][1]):
                    done[i] = np.array(joined[i][0], "<u4").tobytes()
                else:
                    again.append(i)
            todo, width = again, 4 * width
        return done

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian uint32."""
        words = list(words)
        held = [w.encode("utf-8") for w in words]
        short = [i for i, w in enumerate(held) if len(w) <= LONG_BYTES]
        long = [i for i, w in enumerate(held) if len(w) > LONG_BYTES]
        done = dict(zip((words[i] for i in short), self._contract([held[i] for i in short])))
        return done | dict(zip((words[i] for i in long), self._long([held[i] for i in long])))

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """Bytes of each row of ids: its tokens join the vocabulary and are aggregated in order."""
        size = np.array([len(x) // 4 for x in rows])
        tok = np.frombuffer(b"".join(rows), "<u4").astype(np.int64)
        coded = pa.table({"row": np.repeat(np.arange(len(rows)), size), "pos": np.arange(len(tok)), "tok": tok})  # noqa: F841
        got = self.con.sql(_DECODE).to_arrow_table().combine_chunks()
        out = [b""] * len(rows)
        for part in got.to_batches():
            child = part.column("parts").values
            at, ends = part.column("parts").offsets.to_numpy(), np.frombuffer(child.buffers()[1], dtype=np.int32)[child.offset : child.offset + len(child) + 1]
            body = child.buffers()[2]
            for row, a, b in zip(part.column("row").to_pylist(), ends[at[:-1]].tolist(), ends[at[1:]].tolist()):
                out[row] = body[a:b].to_pybytes()
        return out

    def encode(self, rows: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        pieces = [self.splitter.split(t) for t in rows]
        now, new = {}, set()
        young, old = self.young.get, self.old.get
        for w in set().union(*pieces):
            got = young(w) or old(w)
            if got is None:
                new.add(w)
            else:
                now[w] = got
        now |= self.encode_words(new)
        self.young |= now
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return [b"".join([now[w] for w in p]) for p in pieces]


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Encode and decode ``text``. Columns: ``keep``, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the ids."""
    tune(docs.sparkSession)
    kept = docs.select(*[c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")], "text")
    fields = [f for f in kept.schema.fields if f.name != "text" or "text" in keep]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for part in chunks(batches, limit=3_000_000):
            got = c.encode(texts(part.column("text")).to_pylist())
            cols = [part.column(n) for n in names] + [pa.array([len(a) // 4 for a in got], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a in got]), pa.array([hashlib.sha256(b).hexdigest() for b in c.decode(got)])]
            if ids:
                cols.append(pa.array([np.frombuffer(a, dtype="<u4").astype(np.int32) for a in got], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)

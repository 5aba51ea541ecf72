"""Exact SentencePiece (merge type) encoding by backtracking, and decoding from the ids.

The library merges, again and again, the neighbouring pair whose union is the piece of
highest score, leftmost first. Its result is the one sequence of pieces in which each
neighbouring pair comes out as itself when its own text is merged, as merges inside two
neighbours never depend on what stands further off. So a text is encoded from left to
right: Aho-Corasick names the longest piece that starts at each place; a piece is taken
if it is compatible with the piece before it, which merging the text of the two tells
(remembered by pair), otherwise the next shorter piece that starts there is tried; where
none is left the place is marked in a bitfield of failed positions and the last piece is
taken back. Each prefix has one encoding, so a failed position fails for good, and a text
is encoded in time linear in its length.

A character without a piece stands for itself and becomes byte pieces. Texts are cut first
where no piece reaches across (before a space mark, between letters and other signs; checked
on all pieces when the model is loaded); a worker encodes each distinct stretch once among
the last ``CACHE`` new words.

Decoding takes nothing but the ids: bytes of the pieces are gathered from one table.

Defined results: a null or empty text has no pieces; repeated rows each give a row; very
long texts are encoded whole, in time linear in their length; other columns pass through
untouched unless they clash with the outputs, which then win.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronolith.llm.common import chunks, texts, tune

#: Words of one generation of the cache, and remembered pairs; two generations of words are kept in one worker.
CACHE = 400_000
PAIRS = 2_000_000

SPACE = "▁"


_WORD = f"{SPACE}*[^{SPACE}]+|{SPACE}+"
_WORDS = re.compile(_WORD)


def _cuts(signs: str) -> tuple[str, str]:
    """Ways to cut a text where no piece may reach across, finest first: letters, single digits, line ends, other signs; or words. signs: letters in name only, such as raised digits."""
    return rf"{SPACE}*(?:[^\W\d_{re.escape(signs)}]+|[\d\n]|(?:[^\w{SPACE}\n]|[_{re.escape(signs)}])+)|{SPACE}+", _WORD


class Pieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        other = [lib.is_control(i) or lib.is_byte(i) or lib.is_unknown(i) or lib.is_unused(i) for i in range(n)]
        self.piece = [lib.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, (p, o) in enumerate(zip(self.piece, other)) if not o}
        self.score = {p: lib.get_score(i) for p, i in self.ids.items()}
        self._supported(lib)
        # A character without a piece gets a number of its own past the vocabulary when it is met; see ``_stranger``.
        self.unknown = lib.unk_id()
        self.decimal = [str(i) for i in range(n)]
        self.strangers: dict[str, int] = {}
        self.shorter: dict[int, int] = {}
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), -1)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.length = {i: len(p) for p, i in self.ids.items()}
        self.pairs: dict[int, bool] = {}  # by first << 20 | second
        self.parts: dict[str, tuple[int, ...]] = {}
        self.young: dict[str, tuple[bytes, bytes]] = {}
        self.old: dict[str, tuple[bytes, bytes]] = {}
        body = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.is_byte = np.array([lib.is_byte(i) for i in range(n)])
        self.sizes = np.array([len(b) for b in body], np.int32)
        self.starts = np.cumsum(self.sizes, dtype=np.int32) - self.sizes
        self.table = np.frombuffer(b"".join(body), np.uint8)

    def _supported(self, lib) -> None:
        """The model's normaliser is the identity with a space in front, bytes stand for unknown characters, pieces hold marks only in front."""
        plain = [" a  b ", "ﬁ Å\t\r\n\x00　x"]
        if any(lib.normalize(t) != SPACE + t.replace(" ", SPACE) for t in plain) or not any(map(lib.is_byte, range(lib.get_piece_size()))):
            raise ValueError("only models with an identity normaliser, a space in front and byte pieces are supported")
        # Whether two neighbouring characters are cut depends on them alone, so a cut that leaves each piece whole is safe anywhere.
        signs = {c for p in self.ids for c in p if c.isalnum() and not c.isalpha() and not c.isdecimal()}
        found = [c for c in map(re.compile, _cuts("".join(sorted(signs)))) if all(map(c.fullmatch, self.ids))]
        if not found or found[-1].pattern != _WORD:
            raise ValueError("a piece holds the space mark after another character")
        self.finest = found[0]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging pairs of highest score, leftmost first."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stranger(self, c: str) -> int:
        """The number of a character without a piece."""
        i = self.strangers.get(c)
        if i is None:
            i = self.strangers[c] = len(self.piece)
            self.piece.append(c)
            self.length[i], self.shorter[i] = 1, -1
        return i

    def _compatible(self, a: int, b: int) -> bool:
        """Whether the texts of two neighbours, merged together, give just these two; a < 0: whether b's own text gives b."""
        parts = ([self.piece[a]] if a >= 0 else []) + [self.piece[b]]
        known = self.merged("".join(parts)) == parts
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << 20 | b] = known
        return known

    def backtracked(self, text: str) -> list[int]:
        """Numbers of the pieces of a text; strangers have numbers past the vocabulary."""
        n, length, shorter, pairs = len(text), self.length, self.shorter, self.pairs
        longest = [-1] * n
        for end, i in self.automaton.iter(text):  # of the pieces that start at a place, the longest ends last
            longest[end + 1 - length[i]] = i
        if -1 in longest:
            longest = [i if i >= 0 else self._stranger(text[k]) for k, i in enumerate(longest)]
        failed = bytearray(n // 8 + 1)  # a bit for each position
        taken: list[int] = []
        at, tok, last = 0, longest[0], -1
        while True:
            end = at + length[tok]
            if not failed[end >> 3] >> (end & 7) & 1:
                known = pairs.get(last << 20 | tok)
                if known is None:
                    known = self._compatible(last, tok)
                if known:
                    taken.append(tok)
                    if end == n:
                        return taken
                    at, last, tok = end, tok, longest[end]
                    continue
            while shorter[tok] < 0:  # nothing shorter starts here: this position fails, and the last piece is taken back
                failed[at >> 3] |= 1 << (at & 7)
                if not taken:
                    raise ValueError("the text has no encoding")
                tok = taken.pop()
                at -= length[tok]
                last = taken[-1] if taken else -1
            tok = shorter[tok]

    def _coded(self, word: str) -> tuple[bytes, bytes]:
        """Ids of a word behind a space, as little-endian int32, and as decimals joined by commas."""
        n, parts = self.sizes.size, self.parts
        ids: list[int] = []
        for part in self.finest.findall(SPACE + word):
            got = parts.get(part)
            if got is None:
                got = []
                for i in self.backtracked(part):
                    got += [i] if i < n else [self.byte_ids[b] for b in self.piece[i].encode()]
                got = parts[part] = tuple(got)
            ids += got
        decimal = self.decimal
        return struct.pack(f"<{len(ids)}i", *ids), ",".join([decimal[i] for i in ids]).encode()

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        """Ids of a text, and the same as decimals joined by commas."""
        if not text:
            return np.zeros(0, "<i4"), b""
        if "  " in text or text[0] == " " or SPACE in text:
            cut = [s[1:] for s in _WORDS.findall(SPACE + text.replace(" ", SPACE))]  # a word keeps all but the first of the marks before it
        else:
            cut = text.split(" ")
        young = self.young
        out = list(map(young.get, cut))
        if None in out:
            old = self.old
            for w in set(cut):
                if w not in young:
                    young[w] = old.get(w) or self._coded(w)
            out = list(map(young.get, cut))
            if len(young) > CACHE:
                self.old, self.young = young, {}
                self._forget()
        return np.frombuffer(b"".join([x[0] for x in out]), "<i4"), b",".join([x[1] for x in out])

    def _forget(self) -> None:
        """Bound what is remembered besides words. Numbers of strangers go with the pairs that hold them."""
        self.parts.clear()
        if len(self.strangers) > CACHE:
            del self.piece[self.sizes.size :]
            self.strangers.clear()
            self.pairs.clear()

    def decode(self, ids: np.ndarray) -> str:
        """Text of a sequence of ids, as the library's decode gives it."""
        if len(ids) and (ids.min() < 0 or ids.max() >= self.sizes.size):
            raise ValueError("an id is outside the vocabulary")
        if (ids == self.unknown).any():
            return self.library.decode(ids.tolist())
        size = self.sizes[ids]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ids) else 0
        # Place of each byte in the table: one up from its forerunner, or at the start of its piece.
        step = np.ones(total, np.int32)
        some = size > 0
        first, begin = (ends - size)[some], self.starts[ids[some]]
        if total:
            step[first] = begin - np.concatenate([[-1], begin[:-1] + size[some][:-1] - 1])
            step[0] = begin[0]
        raw = self.table[np.cumsum(step, dtype=np.int32)].tobytes()
        try:
            text = raw.decode("utf-8")
        except UnicodeDecodeError:  # byte pieces that are no character
            return self.library.decode(ids.tolist())
        # The space in front belongs to the encoding.
        return text[1:] if len(ids) and not self.is_byte[ids[0]] and text.startswith(" ") else text


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """Encode and decode ``text``. Columns: ``keep``, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, and with ``ids`` the ids."""
    tune(docs.sparkSession)
    kept = docs.select(*[c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256", "ids")], "text")
    fields = [f for f in kept.schema.fields if f.name != "text" or "text" in keep]
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for part in chunks(batches):
            n, coded, decoded, numbers = [], [], [], []
            for text in texts(part.column("text")).to_pylist():
                own, decimals = p.encode(text)
                n.append(len(own))
                coded.append(hashlib.sha256(decimals).hexdigest())
                decoded.append(hashlib.sha256(p.decode(own).encode()).hexdigest())
                if ids:
                    numbers.append(own)
            cols = [part.column(c) for c in names] + [pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)]
            if ids:
                cols.append(pa.array(numbers, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema.fields])

    return kept.mapInArrow(run, schema)

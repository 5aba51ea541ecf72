"""Secret scans with multipart credential linking.

The base patterns give keyed assignments, access keys and long hex runs. Linking
looks at weaker parts: a *name* of an account (``user``, ``client_id``,
``login`` ... = value, or an access key), an *opaque* string that by itself proves
nothing (letters and digits of high entropy, of any length, no key word), and an
*endpoint* (URL, or host with port). Parts are intervals: each opaque string's
scope, ``SCOPE`` characters either way, is joined to the nearest name and the
nearest endpoint. Only where both complements lie in its scope is the opaque
string reported, as ``weak``. Strings that overlap a base span, or are part of a
name or an endpoint themselves, are none.

The join is a search of sorted intervals and every pattern reads a text once, so
it is n log n for any text, however long a run of one kind of character is.

Defined results: null counts as empty; an empty text has no span; repeated rows
each give a row; a text is scanned as a whole, whatever its length; extra columns are ignored by the scan and kept by the masking.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from chronolith.llm.common import chunks, texts, tune

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_KEYWORD = re.compile(r"pass(?:word|wd)|secret|token|api_?key", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_NAME = re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|access_?(?:key_?)?id|key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]{3,})""", re.I | re.A)
_ADDRESS = re.compile(r"://[^\s\"'<>]+")
_HOST = re.compile(r"\b(?:host(?:name)?|server|endpoint|url)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]+(?::\d+)?", re.I | re.A)
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+.-")
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
#: Characters either way in which the parts of one credential are linked.
SCOPE = 400
#: Bits per character from which a string counts as opaque, and the share of digits it needs if it lacks upper or lower case.
ENTROPY = 3.5
DIGITS = 0.15


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) of the base patterns in code points."""
    out = []
    if _KEYWORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], BASE.index(x[2])))


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def _endpoints(text: str) -> list[tuple[int, int]]:
    """Spans of endpoints. A scheme is read backwards from its ://, up to the end of the one before."""
    out = []
    for m in _ADDRESS.finditer(text) if "://" in text else ():
        a = m.start()
        while a and text[a - 1] in _SCHEME:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
    return sorted(out + [m.span() for m in _HOST.finditer(text)])


def _opaque(s: str) -> bool:
    """Whether a string looks random."""
    digits = sum(c.isdigit() for c in s)
    lower, upper = any("a" <= c <= "z" for c in s), any("A" <= c <= "Z" for c in s)
    if not digits or not (lower or upper) or not (lower and upper) and digits < DIGITS * len(s):
        return False
    return _entropy(s) >= ENTROPY


class _Spans:
    """Sorted disjoint spans: overlaps and distances by binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.start: list[int] = []
        self.end: list[int] = []
        for a, b in sorted(spans):
            if self.end and a <= self.end[-1]:
                self.end[-1] = max(self.end[-1], b)
            else:
                self.start.append(a)
                self.end.append(b)

    def meet(self, a: int, b: int) -> bool:
        """Whether any span has a character in [a, b)."""
        i = bisect.bisect_right(self.end, a)
        return i < len(self.start) and self.start[i] < b


def linked_spans(text: str, base: list[tuple[int, int, str]], scope: int = SCOPE) -> list[tuple[int, int, str]]:
    """Weak candidates whose scope holds both an identifier and an endpoint."""
    ends = _endpoints(text)
    if not ends:
        return []
    names = [m.span() for m in _NAME.finditer(text)] + [(a, b) for a, b, k in base if k == "access"]
    if not names:
        return []
    taken = _Spans([(a, b) for a, b, _ in base] + names + ends)
    names, ends = _Spans(names), _Spans(ends)
    out = []
    for m in _OPAQUE.finditer(text):
        a, b = m.span()
        if not taken.meet(a, b) and names.meet(a - scope, b + scope) and ends.meet(a - scope, b + scope) and _opaque(m[0]):
            out.append((a, b, "weak"))
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def all_spans(text: str, scope: int = SCOPE) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    base = base_spans(text)
    weak = linked_spans(text, base, scope)
    return base, sorted(base + weak, key=lambda x: (x[0], (*BASE, "weak").index(x[2])))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = [all_spans(t, scope) for t in texts(part.column("text")).to_pylist()]
            count = [Counter(k for _, _, k in every) for _, every in rows]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *[pa.array([c[k] for c in count], pa.int64()) for k in BASE], pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in rows]), pa.array([_joined(s) for _, s in rows]), pa.array([c["weak"] for c in count], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_weak"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_weak long")


def mask(text: str, scope: int = SCOPE) -> str:
    """The text with every reported span replaced by a mark of its kind; overlapping spans become one mark."""
    out, at = [], 0
    for a, b, kind in all_spans(text, scope)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """All rows and columns with secrets masked in ``text`` and ``n_chars`` (if present) counted anew. Null stays null."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            text = [None if t is None else mask(t, scope) for t in part.column("text").to_pylist()]
            new = {"text": pa.array(text, pa.string()), "n_chars": None}
            cols = []
            for f in part.schema:
                if f.name == "n_chars":
                    cols.append(pa.array([old if t is None else len(t) for t, old in zip(text, part.column("n_chars").to_pylist())], f.type))
                else:
                    cols.append(new.get(f.name) if f.name == "text" else part.column(f.name))
            yield pa.RecordBatch.from_arrays(cols, schema=part.schema.set(part.schema.get_field_index("text"), pa.field("text", pa.string())))

    return docs.mapInArrow(run, docs.schema)

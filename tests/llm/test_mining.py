"""Phrases, SentencePiece and periodic runs against plain versions, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import gc
import hashlib
import random
import re
import weakref
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronolith.llm import common, phrases, pieces, runs, substring

PIECES = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def clashing(df):
    return df.withColumns({c: F.lit(1) for c in ("n_tokens", "ids", "phrase", "f", "slice", "codes", "words", "start", "rank")})


# ---- 11 ------------------------------------------------------------------------------------------------------------


def mined(rows, least, limit, share):
    """The contract, word by word."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = collections.defaultdict(list)
    cand = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    longer = collections.Counter()
    for (lang, p), a in cand.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i : i + k]] = max(longer[lang, p[i : i + k]], a)
    for (lang, p), a in cand.items():
        if 100 * longer[lang, p] >= share * a:
            continue
        score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, l, r))
    return sorted((lang, i + 1, p.decode(), a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, _, p, a, l, r) in enumerate(sorted(x)[:limit]))


def phrase_rows(seed=1):
    g = random.Random(seed)
    v = [f"w{i}" for i in range(25)] + ["É", "zß", "a'b", "\u00a0", "日本"]
    rows = []
    for i in range(120):
        say = lambda: " ".join(g.choice(v) for _ in range(g.randint(0, 30)))
        text = say() + g.choice([". ", "\n", " ", "\t", "  "]) + "New York City is" + g.choice([" ", ", ", ": "]) + say()
        rows.append((i, text, g.choice(["en", "en", "de", None])))
    return rows + [(200, None, "en"), (201, "", "en"), (None, "x x x x x x x x x x x x", "en"), (201, "x x x", "fr"), (202, " . , \n", None), (203, "lone " * 3000, "es")]


@pytest.mark.parametrize("least,limit", [(5, 2000), (8, 7)])
def test_phrases_equal_plain(spark, least, limit):
    rows = phrase_rows()
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3))
    got = sorted(map(tuple, phrases.collocations(df, least, limit, 80).collect()))
    assert got and got == mined(rows, least, limit, 80)


def test_phrases_over_small_shards_and_small_tables(spark, monkeypatch):
    rows = phrase_rows(2)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    want = mined(rows, 5, 2000, 80)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 300)
    assert sorted(map(tuple, phrases.collocations(df, 5, 2000, 80).collect())) == want
    monkeypatch.setattr(phrases, "SLOTS", (1 << 16, 1 << 16))  # hashes collide more often
    assert sorted(map(tuple, phrases.collocations(df, 5, 2000, 80).collect())) == want
    assert phrases.collocations(df.limit(0), 5).count() == 0


@pytest.mark.parametrize("wide", [0, 2, 10**6])
def test_bitmaps_shift_and_meet(monkeypatch, wide):
    monkeypatch.setattr(phrases, "WIDE", wide)
    g = np.random.default_rng(1)
    at = lambda x: [64 * b + k for b, bits in zip(x[0].tolist(), x[1].tolist()) for k in range(64) if bits >> k & 1]
    for size in (1, 63, 64, 65, 1000, 9000):
        codes = g.integers(-1, 4, size).astype(np.int32)
        place = [np.flatnonzero(codes == c).tolist() for c in range(4)]
        by_code = np.flatnonzero(codes >= 0)
        by_code = by_code[np.argsort(codes[by_code], kind="stable")]
        firsts, second = phrases.Bitmaps(codes, by_code, np.array([True, True, True, False])), phrases.Bitmaps(codes, by_code, np.array([True, True, False, True]), 1)
        assert at(firsts.word(0)) == place[0] and at(firsts.word(3)) == []
        assert at(second.word(1)) == [i - 1 for i in place[1] if i]
        room = np.zeros((size >> 6) + 1, np.uint64)
        counts, parts = second.met(firsts.word(2), np.array([0, 1, 3]), room)
        want = [[i for i in place[2] if i + 1 < size and codes[i + 1] == c] for c in (0, 1, 3)]
        assert counts.tolist() == [len(x) for x in want] and not room.any()
        assert [at(phrases.held(p)) for p in parts] == want


def test_plain_rows_are_bounded(monkeypatch):
    monkeypatch.setattr(phrases, "WIDE", 2)
    codes = np.repeat(np.arange(50, dtype=np.int32), 40)[np.random.default_rng(3).permutation(2000)]
    by_code = np.argsort(codes, kind="stable")
    free = phrases.Bitmaps(codes, by_code, np.ones(50, bool), 1)
    monkeypatch.setattr(phrases, "PLAIN_BYTES", 5 * 8 * free.span)
    bound = phrases.Bitmaps(codes, by_code, np.ones(50, bool), 1)
    assert len(free.plain) == 50 and len(bound.plain) == 5
    x, room = free.word(7), np.zeros(free.span, np.uint64)
    some = [y.met(x, np.arange(50), room) for y in (free, bound)]
    assert some[0][0].tolist() == some[1][0].tolist()
    assert all(np.array_equal(a, b) for p, q in zip(some[0][1], some[1][1]) for a, b in zip(phrases.held(p), phrases.held(q)))


def test_a_mined_shard_leaves_no_arrays(monkeypatch):
    made = weakref.WeakSet()

    class Own(phrases.Bitmaps):
        def __init__(self, *args, **kwargs):
            super().__init__(*args, **kwargs)
            made.add(self)

    monkeypatch.setattr(phrases, "Bitmaps", Own)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 9, "text": ["a b c d a b. a b c"] * 9})
    (shard,) = phrases._each(phrases._shards(iter([batch])))
    gc.collect()
    gc.disable()
    try:
        found = dict(zip(*phrases._mined(shard, b"\xff" * 64, b"\xff" * 64)))
        assert found["a b c"] == 18 and len(made) == 0
    finally:
        gc.enable()


def test_files_hold_few_shards(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILE_SHARDS", 2)
    kept = {}
    monkeypatch.setattr(phrases, "written", lambda df, name, **how: kept.setdefault(name, common.written(df, name, **how)))
    assert phrases.collocations(spark.createDataFrame(phrase_rows(2), SCHEMA).coalesce(1), 5).count()
    per_file = [r["count"] for r in kept["shards"].groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) > 2 >= max(per_file)


# ---- 12 ------------------------------------------------------------------------------------------------------------

HARD = ["", " ", "  ", "\n", "a", "<s>hi</s> <0x0A><unk>", "▁", "▁▁a ▁", "\x00", "é" * 50, " " * 1000, "a" * 3000, "x" * 20 + " " * 33 + "y", "\u2028  \xa0x", "日本語\U00010000 " * 5, "=-" * 300, "\u0600" * 9, "0123456789 " * 20, "\U00010000a", "². x²³ ½_a", "ab" * 50_000]


def test_pieces_equal_library():
    p = pieces.Pieces(PIECES)
    g = random.Random(3)
    some = ["".join(g.choice("aeinrst  ▁\n0é日=-.,²\U00010000") for _ in range(g.randint(0, 40))) for _ in range(1500)]
    some += ["".join(g.choice(p.piece[3:32000]).replace("▁", " ") for _ in range(g.randint(1, 10))) for _ in range(500)]
    for text in HARD + some:
        ids, decimals = p.encode(text)
        assert ids.tolist() == p.library.encode(text) and decimals.decode() == ",".join(map(str, ids.tolist()))
        assert p.decode(ids) == p.library.decode(ids.tolist())
    for ids in ([0], [5, 300], [195, 300], [264, 1, 264], [28705], [259], []):
        assert p.decode(np.array(ids, "<i4")) == p.library.decode(ids)


def test_pieces_forget_and_whole_words(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE", 3)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    p = pieces.Pieces(PIECES)
    for _ in range(2):
        for text in ("one two three four five", "\u0600 \u0601 \u0602 \u0603 \u0604", "one six"):
            assert p.encode(text)[0].tolist() == p.library.encode(text)
    p.finest = re.compile(pieces._WORD)  # the coarse cut gives the same
    assert all(p.encode(t)[0].tolist() == p.library.encode(t) for t in HARD)


def test_pieces_query_on_rows(spark):
    lib = pieces.pieces(PIECES).library
    rows = [(i, t) for i, t in enumerate(HARD)] + [(None, "null id"), (3, None), (4, "a"), (4, "a")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = collections.Counter((i, len(x := lib.encode(t or "")), sha(",".join(map(str, x)).encode()), sha(lib.decode(x).encode()), tuple(x)) for i, t in rows)
    assert collections.Counter((r[0], r[1], r[2], r[3], tuple(r[4])) for r in pieces.encode(df, PIECES).collect()) == want
    assert pieces.encode(df.limit(0), PIECES).count() == 0
    assert pieces.encode(df, PIECES, keep=("doc_id", "rank", "n_tokens"), ids=False).columns == ["doc_id", "rank", "n_tokens", "ids_sha256", "decoded_sha256"]


# ---- 13 ------------------------------------------------------------------------------------------------------------


def plain_runs(w):
    out = []
    for p in range(1, len(w) // 4 + 1):
        k, end = 0, len(w) - p
        while k < end:
            s = k
            while k < end and w[k] == w[k + p]:
                k += 1
            n = k - s + p
            if k > s and n >= max(6, 4 * p) and not any(w[s + q : s + n] == w[s : s + n - q] for q in range(1, p)):
                out.append((s, n, p))
            k += k == s
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("block", [3, 40, 2_000_000])
def test_runs_equal_plain(monkeypatch, block):
    monkeypatch.setattr(runs, "BLOCK", block)
    monkeypatch.setattr(runs, "CHUNK", 4)
    g = random.Random(block)
    for _ in range(250):
        docs = []
        for _ in range(g.randint(0, 4)):
            n, a = g.randint(0, 70), g.choice([1, 2, 2, 3, 20])
            w = [g.randrange(a) for _ in range(n)]
            if n > 8 and g.random() < 0.6:
                s, p = g.randrange(n), g.randint(1, 6)
                for i in range(s, n):
                    w[i] = w[s + (i - s) % p]
                if g.random() < 0.5:
                    w[g.randrange(n)] = 99
            docs.append(w)
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = runs.find(np.array([x for d in docs for x in d], dtype=np.int64), first).tolist()
        for k, w in enumerate(docs):
            assert [tuple(r[1:]) for r in got if r[0] == k] == plain_runs(w)


def test_runs_query_on_rows(spark):
    g = random.Random(7)
    say = lambda n: " ".join(g.choice(["a", "bb", "ccc", "é", "x\u00a0y"]) for _ in range(n))
    rows = [(i, say(g.randint(0, 120)) + "\n" + " ".join([say(3)] * g.randint(0, 9))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "z " * 9), (3, rows[3][1]), (3, rows[3][1]), (502, "same " * 3000), (503, "\t \n")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    want = collections.Counter()
    for i, t in rows:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            a = h // 10 % len(w)
            p = 1 + (len(w) - a) // (3 + h // 10 % 8)
            w = [w[a + (k - a) % p] if k >= a else x for k, x in enumerate(w)]
        found = plain_runs(w) if len(w) < 1000 else [(0, len(w), 1)]
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        lines, kept = "".join(f"{s},{n},{q}\n" for s, n, q in found), " ".join(x for k, x in enumerate(w) if k not in gone)
        want[i, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = runs.periodic_runs(df, edit=True).drop("n_words", "n_dropped")
    assert collections.Counter(map(tuple, got.collect())) == want
    assert runs.periodic_runs(df.limit(0)).count() == 0


# ---- words made to collide -----------------------------------------------------------------------------------------


def test_words_that_collide_under_polynomials_stay_apart(spark):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))  # Thue-Morse, 1,024 letters
    two = one.translate(str.maketrans("ab", "ba"))
    around = [f"w{i}" for i in range(60)]
    text = lambda word: " ".join(around[:30] + [word] + around[30:])
    df = spark.createDataFrame([(1, text(one)), (2, text(two)), (3, text(one))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.deduplicated(df).collect()} == {1: 0, 2: 0, 3: 61}

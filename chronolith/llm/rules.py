"""Quality rules with cross-document line frequency, in SQL functions only.

Base figures come from the words and lines of one text. For the verdict, lines
are normalised (lower case, digits to 0, white space squeezed) and hashed, and the
documents of each host that hold a line are counted, each once; a document's host
is its ``source`` and every row is a document. Lines in more than ``LINE_DOCS``
documents of their host are removed: a number, so that a limit neither grows with
a large host nor vanishes in a small one. A document that keeps less than
``LEAST_LEFT`` of its words, one made mostly of such lines, is depleted and
rejected; so are all members of a group of more copies than the limit.

Repeated three-word windows are found inside the row: window hashes are sorted
with their positions, equal neighbours give the repeated windows, and the words
they cover are counted from their sorted positions. It is n log n for any text.

Defined results: null text has no words and fails the base rule; a null source
is one host of its own; repeated rows each get a row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
MIN_WORDS = 50
#: Percent of words inside repeated windows beyond which a text fails.
MOST_REPEATED = 50
#: A line in more documents of its host than this is removed.
LINE_DOCS = 10
#: Share of its words that a document must keep.
LEAST_LEFT = 0.5


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda would compute an outer expression again per element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first included."""

    def triples(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))

    def again(ordered: Column) -> Column:
        found = F.filter(ordered, lambda x, i: (x["h"] == F.get(ordered, i - 1)["h"]) | (x["h"] == F.get(ordered, i + 1)["h"]))
        return F.sort_array(F.transform(found, lambda x: x["i"]))

    def cover(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)

    hashes = F.transform(words, lambda x: F.xxhash64(x))
    return bound(hashes, lambda h: bound(F.sort_array(triples(h)), lambda o: bound(again(o), cover)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def base_figures(docs: DataFrame) -> DataFrame:
    """A row per document with its base figures and its normalised lines (hash, words)."""
    text = F.coalesce("text", F.lit(""))
    held = docs.select("doc_id", "source", text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    normal = F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(x), r"[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))).alias("h"),
            F.regexp_count(x, F.lit(WORD)).alias("w"),
        ),
    )
    return held.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("host"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        bound(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        _repeat_words(_words(F.col("text"))).alias("n_repeat_words"),
        normal.alias("lines"),
    )


def judged(docs: DataFrame, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, line_docs: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, and the words removed with frequent lines."""
    base = written(base_figures(docs), "rules-base")
    # A document counts once for a line; counts combine before the shuffle, so a line in very many documents is a row a task.
    held = base.select("host", F.explode(F.array_distinct("lines.h")).alias("h"))
    often = held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > line_docs).select("host", "h")
    lines = base.select("row", "host", F.explode("lines").alias("l")).select("row", "host", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    removed = lines.join(often, ["host", "h"]).groupBy("row").agg(F.sum("w").cast("long").alias("n_removed"))
    gone = F.coalesce("n_removed", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return (
        base.drop("lines")
        .join(removed, "row", "left")
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
            (~failed & (F.col("n_words") - gone >= F.lit(least_left) * F.col("n_words"))).alias("kept"), gone.alias("n_removed"),
        )
    )

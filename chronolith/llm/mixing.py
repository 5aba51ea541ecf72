"""Mixing sources to target weights by Pareto order sampling, in SQL functions only.

Each source gets a share of all words by its weight, at most ``most`` times its
own words; what is cut off is shared again by weight, which has the closed form
target = min(most * size, level * weight). Of target / size copies the whole ones
are certain for every document. The words that remain are drawn with probability
in proportion to a document's size, pi = min(1, rate * size): long documents,
which would move the total most, are certain, and the words expected are those
owed. Each document gets a Pareto rank, odds of a uniform number divided by the
odds of its own pi, and the lowest ranks are taken up to the words owed: the size
of a sample is fixed in words, to half of the document at the cut.

The order within a source is found without sorting the source: ranks are dealt
into ``BUCKETS`` buckets; sums of buckets tell which one holds the cut, and only
its rows are sorted. Uniform numbers are hashes of id, text and seed, so reruns
agree.

Defined results: null text has size 0; null source is a source, last in order;
repeated rows are separate documents with equal ranks; documents without words
get whole copies only; an empty table gives no rows; a source without words has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.llm.common import written

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS = 4096
#: Bins of size an octave, for the inclusion probabilities.
BINS = 16


def word_count(text: Column | str) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``: runs are squeezed to separators by one regular expression."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(seed: int, *columns: str) -> Column:
    """A hash in (0, 1)."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> target. One row per source, which is far smaller than the corpus."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()).cast("double") - F.coalesce(F.sum(F.lit(float(most)) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    # Sources fill in order of ratio; the level is that of the first that stays below its ratio, the largest such one.
    found = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy()))
    return found.select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), F.lit(float(most)) * F.col("source_size"))).alias("target"))


def sizes(docs: DataFrame, seed: int, *carry: str) -> DataFrame:
    """row, doc_id, source, size, the uniform number u and any other column asked for."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", word_count("text").alias("size"), uniform(seed, "doc_id", "text", "source").alias("u"), *carry)


def _rates(rows: DataFrame, aims: DataFrame) -> DataFrame:
    """source, rate: with pi = min(1, rate * size), the words expected from a source's sample are the words owed.

    For any set of sizes taken as certain, owed = words of those + rate * squares of the rest bounds the
    rate from below, and the right set reaches it; so the rate is the largest over all cuts of sizes.
    Sizes are binned by ``BINS`` an octave, so a source has a few hundred bins whatever its rows.
    """
    some = rows.where("size > 0").select("source", F.floor(F.log2("size") * BINS).cast("int").alias("bin"), "size")
    bins = some.groupBy("source", "bin").agg(F.sum("size").cast("double").alias("s"), F.sum(F.col("size").cast("double") * F.col("size")).alias("s2"))
    up = Window.partitionBy("source").orderBy("bin")
    larger = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cuts = bins.select("source", larger.alias("certain"), F.sum("s2").over(up).alias("rest"))
    held = cuts.alias("b").join(aims.alias("a"), F.expr("b.source <=> a.source")).select("b.*", "part")
    return held.groupBy("source").agg(F.max((F.col("part") - F.col("certain")) / F.col("rest")).alias("rate"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns: doc_id, size, source_size, target, taken (words), copies, pi (of the copy beyond the whole ones), and ``carry``."""
    rows = written(sizes(docs, seed, *carry), "mix-sizes")
    aims = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    owed = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Never beyond most copies, whatever the rounding of the quotient.
    aims = aims.withColumn("whole", F.least(F.floor(owed).cast("long"), F.lit(most).cast("long")))
    aims = aims.withColumn("part", F.when(F.col("whole") >= most, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    aims = written(aims.select("source", "source_size", "target", "whole", "part"), "mix-targets")
    aims = aims.alias("a").join(_rates(rows, aims).alias("r"), F.expr("a.source <=> r.source"), "left").select("a.*", F.coalesce("rate", F.lit(0.0)).alias("rate"))
    aims = written(aims, "mix-rates")
    few = _few(aims)

    def by_source(left: DataFrame, right: DataFrame, *columns: str) -> DataFrame:
        right = F.broadcast(right) if few else right
        return left.alias("d").join(right.alias("c"), F.expr("d.source <=> c.source")).select("d.*", *[F.col(f"c.{x}") for x in columns])

    drawn = by_source(rows, aims, "source_size", "target", "whole", "part", "rate").withColumn("pi", F.least(F.lit(1.0), F.col("rate") * F.col("size")))
    # The Pareto rank is odds(u) / odds(pi); v = rank / (1 + rank) orders alike and lies in [0, 1]. Certain rows come first.
    odds = F.col("u") * (1 - F.col("pi"))
    drawn = drawn.withColumn("v", odds / (odds + (1 - F.col("u")) * F.col("pi"))).withColumn("bucket", F.least(F.floor(F.col("v") * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))
    sums = drawn.groupBy("source", "part", "bucket").agg(F.sum("size").alias("bucket_size"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(run), F.lit(0)))
    # The cut lies in the last bucket that starts below the words owed: earlier ones are taken whole, later ones not at all.
    cut = cut.groupBy("source").agg(F.max(F.when(F.col("base") < F.col("part"), F.struct("bucket", "base"))).alias("cut"))
    cut = written(cut.select("source", F.coalesce("cut.bucket", F.lit(-1)).alias("at"), F.coalesce("cut.base", F.lit(0)).alias("base")), "mix-cuts")
    drawn = by_source(drawn, cut, "at", "base")
    order = Window.partitionBy("source", "bucket").orderBy("v", "doc_id", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    split = drawn.where("bucket = at").withColumn("upto", F.col("base") + F.sum("size").over(order))
    # Taken if the words after this row come nearer to the words owed than those before it.
    split = split.withColumn("more", (F.col("upto") + (F.col("upto") - F.col("size")) <= 2 * F.col("part")).cast("long")).drop("upto")
    rest = drawn.where("bucket <> at").withColumn("more", (F.col("bucket") < F.col("at")).cast("long"))
    out = rest.unionByName(split).withColumn("copies", F.col("whole") + F.when(F.col("size") > 0, F.col("more")).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "pi", *carry)


def _few(cut: DataFrame, most: int = 200_000) -> bool:
    """Whether the cuts, a row per source, are few enough to broadcast (checked; about 100 bytes each)."""
    return cut.limit(most + 1).count() <= most


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 7) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    out = mix(docs.withColumn("__row", row), weights, most, seed, carry=("__row",)).where("copies > 0")
    return out.select(F.explode(F.array_repeat("__row", F.col("copies").cast("int"))).alias("r")).select("r.*")

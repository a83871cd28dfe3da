"""A mix of sources to target weights: whole epochs first, then a weighted sample of each source.

Sources in the order of their names share the size of all documents by weights that repeat; a target stops at a
multiple of its source's size, and what is over goes to the others by weight until none is above. A source is then
taken as many whole times as its target holds, and for what remains its documents are sorted by exponential keys,
-ln(u) / quality (Efraimidis and Spirakis: each next document is drawn with a chance in proportion to its quality),
and taken from the first on until the words suffice; the last one gives only its first words, so that a source's
words meet its target to the word. u is a hash of a seed, the id and the text: reruns agree.

Everything is DataFrame functions. Sorting within a source is split by ranges of the keys, sized to the table: each
range is sorted alone, and sums of the ranges before it are added, so a source that holds a third of all rows is as
many tasks as its size calls for. Sources are ranked by ranges, too: no list of them passes one task or the driver.

Defined results: a null text has size 0, an empty one likewise; a null source is a source, the last; a source without
words has target 0. Repeated rows have equal keys, and which of them is taken is decided between them alone; rows
without an id take part. Empty tables give empty tables; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, parallelism, release

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS, MOST_EPOCHS, SEED = (5, 2, 1), 3, 42
#: Rows of a range of keys, about; the least number of ranges; the most sources whose figures are sent to every task.
RANGE, RANGES, SENT = 20_000, 64, 100_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """A document's weight in the draw, 1/8 to 1: the share of its lines that are no repeats, halved where words are unlike prose (under 3 or over 12 characters)."""
    lines = F.split(text, "\n")
    own = F.size(F.array_distinct(lines)) / F.size(lines)
    prose = F.length(text) / F.greatest(size, F.lit(1))
    return F.coalesce((0.25 + 0.75 * own) * F.when(prose.between(4, 13), 1.0).otherwise(0.5), F.lit(0.125))


def uniform(*of: Column, seed: int = SEED) -> Column:
    """Between 0 and 1, neither included."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *of), 11) + 0.5) / float(1 << 53)


def ranked(sources: DataFrame) -> DataFrame:
    """(place): the place of each source by code points, null last, from 0: by ranges, each of which is counted alone."""
    n = parallelism(sources.sparkSession)
    order = (F.col("source").isNull(), F.col("source"))
    parts = keep(sources.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "sources")
    counts = parts.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "part").withColumn("place", own + F.col("before")).drop("part", "before")


def targeted(sources: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS) -> DataFrame:
    """``sources`` (place, source_size) with target: shares of all sizes by weight, none above ``most`` times its source's size.

    A source is full if its share would be above. Each round reshares what the full ones leave, which can only make
    more of them full, so the rounds end; each is one row of sums.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    total, share, full = sources.agg(F.sum("source_size")).first()[0] or 0, None, -1
    while True:
        above = F.lit(False) if share is None else F.col("most") <= share * F.col("weight")
        r = sources.agg(F.count_if(above).alias("full"), F.sum(F.when(above, F.col("most"))).alias("held"), F.sum(F.when(~above, F.col("weight"))).alias("open")).first()
        if r["full"] == full or not r["open"]:
            break
        full, share = r["full"], max(0.0, (total - (r["held"] or 0)) / r["open"])
    target = F.least(F.col("most").cast("double"), F.lit(float("inf") if not r["open"] else share) * F.col("weight"))
    return sources.select("source", "source_size", target.alias("target"))


def mixed(
    df: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST_EPOCHS, weight: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: the words that the mix takes of each document, repeats counted.

    ``weight``: the documents' quality, a column of ``df`` above 0; without it :func:`quality` of the text.
    """
    text = F.col(text_col)
    base = df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(text).alias("size"), F.xxhash64(text).alias("mark"), uniform(F.col(id_col), text, seed=seed).alias("u"),
        (quality(text, words(text)) if weight is None else weight.cast("double")).alias("weight"),
    )
    # a source's name that is never null, so that joins and sums deal rows alike
    base = keep(base.withColumn("key", -F.log("u") / F.col("weight")).withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("u", "weight"), "mix-documents")
    ranges = max(RANGES, base.count() // RANGE)
    # quicker keys are more frequent: 1 - exp(-key) is about even, and grows with the key
    at = F.least(F.floor((1 - F.exp(-F.col("key"))) * ranges), F.lit(ranges - 1)).cast("int")
    base = base.withColumn("range", at)
    sums = keep(base.groupBy("name", "source", "range").agg(F.sum("size").alias("in_range")), "mix-ranges")
    sources = keep(targeted(keep(ranked(sums.groupBy("source").agg(F.sum("in_range").alias("source_size"))), "mix-places"), weights, most), "mix-targets")
    few = sources.count() <= SENT
    of = sources.withColumn("name", F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))).drop("source")
    before = F.sum("in_range").over(Window.partitionBy("name").orderBy("range")) - F.col("in_range")
    starts = sums.select("name", "range", before.alias("start")).join(F.broadcast(of) if few else of, "name")
    inside = F.sum("size").over(Window.partitionBy("name", "range").orderBy("key", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1))
    rows = base.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, ["name", "range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - F.col("start") - F.col("inside")))
    out = rows.select("doc_id", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"), "source")
    return out

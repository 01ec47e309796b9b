"""Mixing sources to target weights (operator 7).

Efraimidis-Spirakis sampling: a document's key is -ln(u) / weight, u a hash of the document in
(0, 1), weight its quality; a source's documents in order of their keys are a weighted sample
without replacement, cut where their sizes reach the source's token budget. Complete epochs
(every document once) come before this fractional selection.

No source is sorted as a whole, however much of the table it holds and however its weights lie:
keys are numbers of KEY_BITS bits, and the place in a source's order where its budget ends is found
digit by digit. Of each digit, sizes are summed before the shuffle; a prefix sum over at most 2**DIGIT
rows a source finds the digit where the budget ends, and the next digit is looked at among the
documents that share it. Selection is then a comparison with one key per source, so texts are never
shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
#: A key is floor(-ln(u) / weight * 2**POINT); u is not below 2**-53 and a weight not below LEAST_WEIGHT, so KEY_BITS bits hold it.
POINT, KEY_BITS, DIGIT = 48, 60, 15
LEAST_WEIGHT = 0.01


def quality_weight(text: Column) -> Column:
    """From LEAST_WEIGHT to 1: the share of letters and white space among the characters, to the fourth power."""
    kept = F.length(F.regexp_replace(text, r"[^\p{L}\x20\x09-\x0D]+", "")) / F.greatest(F.length(text), F.lit(1))
    return kept * kept * kept * kept


def sized(docs: DataFrame, weight: str | None = None, whole: bool = False) -> DataFrame:
    """doc_id, source, size and key of every document, without its text; whole: also row, all that docs has.

    weight: a column of docs, such as the score of a quality classifier; by default quality_weight(text).
    """
    names = ("doc_id", "text", "source", *([weight] if weight else []))
    at = {name: F.col(f"c{common.place(docs, name)}") for name in names}
    held = common.plain(docs)
    rows = held.select(at["doc_id"].cast("long").alias("doc_id"), F.coalesce(at["text"].cast("string"), F.lit("")).alias("text"), at["source"].cast("string").alias("source"), (at[weight].cast("double") if weight else F.lit(None).cast("double")).alias("w"), *([F.struct(*held.columns).alias("row")] if whole else []))
    # 52 bits of a digest of the document, moved off zero and one
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    w = quality_weight(F.col("text")) if weight is None else F.when(F.isnan("w"), F.lit(0.0)).otherwise(F.coalesce("w", F.lit(0.0)))
    key = F.floor(-F.ln(u) / F.least(F.greatest(w, F.lit(LEAST_WEIGHT)), F.lit(1.0)) * float(2**POINT)).cast("long")
    size = F.regexp_count("text", F.lit(common.WORD)).cast("long")
    return rows.select("doc_id", "source", size.alias("size"), key.alias("key"), *(["row"] if whole else []))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source_key, source_size -> also target, epochs and rest. One row per source.

    Sources in code point order, null last, take the weights in turn and share the total;
    a target stops at `most` times its source's size and the excess is shared again by weight.
    That end state is found at once: with sources in order of size / weight, those before the
    level at which the remaining weights absorb the remaining total are at their ceilings.
    """
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("source").isNull(), "source")
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    ranked = sizes.withColumn("w", weight).withColumn("ceiling", F.col("source_size") * F.lit(float(most)))
    by_level = everything.orderBy(F.col("ceiling") / F.col("w"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything).cast("double")
    ranked = ranked.withColumn("level", (total - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / F.sum("w").over(after))
    full = F.col("ceiling") <= F.col("w") * F.col("level")
    ranked = ranked.withColumn("full", full)
    level = (total - F.coalesce(F.sum(F.when(F.col("full"), F.col("ceiling"))).over(everything), F.lit(0.0))) / F.sum(F.when(~F.col("full"), F.col("w"))).over(everything)
    ranked = ranked.withColumn("target", F.when(F.col("full"), F.col("ceiling")).otherwise(F.col("w") * level))
    epochs = F.when(F.col("source_size") == 0, 0).otherwise(F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(most)))
    return ranked.withColumn("epochs", epochs.cast("long")).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")).select("source", "source_size", "target", "epochs", "rest")


def plan(keyed: DataFrame, scratch: common.Scratch, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: s (the source), source_size, target, epochs, and cut, the last key of the fractional selection."""
    wanted = scratch.save(targets(keyed.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most), "targets")
    # the first digits of the key at which the budget ends, and the sizes of all documents before them
    edge = wanted.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    same = F.col("source").eqNullSafe(F.col("s"))
    for shift in range(KEY_BITS - DIGIT, -1, -DIGIT):
        digits = F.shiftright("key", shift)
        inside = keyed.select("source", "size", digits.alias("digits"), F.shiftright("key", shift + DIGIT).alias("upper")).join(edge, same & (F.col("upper") == F.col("prefix")))
        # before and rest are the same in all rows of a source
        sums = inside.groupBy("s", "digits").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        upto = F.col("before") + F.sum("size").over(Window.partitionBy("s").orderBy("digits"))
        # at the last digit, documents are taken as long as the middle of the next is within the budget
        over = F.col("upto") - (F.col("size") / 2 if shift == 0 else 0) > F.col("rest")
        found = sums.withColumn("upto", upto).where(over).groupBy("s").agg(F.min(F.struct("digits", (F.col("upto") - F.col("size")).alias("before"), "rest")).alias("e"))
        edge = scratch.save(found.select("s", "e.rest", F.col("e.digits").alias("prefix"), "e.before"), f"edge{shift}")
    # where no document goes beyond the budget, all are taken; where the last digit had none left, those up to it
    cut = edge.select(F.col("s").alias("s0"), (F.col("prefix") - 1).alias("cut"))
    first = scratch.spark.read.parquet(scratch.path(f"edge{DIGIT}")).select(F.col("s").alias("s1"), (F.shiftleft(F.col("prefix") + 1, DIGIT) - 1).alias("wide"))
    rows = wanted.withColumnRenamed("source", "s").join(cut, F.col("s").eqNullSafe(F.col("s0")), "left").join(first, F.col("s").eqNullSafe(F.col("s1")), "left")
    rows = scratch.save(rows.select("s", "source_size", "target", "epochs", F.coalesce("cut", "wide", F.lit(2**KEY_BITS)).alias("cut")), "plan")
    scratch.drop("targets", *[f"edge{shift}" for shift in range(0, KEY_BITS, DIGIT)])
    return rows


def times() -> Column:
    """How often the mix takes a document, by its key and its source's plan."""
    return F.col("epochs") + (F.col("key") <= F.col("cut")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, weight: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document.

    weight: the column of documents' quality weights, null or NaN as the least; by default they follow from the text.
    A null text has size 0; a null source is a source of its own, last in order; sources or
    documents of size 0 take and give nothing; equal rows have equal keys and are chosen
    together; an empty table gives no rows. Only doc_id, text, source and weight are read. The key
    is a digest of the row, so any rerun gives the same mix.
    """
    scratch = common.Scratch(docs.sparkSession, "mix")
    keyed = scratch.save(sized(docs, weight), "keyed")
    planned = plan(keyed, scratch, weights, most)
    return keyed.join(planned, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"))


def sample(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, weight: str | None = None) -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as the mix takes it (documents without words: never)."""
    scratch = common.Scratch(docs.sparkSession, "mix")
    planned = plan(scratch.save(sized(docs, weight), "keyed"), scratch, weights, most)
    scratch.drop("keyed")
    rows = sized(docs, weight, whole=True).join(planned, F.col("source").eqNullSafe(F.col("s")))
    taken = F.when(F.col("size") > 0, times()).otherwise(F.lit(0))
    return rows.withColumn("taken", taken).where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("taken")))).select("row.*").toDF(*docs.columns)

"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source has a target in words. Complete epochs come first: a source whose target holds its whole size e times gives every
document e times. What is left of the target is a sample without replacement, weighted by document quality: every document
draws an exponential key, -ln(u) / weight with u a function of doc_id and seed, and a source's documents are taken in the order
of their keys until the words, summed up in that order, reach the rest of the target; the document at the edge gives the words
that still fit. Keys are cut into slices of their range, so that words are summed by source and slice first, the slices' totals
are run up per source, and only a slice's own rows are sorted together: a source with a third of all rows is many slices.

Defined results: a null source is a source of its own, last; a null or blank text has size 0 and is taken 0 words; rows with
equal doc_id and size share a key and stand in for one another; a null doc_id has a key like any other; a weight that is null or
not positive counts as 1; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, fresh, written

#: Weights of the sources, repeating; words the mix takes over all words; the most epochs a source gives.
WEIGHTS, TOTAL, EPOCHS, SEED = (5, 2, 1), 1.5, 2.0, "mix"
#: Slices of the keys' range.
SLICES = 4096


def words(text: str = "text") -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: str = "doc_id", seed: str = SEED) -> Column:
    """In (0, 1), from the first 52 bits of an MD5: other engines can compute it as well."""
    text = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(f"|{seed}"))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = EPOCHS) -> DataFrame:
    """source, source_size and target, from source and source_size: one row a source, the only rows that are ordered as a whole.

    Shares are proportional to the weights, which go around the sources in order of code point; a share above `most` times its
    source's size is cut to that and the excess shared again. Cut sources are those with the least of most * size / weight:
    with them in that order, the first k are cut for the least k at which no other is."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cap, weight = F.col("source_size") * most, F.element_at(F.array(*map(F.lit, map(float, weights))), (rank % len(weights) + 1).cast("int"))
    rows = sizes.withColumns({"cap": cap, "weight": weight}).withColumn("fills_at", F.col("cap") / F.col("weight"))
    before = Window.orderBy("fills_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({
        "budget": F.sum("source_size").over(everything) * total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
    }).withColumn("level", F.col("budget") / F.col("open"))
    # the level at the first source that does not fill up; sources before it fill up
    level = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "level"))).over(everything)["level"]
    return rows.withColumn("final", level).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[float, ...] = WEIGHTS, total: float = TOTAL, most: float = EPOCHS, seed: str = SEED, slices: int = SLICES, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and the columns carried, for every row of docs. quality: doc_id and weight."""
    sized = docs.select("doc_id", "source", words().alias("size"), *carried)
    if quality is None:
        sized = sized.withColumn("w", F.lit(1.0))
    else:
        known = quality.groupBy(F.col("doc_id").alias("_doc")).agg(F.max("weight").alias("w"))
        sized = sized.join(known, F.col("doc_id") == F.col("_doc"), "left").withColumn("w", F.when(F.col("w") > 0, F.col("w")).otherwise(1.0))
    key = -F.log(uniform("doc_id", seed)) / F.col("w")
    # 1 - exp(-key) spreads keys of weight 1 evenly
    slice_ = F.least(F.floor((1 - F.exp(-F.col("key"))) * slices), F.lit(slices - 1)).cast("int")
    sized = written(sized.withColumn("key", key).withColumn("slice", slice_).drop("w"), "sizes")
    by_slice = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    up_to = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = by_slice.withColumn("before", F.coalesce(F.sum("slice_size").over(up_to), F.lit(0)))
    aims = targets(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, total, most)
    runs = runs.join(aims.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "slice_size")
    runs = runs.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), "before", "source_size", "target")
    met = sized.join(runs, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))).drop("_source", "_slice")
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", *carried).rowsBetween(Window.unboundedPreceding, -1)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    place = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("place")))
    return met.withColumn("epochs", epochs).withColumns({"rest": rest, "place": place}).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), *carried)


def named(docs: DataFrame, name: str = "_row") -> DataFrame:
    """docs with a number for each distinct pair of doc_id and text (null for null is one too)."""
    return docs.withColumn(name, F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce("text", F.lit(""))))


def apply_mix(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """docs as mix() takes them: a document once for each whole time, and cut to the words that fit for the rest.

    Defined results: rows that repeat a doc_id and text give all their words through one of them; rows without doc_id are told apart by
    their text; a text without words is never taken; an empty table gives an empty one; columns are those of docs."""
    row, size, taken, piece = (fresh(x, docs.columns) for x in ("_row", "_size", "_taken", "_words"))
    rows = named(docs, row)
    mixed = mix(rows, quality, carried=(row,))
    times = mixed.where("taken > 0").groupBy(row).agg(F.max("size").alias(size), F.sum("taken").alias(taken))
    # texts move once, by document
    once = rows.repartition(row).dropDuplicates([row])
    met = once.join(times, row)
    pieces = F.transform(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size))), lambda i: F.least(F.col(size), F.col(taken) - (i - 1) * F.col(size)))
    rows = met.withColumn(piece, F.explode(pieces))
    # only a source's edge document is cut
    heads = F.slice(F.expr(f"regexp_extract_all(text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)"), F.lit(1), F.col(piece).cast("int"))
    cut = F.col(piece) < F.col(size)
    rows = rows.withColumn("text", F.when(cut, F.array_join(heads, " ")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(cut, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)

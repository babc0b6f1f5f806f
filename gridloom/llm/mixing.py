"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only.

A source's target divided by its size is the number of copies that each of its
documents is due. The whole part is allocated for certain. The words that are then left
are sampled with probabilities proportional to size (Rosen, "On sampling with probability
proportional to size", 1997): a document of s words has the inclusion probability
p = min(1, a * s), where a is such that the expected words, the sum of p * s, are those
that are left. Documents with p = 1 are certain. The others are ranked by random odds
divided by inclusion odds, [U/(1-U)] / [p/(1-p)], and taken in that order until the words
are reached: a sample of fixed size, in words, in which long documents are likelier than
short ones. The last document taken gives its first words only, as many as are still due,
so every source meets its target.

a comes from a table of the sources' different sizes (no more rows a source than its
longest document has words): the largest sizes are certain while a, from the rest, would
bring them to 1 or more.

Documents are dealt out by ranges of (source, rank variable), which Spark takes from the
rows themselves, and summed up in two levels: within a range and over the ranges of a
source. So a source with a third of all rows is many windows of about the same size,
whatever its documents' sizes are and however many of them are certain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialize, sized

#: Weights by the sources' order, copies at most.
WEIGHTS, MOST_COPIES = (5, 2, 1), 3
#: Hexadecimal digits of the md5 that the random numbers come from: 48 bits.
DIGITS = 12


def word_count(text: Column) -> Column:
    """Runs of characters other than 0x20 and 0x09-0x0D: words start where one follows
    a blank, so it is the number of blanks left when each run of blanks is one."""
    plain = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    return F.coalesce(F.when(plain == "", F.lit(0)).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit(""))) + 1), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int) -> Column:
    """A random number in (0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``(key, source, size)`` per document -> ``(key, source_size, target)`` per source.

    Sources in code point order, null last, weigh as ``weights`` repeats and share all
    sizes; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight. Those that stop are first in the order of size over weight, so
    two running sums over the table of sources (one row a source) find them.
    """
    sources = sizes.groupBy("key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    caps = sources.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most).cast("double"))
    caps = caps.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "key")
    earlier = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    levels = caps.withColumn("level", (total - earlier) / left).withColumn("stops", F.col("ratio") <= F.col("level"))
    first = F.min(F.when(~F.col("stops"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"]
    return levels.select("key", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(first * F.col("weight")).alias("target"))


def inclusion_rates(due: DataFrame) -> DataFrame:
    """``(key, size, rest)`` per document -> ``(key, certain, rate)`` per source: from
    ``certain`` words on a document is included for certain; shorter ones with the
    probability rate * size, such that the expected words are the rest."""
    same = due.groupBy("key", "rest", "size").agg(F.count("*").alias("n"))
    larger = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    smaller = Window.partitionBy("key").orderBy(F.col("size").desc()).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = (F.col("rest") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0))).cast("double")
    squares = F.sum(F.col("n") * F.col("size") * F.col("size")).over(smaller).cast("double")
    rates = same.withColumn("left", left).withColumn("squares", squares)
    rate = F.when(F.col("squares") > 0, F.greatest(F.col("left"), F.lit(0.0)) / F.col("squares")).otherwise(0.0)
    rates = rates.withColumn("rate", rate)
    first = F.max(F.when(F.col("rate") * F.col("size") < 1.0, F.struct("size", "rate")))  # the largest that isn't certain
    found = rates.groupBy("key").agg(first.alias("f"))
    return found.select("key", F.coalesce(F.col("f.size") + 1, F.lit(0)).alias("certain"), F.coalesce(F.col("f.rate"), F.lit(0.0)).alias("rate"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1, key: str | None = None) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)``, a row for each input row.

    taken: words that the mix takes, repeats counted: whole copies for certain, one more
    if sampled, for one document of a source a part. Sizes are words; a null or empty
    text has size 0 and takes 0. Null sources are one source, the last. Null ids share
    one random number; ties are ranked by id and size, and rows that agree in those are
    interchangeable. Reruns agree, whatever the partitions. An empty table gives no rows.
    key: a column that tells rows apart; it breaks the last ties and comes out as well.
    """
    own = [key] if key else []
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))  # never null
    sizes = materialize(docs.select("doc_id", "source", source.alias("key"), word_count(F.col("text")).alias("size"), *own, F.monotonically_increasing_id().alias(free_name("row", docs))), "mix-sizes")
    row = sizes.columns[-1]
    targets = sized(materialize(source_targets(sizes, weights, most), "mix-targets"))
    due = sizes.join(targets, "key")
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size") + 1e-12), F.lit(most))).otherwise(F.lit(0))
    due = due.withColumn("whole", whole.cast("long"))
    rest = F.round("target").cast("long") - F.col("whole") * F.col("source_size")
    due = due.withColumn("rest", F.least(F.greatest(rest, F.lit(0)), F.col("source_size")))
    rates = sized(materialize(inclusion_rates(due), "mix-rates"))
    due = due.join(rates, "key")
    p = F.when(F.col("size") >= F.col("certain"), 1.0).otherwise(F.col("rate") * F.col("size"))
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    u = uniform(F.col("doc_id"), seed)
    odds = (u / (1.0 - u)) / (p / (1.0 - p))
    rank = F.when(F.col("size") >= F.col("certain"), u - 1.0).otherwise(odds / (1.0 + odds))  # certain ones first
    order = ["rank", "doc_id", "size", *own, row]
    dealt = due.withColumn("rank", rank).repartitionByRange("key", *order)
    ranked = materialize(dealt.withColumn("bucket", F.spark_partition_id()), "mix-ranges")

    sums = ranked.groupBy("key", "bucket").agg(F.sum("size").alias("words"))
    earlier = F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("key", "bucket", F.coalesce(earlier, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("key", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranked = ranked.withColumn("inside", F.coalesce(inside, F.lit(0))).join(sized(materialize(sums, "mix-sums")), ["key", "bucket"])
    sampled = F.least(F.greatest(F.col("rest") - F.col("before") - F.col("inside"), F.lit(0)), F.col("size"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + sampled).cast("long").alias("taken"), *own)


def apply_mix(docs: DataFrame, mixed: DataFrame, key: str) -> DataFrame:
    """The documents as the mix takes them: a row for each whole copy, and where a part
    is taken, the text's first words. key: a column of both that is each row's own. A
    document without words stays out, since the mix takes none of its words. Columns of
    ``docs`` other than ``text`` and ``n_chars`` stay as they are, whatever their names."""
    own, part = free_name("_mix", docs), free_name("_part", docs)
    plan = mixed.filter("taken > 0").select(F.col(key), F.struct("size", "taken").alias(own))
    size, taken = F.col(f"{own}.size"), F.col(f"{own}.taken")
    words = taken % size
    cut = F.regexp_extract(F.col("text"), r"\A[\x20\x09-\x0D]*", 0)  # leading blanks aren't words
    split = F.split(F.substr(F.col("text"), F.length(cut) + 1), r"[\x20\x09-\x0D]+")
    begin = F.array_join(F.slice(split, F.lit(1), words.cast("int")), " ")
    none = F.array().cast("array<boolean>")
    whole = F.when(F.floor(taken / size) > 0, F.array_repeat(F.lit(False), F.floor(taken / size).cast("int"))).otherwise(none)
    plan = sized(materialize(plan, "mix-plan"))
    each = docs.join(plan, key).withColumn(part, F.explode(F.concat(whole, F.when(words > 0, F.array(F.lit(True))).otherwise(none))))
    each = each.withColumn("text", F.when(F.col(part), begin).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        each = each.withColumn("n_chars", F.length("text").cast("long"))
    return each.select(*docs.columns)

"""Mixing sources to target weights by Pareto order sampling.

Every source has a target in words. The whole part of target over size is how
many copies all its documents get for certain. The remainder is sampled: a
document's inclusion probability is the remainder's share times its measure, it
gets a random uniform number, and the documents are ranked by the odds of that
number divided by the odds of the inclusion probability. The first in rank, up
to the words that remain, get one copy more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgraph.functions.hashing import portable_uniform
from contactgraph.functions.joins import hot_join
from contactgraph.llm.text import WORD
from contactgraph.session import cut_lineage, fresh_folder

WEIGHTS = (3, 1, 2)
#: Equal ranges of rank in which the words of a source are counted.
BUCKETS = 65_536


def size_in_words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, share: float, most: float, weights: tuple = WEIGHTS) -> DataFrame:
    """``sources`` (one row per source: ``source``, ``source_size``) with ``target``.

    Sources in code-point order, null last, take the ``weights`` in turn and
    share ``share`` times all words by them. A target stops at ``most`` times
    the source's size; what is above goes to the others by weight until none is
    above. With the sources in order of size by weight those that stop come
    first, so running sums tell where it ends. Works on one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    capped = Window.orderBy("by_weight", F.col("source").isNull(), "source")
    everything = Window.partitionBy(F.lit(0))
    before = capped.rowsBetween(Window.unboundedPreceding, -1)
    stops = F.col("source_size") * F.lit(float(most))
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # the level at the first source that does not stop holds for all after it
    return (
        sources.withColumn("weight", weight)
        .withColumns({"stop": stops, "by_weight": stops / F.col("weight")})
        .withColumn("level", level)
        .withColumn("reached", F.min(F.when(F.col("level") <= F.col("by_weight"), F.struct("by_weight", "level"))).over(everything))
        .withColumn("target", F.least(F.col("stop"), F.coalesce(F.col("weight") * F.col("reached.level"), F.col("stop"))))
        .drop("weight", "stop", "by_weight", "level", "reached")
    )


def _key(source: str = "source") -> Column:
    """The source as a key without nulls."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null"))


#: The order in which documents of one source are taken: rows of one rank by what
#: follows, so that repeated rows come one by one.
_ORDER = ["rank", "id", "size", "tie", "place"]


def _drawn() -> Column:
    """What the draw depends on: the id, or the text's hash where there is none."""
    return F.coalesce(F.col("id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string")))


def inclusion_rank(seed: int, inclusion: Column, *ids: str | Column) -> Column:
    """The odds of a uniform number by the odds of ``inclusion``, as a number from 0 to 1."""
    u, p = portable_uniform(seed, *ids), inclusion
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def cut_table(
    sized: DataFrame, share: float, most: float, weights: tuple, power: float, seed: int
) -> DataFrame:
    """One row per source: what its documents get for certain and where its
    sample ends. ``sized`` has ``id, source, size, tie, place`` and is read several times.

    The rank at which a sample ends is found from the words in ``BUCKETS`` equal
    ranges of rank, a count with a map-side aggregate, and then within the one
    range where the remainder is reached: no source is sorted or gathered,
    however large. The words taken miss the target by at most half of the
    document at the cut.
    """
    # thousandths as whole numbers: a sum of doubles would depend on the order
    measured = F.floor(_measure(power) * F.col("size") * 1000).cast("decimal(38,0)")
    sums = sized.groupBy("source").agg(
        F.sum("size").alias("source_size"), (F.sum(measured).cast("double") / 1000).alias("measured")
    )
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = cut_lineage(
        targets(sums, share, most, weights)
        .withColumn("whole", F.floor(ratio))
        .withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("scale", F.when(F.col("measured") > 0, F.col("goal") / F.col("measured")).otherwise(0.0))
        .withColumn("key", _key())
        .drop("source", "measured")
    )
    ranked = _ranked(hot_join(sized.withColumn("key", _key()), plan, "key"), power, seed).filter("goal > 0")
    in_order = Window.partitionBy("key").orderBy("bucket")
    cuts = cut_lineage(
        ranked.groupBy("key", "bucket")
        .agg(F.sum("size").alias("words"), F.max("goal").alias("goal"))
        .withColumn("reached", F.sum("words").over(in_order))
        .filter("reached >= goal")
        .groupBy("key")
        .agg(F.min(F.struct("bucket", "reached", "words")).alias("cut"))
        .select("key", F.col("cut.bucket").alias("at"), (F.col("cut.reached") - F.col("cut.words")).alias("base"))
    )
    by_rank = Window.partitionBy("key").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("base") + F.sum("size").over(by_rank) - F.col("size") / 2
    last = (
        hot_join(ranked, cuts, "key")
        .filter(F.col("bucket") == F.col("at"))
        .withColumn("taken", middle <= F.col("goal"))
        .groupBy("key")
        .agg(F.max(F.when(F.col("taken"), F.struct(*_ORDER))).alias("last"))
    )
    table = plan.join(cuts.drop("base"), "key", "left").join(last, "key", "left")
    # written and read again, so that its size is known where it is joined
    path = fresh_folder(sized.sparkSession, "mixing-cuts")
    table.write.parquet(path)
    return sized.sparkSession.read.parquet(path)


def _measure(power: float) -> Column:
    return F.sqrt("size") if power == 0.5 else F.pow("size", F.lit(power))


def _ranked(rows: DataFrame, power: float, seed: int) -> DataFrame:
    inclusion = F.least(F.greatest(F.col("scale") * _measure(power), F.lit(1e-9)), F.lit(1 - 1e-9))
    return rows.withColumn("rank", inclusion_rank(seed, inclusion, _drawn())).withColumn(
        "bucket", F.floor(F.col("rank") * BUCKETS).cast("int")
    )


def with_copies(rows: DataFrame, cuts: DataFrame, power: float, seed: int) -> DataFrame:
    """``rows`` (with ``id, source, size, tie, place``) and their ``source_size, target, copies``."""
    ranked = _ranked(hot_join(rows.withColumn("key", _key()), cuts, "key"), power, seed)
    at_cut = F.coalesce(F.struct(*_ORDER) <= F.col("last"), F.lit(False))
    extra = (F.col("goal") > 0) & (
        F.col("at").isNull() | (F.col("bucket") < F.col("at")) | ((F.col("bucket") == F.col("at")) & at_cut)
    )
    return ranked.withColumn("copies", F.col("whole") + extra.cast("bigint")).select(
        *rows.columns, "source_size", "target", "copies"
    )


def mix(
    docs: DataFrame,
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple = WEIGHTS,
    power: float = 0.5,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple = (),
) -> DataFrame:
    """``id, source, size, source_size, target, copies, taken`` per row of ``docs``,
    and the columns named in ``carry``.

    Sizes are in words. :func:`targets` gives each source its words; the measure
    of a document is its size to the ``power``, so that long documents are
    likelier than short ones but less than in proportion. ``copies`` is at most
    ``most`` rounded up, and ``taken`` is copies times size. Null texts have size
    0 and a null source is a source. The draw is a hash of seed and id, of the text
    where there is no id, so reruns agree; rows of one id are taken in order of
    their texts' hashes, and equal rows one by one, by their place in the table,
    which the table's files decide. Runs jobs.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(source_col).cast("string").alias("source"),
        size_in_words(text_col).alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie"),
        F.monotonically_increasing_id().alias("place"),
        *[F.col(c).alias(f"_carried_{c}") for c in carry],
    )
    sized = cut_lineage(rows.select("id", "source", "size", "tie", "place"))
    cuts = cut_table(sized, share, most, weights, power, seed)
    return (
        with_copies(rows if carry else sized, cuts, power, seed)
        .drop("tie", "place")
        .withColumn("taken", F.col("copies") * F.col("size"))
        .withColumnsRenamed({f"_carried_{c}": c for c in carry})
    )


def resample(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with every row as often as the mix takes it, same columns.

    ``id_col``, ``text_col`` and ``source_col`` name the columns as for :func:`mix`."""
    own = "row"
    while own in docs.columns:
        own = f"_{own}"
    carried = docs.select(F.struct(*docs.columns).alias(own), *docs.columns)
    mixed = mix(carried, carry=(own,), **options)
    times = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return mixed.select(F.col(own).alias("row"), times.alias("n")).select("row.*")

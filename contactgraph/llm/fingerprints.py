"""Document fingerprints: SimHash in DataFrame operations alone.

The terms of a text are its lower-cased word pairs. Every occurrence votes, with
the weight of the term, for the signs of the 64 bits of the term's hash; a bit of
the fingerprint is one where the votes for one prevail. Fingerprints within a
radius are found in permuted block tables: the bits are cut into blocks, and two
fingerprints that differ in at most ``radius`` bits agree in all blocks but
``radius`` at most, so some choice of ``blocks - radius`` blocks is equal in both.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactgraph.functions.joins import hot_join
from contactgraph.llm.text import words_column

BITS = 64
#: The weight of a term is its length in code points, at most this.
HEAVIEST = 16
#: Blocks of neighbouring ids are cut at quantiles: so many blocks for each
#: shuffle partition, in two levels of at most ``FAN`` each.
BLOCKS_PER_PARTITION, FAN = 4, 100
#: One bit of each half of a hash, so that one sum counts the votes for two bits.
_TWO_LANES = (1 << 32) | 1


def vote(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` (which identify the row) and ``fp``, the fingerprint of ``text``.

    The words are exploded and aggregated by the row in the same task if the
    rows are partitioned by some of the keys. A sum holds the votes for bit i
    in its lower and for bit i + 32 in its upper half, so weights may add up to
    2 ** 31 within a text. Texts without words have fingerprint zero.
    """
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("_words") - 1, F.lit(1)))).alias("_at")
    terms = (
        rows.select(*keys, words_column(F.lower(F.col(text))).alias("_words"))
        .select(*keys, "_words", at)
        .select(
            *keys,
            F.concat_ws(" ", F.get("_words", F.col("_at") - 1), F.get("_words", F.col("_at"))).alias("_term"),
        )
    )
    weighted = terms.select(
        *keys,
        F.xxhash64("_term").alias("_h"),
        F.least(F.length("_term"), F.lit(HEAVIEST)).cast("bigint").alias("_w"),
    )
    lanes = [
        F.sum(F.col("_w") * F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_TWO_LANES))).alias(f"_v{i}")
        for i in range(32)
    ]
    votes = weighted.groupBy(*keys).agg(F.sum("_w").alias("_all"), *lanes)
    fp = F.lit(0).cast("bigint")
    for i in range(32):
        low = F.col(f"_v{i}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("_all")
        high = F.shiftrightunsigned(f"_v{i}", 32) * 2 > F.col("_all")
        fp = fp.bitwiseOR(F.when(low, F.lit(_signed(1 << i))).otherwise(F.lit(0).cast("bigint")))
        fp = fp.bitwiseOR(F.when(high, F.lit(_signed(1 << (i + 32)))).otherwise(F.lit(0).cast("bigint")))
    return votes.select(*keys, fp.alias("fp"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal bits of two fingerprints."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _bounds(docs: DataFrame, id_col: str) -> list[int]:
    """Ids at which blocks end, the largest last; at most ``FAN ** 2`` of them."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = min(FAN * FAN, max(1, BLOCKS_PER_PARTITION * partitions))
    shares = F.array(*[F.lit((k + 1) / blocks) for k in range(blocks)])
    # bounded by the number of blocks
    found = docs.agg(F.percentile_approx(id_col, shares, 20 * blocks).alias("b"), F.max(id_col).alias("m")).first()
    return sorted({*(found["b"] or []), found["m"]} - {None})


def _block_of(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below ``key``, by two short searches."""
    if not bounds:
        return F.lit(0)

    def below(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: b < key))

    def longs(values) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in values])

    parts = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]
    part = F.least(below(longs([p[-1] for p in parts])), F.lit(len(parts) - 1))
    within = below(F.get(F.array(*[longs(p) for p in parts]), part))
    return F.coalesce(part * FAN + within, F.lit(0))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``block, place, donor, id, text, next_text``: every document beside the
    text of the next one in descending id, the first coming after the last.

    Blocks of neighbouring ids are cut at quantiles of the ids, which are ids
    themselves, so the document that follows a block is known to be the one at
    the bound below and is sent along as a donor. Texts are shuffled once, and
    no task holds more than a block in order. Rows are identified by block and
    place; donors are not results. Null ids come last, equal ids by text.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    bounds = _bounds(rows, "id")
    block = _block_of(F.col("id"), bounds)
    places = F.array(F.struct(F.col("_block").alias("block"), F.lit(False).alias("donor")))
    if bounds:
        ends = F.array(*[F.lit(b).cast("bigint") for b in bounds])
        follower = F.pmod(F.col("_block") + 1, F.lit(len(bounds)))
        places = F.when(
            F.get(ends, F.col("_block")) == F.col("id"),
            F.concat(places, F.array(F.struct(follower.alias("block"), F.lit(True).alias("donor")))),
        ).otherwise(places)
    order = Window.partitionBy("block").orderBy("donor", F.col("id").desc_nulls_last(), "text")
    return (
        rows.withColumn("_block", block)
        .select("id", "text", F.explode(places).alias("at"))
        .select("at.block", "at.donor", "id", "text")
        .withColumn("place", F.row_number().over(order))
        .withColumn("next_text", F.coalesce(F.lead("text").over(order), F.first("text").over(order)))
    )


def fingerprint_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, edited_sha256, fp, edited_fp, next_fp`` per row of ``docs``.

    The edited text keeps a text's first half, rounded up, and ends with as many
    of the first code points of the next document. Null texts count as empty.
    Everything after the one shuffle of the texts is done block by block.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, n_chars - half)"), F.expr("left(next_text, half)"))
    keys = ["block", "place", "donor", "id", "n_chars", "edited_sha256"]
    rows = (
        with_next(docs, id_col, text_col)
        .withColumn("n_chars", F.length("text"))
        .withColumn("half", half)
        .withColumn("edited", edited)
        .withColumn("edited_sha256", F.sha2("edited", 256))
        .select(
            *keys,
            F.explode(
                F.array(
                    F.struct(F.lit(0).alias("which"), F.col("text").alias("body")),
                    F.struct(F.lit(1).alias("which"), F.col("edited").alias("body")),
                )
            ).alias("e"),
        )
        .select(*keys, "e.which", "e.body")
    )
    order = Window.partitionBy("block").orderBy("place")
    return (
        vote(rows, [*keys, "which"], "body")
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("which") == 0, F.col("fp"))).alias("fp"),
            F.max(F.when(F.col("which") == 1, F.col("fp"))).alias("edited_fp"),
        )
        .withColumn("next_fp", F.coalesce(F.lead("fp").over(order), F.first("fp").over(order)))
        .filter(~F.col("donor"))
        .select("id", F.col("n_chars").cast("bigint").alias("n_chars"), "edited_sha256", "fp", "edited_fp", "next_fp")
    )


def block_masks(radius: int, blocks: int) -> list[int]:
    """One mask for each choice of ``blocks - radius`` of the blocks."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("the radius must be below the number of blocks")
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(i, j)) for i, j in zip(cuts, cuts[1:])]
    return [_signed(sum(chosen)) for chosen in combinations(parts, blocks - radius)]


def within_radius(queries: DataFrame, index: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """``(query_fp, fp, distance)``: of every value of ``queries.fp`` all values of
    ``index.fp`` at most ``radius`` bits away, itself included. Both columns are
    distinct longs; nulls find nothing.

    Each value has one row per table; rows meet by the bits the table keeps, and
    a pair that meets in several tables counts in the first.
    """
    masks = F.array(*[F.lit(m) for m in block_masks(radius, blocks)])

    def keyed(values: DataFrame, name: str) -> DataFrame:
        return (
            values.filter("fp is not null")
            .select(F.col("fp").alias(name), F.posexplode(masks).alias("table", "mask"))
            .select(name, F.xxhash64("table", F.col(name).bitwiseAND(F.col("mask"))).alias("key"), "table")
        )

    apart = F.col("query_fp").bitwiseXOR(F.col("fp"))
    left, right = keyed(queries, "query_fp"), keyed(index, "fp").withColumnRenamed("table", "own_table")
    first = F.array_position(F.transform(masks, lambda m: apart.bitwiseAND(m) == 0), True) - 1
    near = (left["key"] == right["key"]) & (left["table"] == right["own_table"])
    return (
        left.join(right, near & (F.bit_count(apart) <= radius) & (first == left["table"]))
        .select("query_fp", "fp", F.bit_count(apart).alias("distance"))
    )


def count_within(prints: DataFrame, asks: Column, radius: int = 3, blocks: int = 6) -> DataFrame:
    """``prints`` (with ``fp``) and ``n_near``: for the rows that ``asks`` selects
    the number of other rows within ``radius`` bits, null for the others. Equal
    fingerprints are counted before the search."""
    index = prints.filter("fp is not null").groupBy("fp").agg(F.count("*").alias("n"))
    queries = prints.filter(asks).select("fp").distinct()
    found = hot_join(within_radius(queries, index.select("fp"), radius, blocks), index, "fp")
    near = found.groupBy(F.col("query_fp").alias("fp")).agg((F.sum("n") - 1).alias("_near"))
    return hot_join(prints, near, "fp", "left").withColumn("n_near", F.when(asks, F.col("_near"))).drop("_near")

"""Top N items within every group by simultaneous bisection.

Every row has an order-preserving code: the score's 64 bits in two halves, then the item's bytes
(inverted, so that smaller items win ties) in steps of seven. All groups refine their cutoffs at the
same time: a round counts each group's rows per slice of its current interval (counts combine on the
map side, so a group of millions of rows sends at most one count per slice and task), finds the slice
that holds the N-th row, takes the rows above it as winners, drops those below and goes on with the
slice, narrowed to the codes seen in it. A group ends when exactly N rows are taken. Rows of a round
that are neither are gone for the next. No group is ever sorted or brought together: the rows meet their
group's cutoff by a join on the group and a salt, of which a group has one for every ``hot_rows`` of its
rows that are left, and the cutoff is copied to each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from quarterloom.session import discard, written

#: The list of groups that are salted in the first round is broadcast; it is kept below this length.
BROADCAST_ROWS = 100_000
SLICES = 64
#: In the first round the upper half's highest bits (sign and exponent of the score) are the slices.
FIRST_BITS = 12
HALF, CHUNK = 2**32, 2**56


def _bits(score: Column) -> Column:
    """A double as a bigint in the same order; -0.0 counts as 0.0."""
    raw = F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToLongBits"), score + F.lit(0.0)).cast("bigint")
    return F.when(raw >= 0, raw).otherwise(raw.bitwiseXOR(F.lit(2**63 - 1)))


def _code(level: Column) -> Column:
    """The row's code at a level: 0 and 1 are the score's halves, then come seven bytes of the item
    each, inverted; past the item's end a code above all bytes', the higher the shorter the item."""
    part = F.rpad(F.hex(F.col("__item")).substr((level - 2) * 14 + 1, F.lit(14)), 14, "0")
    item = F.lit(CHUNK - 1) - F.conv(part, 16, 10).cast("bigint")
    end = F.lit(2 * CHUNK) - F.octet_length("__item")
    return F.when(level == 0, F.col("__hi")).when(level == 1, F.col("__lo")).when(level < F.col("__levels"), item).otherwise(end)


def _with_salts(rows: DataFrame, names: list[str], hot_rows: int) -> DataFrame:
    """Adds the number of salts of the row's group. Only groups with more rows than ``hot_rows`` have several, or, on
    very many rows, than the BROADCAST_ROWS-th part of all: fewer than BROADCAST_ROWS groups can have that many."""
    least = max(hot_rows, rows.count() // BROADCAST_ROWS + 1)
    hot = written(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("__c")).filter(F.col("__c") > least), "hot")
    if hot.isEmpty():
        return rows.withColumn("__salts", F.lit(1))
    hot = hot.select(*[F.col(x).alias(f"{x}_") for x in names], F.ceil(F.col("__c") / hot_rows).cast("int").alias("__salts"))
    on = F.lit(True)
    for x in names:
        on = on & F.col(x).eqNullSafe(F.col(f"{x}_"))
    return rows.join(F.broadcast(hot), on, "left").select(*rows.columns, F.coalesce("__salts", F.lit(1)).alias("__salts"))


def top_n(df: DataFrame, group: Sequence[str], score: str, item: str, n: int, hot_rows: int = 500_000) -> DataFrame:
    """The ``n`` items with the highest score of every group: group, item (string), score (double).

    Equal scores: the smaller item (by its UTF-8 bytes) first. Rows whose score is NULL or NaN or
    whose item is NULL are not ranked; infinite scores are. Rows equal in group, item and score are
    one; an item with several scores is ranked with each. NULL group keys form a group. Groups with
    up to ``n`` items give all of them, an empty table none; other columns are ignored. ``hot_rows``
    bounds the rows of one group that one task reads; it does not change the result.
    """
    names = [f"__g{i}" for i in range(len(group))]
    rows = (
        df.select(*[F.col(g).alias(x) for g, x in zip(group, names)], F.col(item).cast("string").alias("__item"), F.col(score).cast("double").alias("__score"))
        .filter(F.col("__item").isNotNull() & F.col("__score").isNotNull() & ~F.isnan("__score"))
        .distinct()
    )
    bits = _bits(F.col("__score"))
    rows = rows.withColumn("__bits", bits).select(
        *names, "__item", "__score", (F.shiftright("__bits", 32) + HALF // 2).alias("__hi"), F.col("__bits").bitwiseAND(F.lit(HALF - 1)).alias("__lo"),
        (F.ceil(F.octet_length("__item") / 7) + 2).cast("int").alias("__levels"),
    )
    ranked = written(rows, "ranked")
    live = _with_salts(ranked, names, hot_rows).withColumns({"__level": F.lit(0), "__need": F.lit(n).cast("bigint"), "__v": F.col("__hi"), "__slice": F.shiftright("__hi", 32 - FIRST_BITS)})
    done, state = [], ["__level", "__need", "__v", "__slice", "__salts"]
    while True:
        per_slice = live.groupBy(*names, "__slice").agg(
            F.count(F.lit(1)).alias("__c"), F.min("__v").alias("__min"), F.max("__v").alias("__max"), F.max("__need").alias("__n"), F.max("__salts").alias("__salts")
        )
        down = W.partitionBy(*names).orderBy(F.desc("__slice"))  # at most one row per slice
        cum = per_slice.withColumn("__cum", F.sum("__c").over(down)).withColumn("__least", F.min("__slice").over(W.partitionBy(*names)))
        # the slice that reaches the N-th row; groups that never reach it stop at their last slice
        at = cum.filter(((F.col("__cum") >= F.col("__n")) & (F.col("__cum") - F.col("__c") < F.col("__n"))) | ((F.col("__slice") == F.col("__least")) & (F.col("__cum") < F.col("__n"))))
        at = at.select(
            *[F.col(x).alias(f"{x}_") for x in names], F.col("__slice").alias("__cut"), "__min", "__max", (F.col("__cum") <= F.col("__n")).alias("__all"), (F.col("__n") - F.col("__cum") + F.col("__c")).alias("__left"),
            F.ceil(F.col("__c") / hot_rows).cast("int").alias("__next"), F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__part"),
        )
        on = F.pmod(F.xxhash64("__item", "__score"), F.col("__salts")) == F.col("__part")
        for x in names:
            on = on & F.col(x).eqNullSafe(F.col(f"{x}_"))
        kept = live.join(at, on).filter(F.col("__slice") >= F.col("__cut"))
        win = (F.col("__slice") > F.col("__cut")) | F.col("__all")
        tied = F.col("__min") == F.col("__max")
        level = F.when(tied, F.col("__level") + 1).otherwise(F.col("__level"))
        kept = written(kept.select(*names, "__item", "__score", "__hi", "__lo", "__levels", win.alias("__win"), level.alias("__level"), F.col("__left").alias("__need"), F.col("__next").alias("__salts"), "__min", "__max", tied.alias("__tied")), "cut")
        if not done:
            discard(ranked)
        done.append(kept.filter("__win").select(*names, "__item", "__score"))
        live = kept.filter(~F.col("__win"))
        if live.isEmpty():
            break
        low = F.when(F.col("__tied"), F.lit(0)).otherwise(F.col("__min"))
        high = F.when(F.col("__tied"), F.when(F.col("__level") == 1, F.lit(HALF - 1)).otherwise(F.lit(2 * CHUNK))).otherwise(F.col("__max"))
        live = live.withColumn("__v", _code(F.col("__level"))).withColumn("__slice", F.floor((F.col("__v") - low) / (high - low + 1) * SLICES))
        live = live.select(*names, "__item", "__score", "__hi", "__lo", "__levels", *state)
    won = done[0]
    for d in done[1:]:
        won = won.unionByName(d)
    return won.select(*[F.col(x).alias(g) for g, x in zip(group, names)], F.col("__item").alias(item), F.col("__score").alias(score))

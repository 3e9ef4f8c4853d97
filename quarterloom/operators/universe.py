"""Building and auditing a security universe: keys, look-ups, matches, de-duplication, calendars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pad_cusip(c: Column) -> Column:
    """Trimmed, zero-padded on the left and cut to nine characters; NULL and empty give nine zeros."""
    return F.lpad(F.coalesce(F.trim(c), F.lit("")), 9, "0")


def first_words(c: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(F.split(F.trim(c), r"\s+"), 1, n), " ")


def is_empty_key(c: Column) -> Column:
    return c.isNull() | c.isin("", "0", "000000000")


def split_valid(df: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """Rows with all keys given, and the others."""
    bad = is_empty_key(F.col(keys[0]))
    for k in keys[1:]:
        bad = bad | is_empty_key(F.col(k))
    return df.filter(~bad), df.filter(bad)


def oldest_only(df: DataFrame, keys: Sequence[str], at: str, tie: Sequence[str]) -> DataFrame:
    """Drops, for each key by itself, all but the oldest row of every non-empty value; both judgements
    are made on the original rows. A struct minimum per value replaces a sort of the value's rows."""
    order = F.struct(F.col(at), *[F.col(t) for t in tie])
    flagged = df.withColumn("__order", order)
    drop = F.lit(False)
    for i, k in enumerate(keys):
        least = df.filter(~is_empty_key(F.col(k))).groupBy(F.col(k).alias(f"__k{i}")).agg(F.min(order).alias(f"__least{i}"))
        flagged = flagged.join(least, F.col(k) == F.col(f"__k{i}"), "left")
        drop = drop | F.coalesce(F.col(f"__least{i}") < F.col("__order"), F.lit(False))
    return flagged.filter(~drop).select(*df.columns)


def lookup_padded(df: DataFrame, reference: DataFrame, key: str, ref_key: str, value: str) -> DataFrame:
    """A reference value by the key as written, else by the padded key."""
    r = reference.groupBy(ref_key).agg(F.min(value).alias("__v"))
    a = r.select(F.col(ref_key).alias("__ka"), F.col("__v").alias("__va"))
    b = r.select(F.col(ref_key).alias("__kb"), F.col("__v").alias("__vb"))
    got = df.join(a, F.col(key) == F.col("__ka"), "left").join(b, pad_cusip(F.col(key)) == F.col("__kb"), "left")
    return got.withColumn(value, F.coalesce("__va", "__vb")).drop("__ka", "__kb", "__va", "__vb")


def most_frequent(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The mode per group and its count; ties: the smallest value."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__n"))
    return n.groupBy(*group).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*group, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


#: Characters of a name by which issuers that may contain it are found.
LEAD = 6


def match_names(names: DataFrame, issuers: DataFrame, name: str, issuer: str, value: str, words: int = 3, whole_first: bool = False) -> DataFrame:
    """For each name the most frequent value among issuers that contain its first words.

    Issuers are counted per distinct (issuer, value) first. Candidates are the issuers that contain, at
    any position, the words' first ``LEAD`` characters (all of them, if fewer): an equi-join on pieces of
    the issuers that loses no containment, so no pair of unrelated names is formed.
    ``whole_first``: only issuers in which the first word stands between blanks.
    """
    n = names.select(name).distinct().withColumn("__w", first_words(F.col(name), words)).filter(F.col("__w") != "")
    n = n.withColumn("__lead", F.substring("__w", 1, LEAD))
    i = issuers.filter(F.col(issuer).isNotNull()).groupBy(issuer, value).agg(F.count(F.lit(1)).alias("__n"))
    lengths = F.broadcast(n.select(F.length("__lead").alias("__k")).distinct())  # at most LEAD rows
    at = i.select(issuer).distinct().join(lengths, F.length(issuer) >= F.col("__k"))
    pieces = F.transform(F.sequence(F.lit(1), F.length(issuer) - F.col("__k") + 1), lambda p: F.substring(F.col(issuer), p, F.col("__k")))
    at = at.select(issuer, F.explode(F.array_distinct(pieces)).alias("__lead"))
    hit = n.join(at, "__lead").filter(F.instr(F.col(issuer), F.col("__w")) > 0)
    if whole_first:
        hit = hit.filter(F.array_contains(F.split(F.col(issuer), " "), F.substring_index("__w", " ", 1)))
    per = hit.select(name, issuer).join(i, issuer).groupBy(name, value).agg(F.sum("__n").alias("__n"))
    return per.groupBy(name).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(name, F.col("m.v").alias(value), (-F.col("m.n")).alias("n"))


def asof_next(dates: DataFrame, calendar: DataFrame, at: str, day: str, within: int = 10) -> DataFrame:
    """For each date the first calendar day on or after it, at most ``within`` days later, by an
    equi-join on the days that may be it; NULL if there is none."""
    want = dates.select(at).distinct().withColumn("__d", F.explode(F.sequence(F.col(at), F.date_add(at, within))))
    got = want.join(calendar.select(F.col(day).alias("__d")).distinct(), "__d").groupBy(at).agg(F.min("__d").alias("next_day"))
    return dates.join(got, at, "left")


def quarter_ends(year: Column) -> Column:
    return F.array(*[F.last_day(F.make_date(year, F.lit(3 * q), F.lit(1))) for q in range(1, 5)])


def nearest_quarter_end(d: Column) -> Column:
    """Of the year's four quarter ends the nearest, the earlier on ties."""
    return F.array_min(F.transform(quarter_ends(F.year(d)), lambda q: F.struct(F.abs(F.datediff(d, q)).alias("n"), q.alias("q"))))["q"]


def quarter_starts(spark, start: str, end: str) -> DataFrame:
    """First days of the quarters in [start, end)."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1), F.expr("interval 3 month"))).alias("period_start"))


def outer_with_origin(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer join of two maps with the origin of each key and the left value before the right."""
    l, r = left.select(F.col(key).alias("__k"), F.col(value).alias("__l")), right.select(F.col(key).alias("__j"), F.col(value).alias("__r"))
    got = l.join(r, F.col("__k") == F.col("__j"), "full_outer")
    origin = F.when(F.col("__k").isNull(), "right_only").when(F.col("__j").isNull(), "left_only").otherwise("both")
    return got.select(F.coalesce("__k", "__j").alias(key), F.coalesce("__l", "__r").alias(value), origin.alias("origin"), F.coalesce(F.col("__l") == F.col("__r"), F.lit(False)).alias("same"))


def first_then_newest(df: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """First sighting fixes the year; the newest non-empty value wins."""
    v = F.when(~is_empty_key(F.col(value)), F.struct(F.col(at), F.col(value)))
    return df.groupBy(key).agg(F.min(at).alias("first_at"), F.max(v)[value].alias(value))

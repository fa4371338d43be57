"""Relational idioms as DataFrame functions. Every choice of a row has a total order given by the caller."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import past, scanned, upto


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given (Spark cuts each partition to its first row before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def flagged_first(df: DataFrame, keys: list[str], flag: Column, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place in their key: those for which ``flag`` holds come first, then by ``order``; unknown counts as no."""
    w = Window.partitionBy(*keys).orderBy(F.coalesce(flag, F.lit(False)).desc(), *order)
    return df.withColumn(name, F.row_number().over(w).cast("long"))


def union_by_precedence(parts: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of several parsers as one: of a key that several give, the earliest parser's stays, then the first by ``order``.

    Columns that a parser lacks are null. Null keys are keys.
    """
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("_from", F.lit(i)) for i, p in enumerate(parts)])
    return latest_per_key(every, keys, [F.col("_from"), *order]).drop("_from")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Order-preserving dedup."""
    return latest_per_key(df, keys, order)


def null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Semi or anti join whose keys compare nulls as equal (stays an equi-join)."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
    return left.join(r, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]), how)


def null_safe_lookup(df: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``df`` with the columns of ``facts``, which has one row a key; null keys are equal."""
    return df.join(facts.withColumnRenamed(key, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows, and the first incoming row of each key that they lack."""
    new = null_safe(first_wins(incoming, keys, order), existing, keys, "left_anti")
    return existing.unionByName(new)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], updated: list[str], keep_first_known: list[str] = ()) -> DataFrame:
    """Append log with one row a key: ``updated`` columns from the newest row, others from the oldest.

    ``keep_first_known`` columns take the oldest value that isn't null. ``order`` sorts incoming rows; existing ones
    come before them. Grouping treats null keys as equal.
    """
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    at = F.struct("_new", *order)
    aggs = []
    for c in existing.columns:
        if c in keys:
            continue
        if c in keep_first_known:
            aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c))
        else:
            aggs.append((F.max_by if c in updated else F.min_by)(F.struct(c), at)[c].alias(c))
    return both.groupBy(*keys).agg(*aggs).select(existing.columns)


def wildcard_join(df: DataFrame, policy: DataFrame, key: str, scope: str, value: str) -> DataFrame:
    """The policy row of equal key, or else the ``*`` row of the same scope (policies are a bounded dimension)."""
    exact = policy.where(F.col(key) != "*").select(key, F.struct(value).alias("_e"))
    star = policy.where(F.col(key) == "*").select(scope, F.struct(value).alias("_s"))
    return df.join(exact, key, "left").join(star, scope, "left").withColumn(value, F.coalesce("_e", "_s")[value]).drop("_e", "_s")


def rolling_count(df: DataFrame, keys: list[str], ts: str, hours: int, row_id: str) -> DataFrame:
    """Rows of the key in the ``hours`` up to each row (``row_id`` is unique), its own instant included on both ends.

    Rows are dealt by key and hour, so a key with all rows has a task an hour. A row's count is that of whole hours
    (a window over one row an hour), and of the two hours that its window cuts: in its own it counts what isn't later,
    and in the first, by a probe that it sends there, what isn't earlier than the window's start.
    """
    hour = 3_600_000_000
    rows = df.select(*keys, row_id, F.unix_micros(F.col(ts).cast("timestamp")).alias("_us"))
    at = lambda shift: F.floor((F.col("_us") - shift) / hour).cast("long")
    own = rows.select(*keys, row_id, "_us", at(0).alias("_h"), F.lit(1).alias("_row"))
    probes = rows.select(*keys, row_id, (F.col("_us") - hours * hour).alias("_us"), at(hours * hour).alias("_h"), F.lit(0).alias("_row"))
    upto = Window.partitionBy(*keys, "_h").orderBy("_us")
    seen = own.unionByName(probes).select(
        row_id, "_row",
        F.when(F.col("_row") == 1, F.sum("_row").over(upto.rangeBetween(Window.unboundedPreceding, 0))).otherwise(-F.coalesce(F.sum("_row").over(upto.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_n"),
    )
    by_hour = Window.partitionBy(*keys).orderBy("_h")
    whole = own.groupBy(*keys, "_h").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(by_hour.rangeBetween(-hours, -1)), F.lit(0)))
    parts = seen.groupBy(row_id).agg(F.sum("_n").alias("_n"))
    same = [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys]
    sums = whole.select(*[F.col(k).alias(f"_w_{k}") for k in keys], F.col("_h").alias("_wh"), "_before")
    placed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_h", at(0))
    out = placed.join(sums, reduce(lambda a, b: a & b, [*same, F.col("_h") == F.col("_wh")])).join(parts, row_id)
    return out.withColumn("in_window", (F.col("_before") + F.col("_n")).cast("long")).select(*df.columns, "in_window")


def throttled(df: DataFrame, keys: list[str], ts: str, seconds: float, tie: str) -> DataFrame:
    """Rows with ``starts_at``: each key's rows in their order, none sooner than ``seconds`` after the one before it starts.

    Start n is the greatest of (time j + (n - j) * seconds) over the rows up to it: a scan by hours, in which an hour
    hands on how many rows it has and the greatest of their (time - number * seconds).
    """
    gap = round(seconds * 1_000_000)
    rows = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    out = scanned(
        rows, keys, ["_us", tie], F.floor(F.col("_us") / 3_600_000_000),
        [{"_n": lambda w: F.row_number().over(w).cast("long")}, {"_own": lambda w: F.max(F.col("_us") - F.col("_n") * gap).over(upto(w))}],
        {"_count": F.count("*"), "_top": F.max("_own")},
        [{"_off": lambda w: F.coalesce(F.sum("_count").over(past(w)), F.lit(0))}, {"_best": lambda w: F.max(F.col("_top") - F.col("_off") * gap).over(past(w))}],
    )
    least = F.greatest(F.col("_best"), F.col("_own") - F.col("_off") * gap)
    return out.withColumn("starts_at", F.timestamp_micros(least + (F.col("_off") + F.col("_n")) * gap)).select(*df.columns, "starts_at")


def union_years(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(key, days, years): the union of each key's intervals, years floored to one decimal.

    Days are bits of words of 64, so that the union is one aggregate; an interval is a row for each word that it touches.
    An interval that ends before it begins counts nothing; one without an end is unknown, one without a start goes.
    """
    a, z = (F.unix_date(F.col(c).cast("date")) for c in (start, end))
    first = F.floor(a / 64).cast("int")
    touched = df.where(F.col(start).isNotNull()).select(key, a.alias("_a"), z.alias("_z"), F.explode(F.sequence(first, F.coalesce(F.greatest(first, F.floor((z - 1) / 64).cast("int")), first))).alias("_word"))
    lo, hi = F.greatest(F.col("_a") - F.col("_word") * 64, F.lit(0)), F.least(F.col("_z") - F.col("_word") * 64, F.lit(64))
    bits = F.when(F.col("_z") > F.col("_a"), F.call_function("shiftleft", F.expr("-1L"), lo).bitwiseAND(F.call_function("shiftrightunsigned", F.expr("-1L"), 64 - hi))).when(F.col("_z").isNotNull(), F.expr("0L"))
    held = touched.select(key, "_word", bits.alias("_bits")).groupBy(key, "_word").agg(F.bit_or("_bits").alias("_bits"))
    return held.groupBy(key).agg(F.sum(F.bit_count("_bits")).alias("days")).withColumn("years", F.floor(F.col("days") / F.lit(365.25) * 10) / 10.0)


def window_frees_at(df: DataFrame, keys: list[str], ts: str, as_of: Column, hours: int) -> DataFrame:
    """When the oldest row of the window leaves it, and how many it holds."""
    inside = df.where((F.col(ts) > as_of - F.make_dt_interval(hours=F.lit(hours))) & (F.col(ts) <= as_of))
    return inside.groupBy(*keys).agg(F.count("*").alias("spent"), (F.min(ts) + F.make_dt_interval(hours=F.lit(hours))).alias("frees_at"))


def share_of_group(df: DataFrame, keys: list[str], value: str, least: float) -> DataFrame:
    """Rows that hold at least a share of their group's total."""
    totals = df.groupBy(F.struct(*keys).alias("_key")).agg(F.sum(value).alias("_total"))  # partial sums before the shuffle
    return df.withColumn("_key", F.struct(*keys)).join(totals, "_key").withColumn("share", F.col(value) / F.col("_total")).drop("_key", "_total").where(F.col("share") >= least)


def scalar_lookup(df: DataFrame, facts: DataFrame, key: str, aggs: dict[str, Column], default: dict[str, object] | None = None) -> DataFrame:
    """Correlated aggregates: facts aggregated by key before one left join; missing counts take their default."""
    out = df.join(facts.groupBy(key).agg(*[c.alias(n) for n, c in aggs.items()]), key, "left")
    return out.fillna(default) if default else out


def membership(df: DataFrame, array_a: Column, array_b: Column, a: str, b: str) -> DataFrame:
    """Rows whose (a, b) occurs among the zipped arrays of a one-row source."""
    pairs = df.sparkSession.range(1).select(F.inline(F.arrays_zip(array_a.alias("x"), array_b.alias("y"))))
    return df.join(F.broadcast(pairs), (df[a] == pairs["x"]) & (df[b] == pairs["y"]), "left_semi")  # literals: as many rows as the caller wrote


#: Positions of a key that are scanned together.
BLOCK = 4096


def pages_until_stale(pages: DataFrame, key: str, page: str, item: str) -> DataFrame:
    """Pages before the first that adds no new item. Pages are numbered; a scan of the least count by blocks of numbers."""
    first = pages.groupBy(key, item).agg(F.min(page).alias("_first"))
    fresh = pages.join(first, [key, item]).groupBy(key, page).agg(F.count_if(F.col(page) == F.col("_first")).alias("new_items"))
    out = scanned(
        fresh, [key], [page], F.floor(F.col(page) / BLOCK), [{"_own": lambda w: F.min("new_items").over(upto(w))}], {"_least": F.min("new_items")}, [{"_prior": lambda w: F.min("_least").over(past(w))}]
    )
    return out.where(F.least("_own", "_prior") > 0).select(fresh.columns)


def carry_forward(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str, cell: Column | None = None) -> DataFrame:
    """The last value that isn't null up to each row. A closing row passes a struct with a null field.

    ``cell`` deals a key's rows and grows with the order; by default, blocks of the first order column, which is a number
    then. Nulls in it come first.
    """
    cell = F.floor(F.col(order[0]) / BLOCK) if cell is None else cell
    out = scanned(
        df.withColumn("_v", value), keys, order, cell, [{"_own": lambda w: F.last("_v", ignorenulls=True).over(upto(w))}],
        {"_last": F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order)))}, [{"_prior": lambda w: F.last("_last", ignorenulls=True).over(past(w))}],
    )
    return out.select(*df.columns, F.coalesce("_own", "_prior").alias(name))


def all_of(conditions: list[Column | None]) -> Column:
    """The conditions that are asked for, all of them; true if none is."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def merged_maps(first: Column, second: Column) -> Column:
    """Entries of both maps; those of the second win."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.coalesce(F.map_contains_key(second, k), F.lit(False))), second)


def dropped_counts(df: DataFrame, key: str) -> DataFrame:
    """How often each dropped key occurs, by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(key)

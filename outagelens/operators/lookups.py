"""Joins against dimensions and qualifying groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_left(df: DataFrame, dimension: DataFrame, match: Column, attributes: list[str], default: str) -> DataFrame:
    """Left lookup; rows without a match get the default.

    No broadcast hint: Spark broadcasts the dimension when its measured size is
    below the session limit and otherwise shuffles, splitting hot keys at run time.
    """
    joined = df.join(dimension, match, "left")
    return joined.select(
        *[df[c] for c in df.columns],
        *[F.coalesce(dimension[a], F.lit(default)).alias(a) for a in attributes],
    )


#: Keys that the sketch of frequent keys tracks, and those of them that it tells.
TRACKED, TOLD = 10_000, 100


def frequent_keys(df: DataFrame, key: str) -> Column:
    """An array of the keys with so many rows that one of them alone fills a shuffle partition, or nearly so.

    A frequent-items sketch of fixed size, merged from the tasks' own: no shuffle of rows and no count per key.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = f"`{key}`"
    top = F.expr(f"approx_top_k(cast({named} AS string), {TOLD}, {TRACKED})")
    found = df.where(F.col(named).isNotNull()).agg(top.alias("top"), F.count("*").alias("rows"))
    often = F.filter("top", lambda one: one["count"] * parts >= F.col("rows"))
    return found.select(F.transform(often, lambda one: one["item"])).scalar()


def lookup_spread(
    df: DataFrame, dimension: DataFrame, key: tuple[str, str], attributes: list[str], default: str, hot: Column, by: list[str],
    among: Column | None = None,
) -> DataFrame:
    """Left lookup for a dimension too large to broadcast; rows without a match, or not `among` those looked up, get the default.

    `key` names the key in df and in the dimension, `hot` is an array of frequent keys. Rows of a hot key are dealt over
    all partitions by the columns `by`, and its few dimension rows are copied to each; other rows are joined as usual.
    All in one join, so an ordinary key costs nothing.
    """
    own, other = key
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def is_hot(column: str) -> Column:
        return F.coalesce(F.array_contains(hot, F.col(f"`{column}`").cast("string")), F.lit(False))

    dealt = df.withColumn("_salt", F.when(is_hot(own), F.pmod(F.xxhash64(*by), F.lit(parts)).cast("int")).otherwise(0))
    everywhere = F.when(is_hot(other), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    copies = dimension.select(
        F.col(f"`{other}`").alias("_key"), F.explode(everywhere).alias("_part"), *[F.col(a).alias(f"_of_{a}") for a in attributes])
    same = (F.col(f"`{own}`") == F.col("_key")) & (F.col("_salt") == F.col("_part"))
    joined = dealt.join(copies, same if among is None else same & among, "left")
    return joined.select(
        *[F.col(f"`{c}`") for c in df.columns], *[F.coalesce(F.col(f"_of_{a}"), F.lit(default)).alias(a) for a in attributes])


def expected_bytes(df: DataFrame) -> int:
    """The size that Spark expects of a table."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def may_be_broadcast(df: DataFrame) -> bool:
    """Whether Spark expects a table to be below the session's limit for broadcasts."""
    return expected_bytes(df) <= int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def unmatched(df: DataFrame, dimension: DataFrame, match: Column, columns: list[str]) -> DataFrame:
    """Distinct rows that have no partner in the dimension."""
    return df.join(dimension, match, "left_anti").select(*columns).dropDuplicates()


def groups_with_volume(df: DataFrame, by: list[str], minimum: int) -> DataFrame:
    """Keys of the groups that hold at least `minimum` rows."""
    return df.groupBy(*by).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= minimum).select(*by)


def rows_of_large_groups(df: DataFrame, by: list[str], minimum: int) -> DataFrame:
    """Rows whose group holds at least `minimum` rows."""
    return df.join(groups_with_volume(df, by, minimum), by, "left_semi")


def modal_value(df: DataFrame, by: list[str], column: str, into: str, weight: str | None = None) -> DataFrame:
    """Most frequent value per group, the smallest among equals; counted before it is compared.

    With a weight column the rows are counts already.
    """
    rows = F.sum(weight) if weight else F.count("*")
    counted = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(rows.alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_n"), F.col(column).alias("_value")))
    return counted.groupBy(*by).agg(best.alias("_best")).select(*by, F.col("_best._value").alias(into))


def cohort_of_top(df: DataFrame, name: str, n: int) -> DataFrame:
    """The n most frequent names (ties by name) with their row counts."""
    counted = df.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("Tickets"))
    return counted.orderBy(F.desc("Tickets"), F.asc(name)).limit(n)


def with_cohort_flag(df: DataFrame, cohort: DataFrame, name: str, flag: str) -> DataFrame:
    """Mark the rows whose name is in the cohort (a limited top-n table)."""
    marked = cohort.select(name, F.lit(True).alias(flag))
    return df.join(marked, name, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_group_average(df: DataFrame, by: list[str], column: str, into: str) -> DataFrame:
    """Every row with the average of its group; a missing key is a group.

    Groups are aggregated and joined back, so no task holds the rows of a group.
    Spark broadcasts the averages when their measured size is small.
    """
    means = df.groupBy(*[F.col(key).alias(f"_of_{key}") for key in by]).agg(F.avg(column).alias(into))
    same = F.lit(True)
    for key in by:
        same = same & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return df.join(means, same).drop(*[f"_of_{key}" for key in by])


def settled(df: DataFrame, name: str, rules: Column) -> DataFrame:
    """Add a costly rule column that is worked out once per row.

    Spark copies a plain column into every later filter that reads it.  A column
    that comes out of a one-element explode is read, not worked out again.
    """
    kept = [F.col(f"`{column}`") for column in df.columns if column != name]
    return df.select(*kept, F.explode(F.array(rules)).alias(name))

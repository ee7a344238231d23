"""Constraint checks.  Each gives issue rows: severity, issue_type, failure_id, expected, actual.

Failures are rows, never exceptions; gate() raises when a caller wants that.  All checks are
aggregates or anti-joins with map-side combine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("severity", "issue_type", "failure_id", "expected", "actual")


def issues(df: DataFrame, issue_type: str, failure_id: Column, expected: Column | str, actual: Column | str, severity: str = "blocker") -> DataFrame:
    """df's rows as issue rows."""
    text = lambda x: (F.lit(x) if isinstance(x, str) else x).cast("string")
    return df.select(F.lit(severity).alias("severity"), F.lit(issue_type).alias("issue_type"), failure_id.cast("string").alias("failure_id"), text(expected).alias("expected"), text(actual).alias("actual"))


def every(*parts: DataFrame) -> DataFrame:
    """All issue rows."""
    return reduce(DataFrame.unionByName, parts)


def gate(found: DataFrame) -> None:
    """ValueError if there is any blocker."""
    first = found.where("severity = 'blocker'").limit(5).collect()
    if first:
        raise ValueError("blockers: " + "; ".join(f"{r.issue_type} {r.failure_id}" for r in first))


def unique(df: DataFrame, key: str) -> DataFrame:
    """Values of a key that occur more than once."""
    many = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
    return issues(many, "duplicate_key", F.col(key), "1", F.col("n"))


def foreign_key(df: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct non-null values that the parent does not have."""
    values = df.select(F.col(column).alias("_v")).where("_v is not null").distinct()
    missing = values.join(parent.select(F.col(key).alias("_v")).distinct(), "_v", "left_anti")
    return issues(missing, "missing_parent", F.col("_v"), f"{key} exists", "missing")


def functional(df: DataFrame, key: str, column: str) -> DataFrame:
    """Keys with more than one value of a column that should have one; nulls do not count.

    Only the least and the greatest value are kept, so a key with many rows costs no list.
    """
    spread = df.groupBy(key).agg(F.min(column).alias("lo"), F.max(column).alias("hi")).where("lo < hi")
    return issues(spread, "not_functional", F.col(key), "one value", F.concat_ws(" .. ", F.col("lo").cast("string"), F.col("hi").cast("string")))


def checks(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """Row rules (name to a condition that must hold); an unknown outcome is a failure."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]))
    bad = df.select(F.col(key).alias("_k"), F.explode(failed).alias("_rule"))
    return bad.select(F.lit("blocker").alias("severity"), F.col("_rule").alias("issue_type"), F.col("_k").cast("string").alias("failure_id"), F.lit("holds").alias("expected"), F.lit("fails").alias("actual"))


def monotonic(df: DataFrame, key: str, order: list[str], column: str) -> DataFrame:
    """Rows whose column is smaller than in the row before of the same key."""
    before = F.lag(column).over(Window.partitionBy(key).orderBy(*order))
    bad = df.withColumn("_before", before).where(F.col(column) < F.col("_before"))
    return issues(bad, "not_monotonic", F.col(key), F.concat(F.lit(">= "), F.col("_before").cast("string")), F.col(column))


def contiguous(df: DataFrame, key: str, position: str, first: int = 0) -> DataFrame:
    """Keys whose positions are not first, first + 1, ... without gap or repetition."""
    per = df.groupBy(key).agg(F.min(position).alias("lo"), F.max(position).alias("hi"), F.count("*").alias("n"), F.countDistinct(position).alias("d"))
    bad = per.where((F.col("lo") != first) | (F.col("hi") != F.col("n") + (first - 1)) | (F.col("d") != F.col("n")))
    return issues(bad, "not_contiguous", F.col(key), F.concat_ws("..", F.lit(str(first)), (F.col("n") + (first - 1)).cast("string")), F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string")))


def same_set(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has."""
    x, y = a.select(F.col(key).alias("k")).distinct(), b.select(F.col(key).alias("k")).distinct()
    return every(
        issues(x.join(y, "k", "left_anti"), "only_left", F.col("k"), "in both", "left"),
        issues(y.join(x, "k", "left_anti"), "only_right", F.col("k"), "in both", "right"),
    )


def bijection(df: DataFrame, a: str, b: str) -> DataFrame:
    """Values of a with several b and values of b with several a."""
    pairs = df.select(a, b).distinct()
    return every(
        issues(pairs.groupBy(a).agg(F.count("*").alias("n")).where("n > 1"), f"many_{b}", F.col(a), "1", F.col("n")),
        issues(pairs.groupBy(b).agg(F.count("*").alias("n")).where("n > 1"), f"many_{a}", F.col(b), "1", F.col("n")),
    )


def leaks(df: DataFrame, key: str, text: str, markers: list[str], patterns: dict[str, str] | None = None) -> DataFrame:
    """Texts that hold a marker, in whatever case, or a pattern (name to regular expression) that they must not."""
    low = F.lower(F.col(text))
    found = [F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers] + [F.when(F.col(text).rlike(p), F.lit(name)) for name, p in (patterns or {}).items()]
    bad = df.select(F.col(key).alias("_k"), F.explode(F.array_compact(F.array(*found))).alias("_m"))
    return issues(bad, "leakage", F.col("_k"), "absent", F.col("_m"))


def truth_table(df: DataFrame, key: str, columns: list[str], allowed: DataFrame) -> DataFrame:
    """Rows whose combination of columns is not in the table of allowed ones; null equals null."""
    on = reduce(lambda x, y: x & y, [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in columns])
    bad = df.alias("d").join(F.broadcast(allowed.select(*columns).distinct()).alias("t"), on, "left_anti")
    return issues(bad, "combination", F.col(key), "allowed", F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns]))


def sums_match(parts: DataFrame, key: str, amount: str, wholes: DataFrame, total: str, tolerance: float) -> DataFrame:
    """Keys whose parts do not add up to their total within the tolerance; a missing side counts as 0."""
    s = parts.groupBy(F.col(key).alias("k")).agg(F.sum(amount).alias("s"))
    both = wholes.select(F.col(key).alias("k"), F.col(total).alias("t")).join(s, "k", "full_outer")
    bad = both.where(F.abs(F.coalesce("s", F.lit(0)) - F.coalesce("t", F.lit(0))) > tolerance)
    return issues(bad, "sum_mismatch", F.col("k"), F.round(F.coalesce("t", F.lit(0)), 2), F.round(F.coalesce("s", F.lit(0)), 2))


def schema_issues(df: DataFrame, required: dict[str, str], forbidden: tuple[str, ...] = ()) -> DataFrame:
    """Columns that are missing, of another type, or forbidden; compares metadata, reads nothing."""
    have = dict(df.dtypes)
    rows = [("blocker", "missing_column", c, t, "absent") for c, t in required.items() if c not in have]
    rows += [("blocker", "column_type", c, t, have[c]) for c, t in required.items() if c in have and have[c] != t]
    rows += [("blocker", "forbidden_column", c, "absent", have[c]) for c in forbidden if c in have]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{c} string" for c in COLUMNS))


def rolled_up(found: DataFrame) -> DataFrame:
    """issue_type, severity, n: issues by kind."""
    return found.groupBy("issue_type", "severity").agg(F.count("*").alias("n"))

"""Data-quality gates as rows: gate, observed, rule, pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate(df: DataFrame, name: str, value: Column, low: float | None = None, high: float | None = None) -> DataFrame:
    """One row: an aggregate of df, and whether it lies between low and high, both included."""
    rule = f"{'' if low is None else f'>= {low:g}'}{' and ' if low is not None and high is not None else ''}{'' if high is None else f'<= {high:g}'}"
    out = df.agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("observed")).select(
        F.lit(name).alias("gate"), "observed", F.lit(rule).alias("rule")
    )
    ok = (F.lit(True) if low is None else F.col("observed") >= low) & (F.lit(True) if high is None else F.col("observed") <= high)
    return out.withColumn("pass", ok)


def at_least(df: DataFrame, name: str, n: int) -> DataFrame:
    return gate(df, name, F.count("*"), low=n)


def distinct_at_least(df: DataFrame, name: str, col: str, n: int) -> DataFrame:
    return gate(df, name, F.count_distinct(col), low=n)


def none_where(df: DataFrame, name: str, condition: Column) -> DataFrame:
    return gate(df, name, F.count_if(condition), high=0)


def only_known(df: DataFrame, known: DataFrame, name: str, col: str) -> DataFrame:
    """No row whose column is not among known."""
    return gate(df.join(known.select(col).distinct(), col, "left_anti"), name, F.count("*"), high=0)


def none_rejected(links: DataFrame, rejected: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """No rejected pair among the links."""
    return gate(links.join(rejected.select(*keys).distinct(), keys, "left_semi"), name, F.count("*"), high=0)


def same_count(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    both = a.agg(F.count("*").alias("x")).join(b.agg(F.count("*").alias("y")))
    return gate(both, name, F.sum(F.abs(F.col("x") - F.col("y"))), low=0, high=0)


def columns(df: DataFrame, name: str, present: list[str], absent: list[str] = ()) -> DataFrame:
    wrong = [c for c in present if c not in df.columns] + [c for c in absent if c in df.columns]
    return df.sparkSession.range(1).select(
        F.lit(name).alias("gate"), F.lit(float(len(wrong))).alias("observed"), F.lit("<= 0").alias("rule"),
        F.lit(not wrong).alias("pass")
    )


def report(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates)


def require(gates: DataFrame) -> None:
    """Raises with the names of the gates that failed (there are few)."""
    failed = [r["gate"] for r in gates.where(~F.col("pass")).select("gate").collect()]
    if failed:
        raise ValueError(f"gates failed: {', '.join(failed)}")

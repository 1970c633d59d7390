"""Keyed appends, upserts, clears and purges as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def new_rows(new: DataFrame, existing: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """Rows of new whose key is not there yet; of equal keys the first by order, else by all other columns."""
    w = W.partitionBy(*keys).orderBy(*(order or [c for c in new.columns if c not in keys] or keys))
    first = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    have = existing.select(*keys).distinct()
    return first.join(have, _same(first, have, keys), "left_anti")


def keyed_append(new: DataFrame, existing: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    return existing.unionByName(new_rows(new, existing, keys, order), allowMissingColumns=True)


def one_update(updates: DataFrame, keys: list[str], cols: list[str], order: list | None) -> DataFrame:
    """One row per key: the last of its rows by `order`, or by the values of the listed columns, as if applied one by one."""
    return last_by(updates, keys, [x.desc_nulls_last() for x in map(_column, order or cols)])


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def upsert(
    base: DataFrame, updates: DataFrame, keys: list[str], cols: list[str], insert: bool = True, order: list | None = None
) -> DataFrame:
    """base with the listed columns taken from updates where the key matches, nulls too; other keys are inserted.

    Of several updates of a key the last counts, by the columns in `order`, or by their values."""
    u = one_update(updates, keys, cols, order)
    u = u.select(*[F.col(c).alias(f"_u_{c}") for c in [*keys, *cols]], F.lit(True).alias("_hit"))
    on = reduce(lambda x, y: x & y, [base[k].eqNullSafe(u[f"_u_{k}"]) for k in keys])
    joined = base.withColumn("_old", F.lit(True)).join(u, on, "full" if insert else "left")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c))
    return joined.select(
        *[
            F.when(
                F.col("_old"), F.col(c)
            ).otherwise(F.col(f"_u_{c}")).alias(c) if c in keys else pick(c).alias(c) if c in cols else F.col(c) for c in base.columns
        ]
    )


def _missing(df: DataFrame, c: str, zero: bool) -> Column:
    """Whether a value is null, or 0 in a column of numbers."""
    number = zero and isinstance(df.schema[c].dataType, T.NumericType)
    return F.col(c).isNull() | (F.col(c) == 0) if number else F.col(c).isNull()


def first_values(updates: DataFrame, keys: list[str], cols: list[str], order: list | None, zero_is_missing: bool) -> DataFrame:
    """Per key and column the first value by order, or the greatest, that is not missing."""
    given = lambda c: ~_missing(updates, c, zero_is_missing)
    if not order:
        return updates.groupBy(*keys).agg(*(F.max(F.when(given(c), F.col(c))).alias(c) for c in cols))
    by = F.struct(*map(_column, order))
    return updates.groupBy(*keys).agg(*(F.min_by(F.when(given(c), F.col(c)), F.when(given(c), by)).alias(c) for c in cols))


def fill_missing(base: DataFrame, updates: DataFrame, keys: list[str], cols: list[str], zero_is_missing: bool = True, order: list | None = None) -> DataFrame:
    """Values of updates only where base has null (or 0). Of several updates of a key the first that has a value gives it,
    by the columns in `order`, or else the greatest does; values that count as missing give none."""
    u = first_values(updates, keys, cols, order, zero_is_missing).select(*keys, *[F.col(c).alias(f"_u_{c}") for c in cols])
    gap = lambda c: _missing(base, c, zero_is_missing)
    joined = base.join(u, keys, "left")
    return joined.select(
        *[
            F.when(
                gap(c), F.coalesce(F.col(f"_u_{c}"), F.col(c))
            ).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns
        ]
    )


def keep_greatest(base: DataFrame, updates: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """The greatest of base's value and those of all updates of the key."""
    u = updates.groupBy(*keys).agg(*(F.max(c).alias(c) for c in cols)).select(*keys, *[F.col(c).alias(f"_u_{c}") for c in cols])
    return base.join(u, keys, "left").select(*[F.greatest(F.col(c), F.col(f"_u_{c}")).alias(c) if c in cols else F.col(c) for c in base.columns])


def clear(base: DataFrame, rejects: DataFrame, keys: list[str], cols: list[str], set_to: dict[str, Column] | None = None) -> DataFrame:
    """Nulls the listed columns of rejected keys and sets others, such as a reason."""
    r = rejects.select(*keys).distinct().withColumn("_gone", F.lit(True))
    out = base.join(r, keys, "left")
    value = lambda c: F.when(F.col("_gone"), (set_to or {}).get(c, F.lit(None))).otherwise(F.col(c)).alias(c)
    return out.select(*[value(c) if c in cols or c in (set_to or {}) else F.col(c) for c in base.columns])


def purge(tables: dict[str, tuple[DataFrame, str]], accepted: DataFrame, key: str, dry_run: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table with only accepted keys, and rows (table, before, after)."""
    keys = accepted.select(F.col(key).alias("_k")).distinct()
    kept = {n: df.join(keys, df[c] == keys["_k"], "left_semi") for n, (df, c) in tables.items()}
    report = reduce(
        DataFrame.unionByName,
        [
            df.agg(F.count("*").alias("before")).join(kept[n].agg(F.count("*").alias("after"))).select(
                F.lit(n).alias("table"), "before", "after"
            ) for n,
            (df, _) in tables.items()
        ]
    )
    return ({n: df for n, (df, _) in tables.items()} if dry_run else kept), report


def last_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first by order, which states which one wins."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def decisions(log: DataFrame, overrides: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Review decisions (name, action, id, notes, at): the last per name; overrides and rejected pairs grown by them."""
    now = last_by(log, ["name"], [F.desc("at"), F.desc("action")])
    accept = now.where("action = 'accept_override' and id is not null").select("name", "id", "notes")
    reject = now.where("action = 'reject' and id is not null").select("name", "id", "notes")
    return now, keyed_append(accept, overrides, ["name"]), keyed_append(reject, rejected, ["name", "id"])


def restore(current: DataFrame, snapshots: list[DataFrame], keys: list[str], cols: list[str], least: int = 5) -> DataFrame:
    """Columns of keys taken back from the latest snapshot (last in the list) with more than `least` of the columns set."""
    rows = [s.select(*keys, *cols, F.lit(i).alias("_age")) for i, s in enumerate(snapshots)]
    held = reduce(DataFrame.unionByName, rows).where(sum(F.col(c).isNotNull().cast("int") for c in cols) > least)
    best = last_by(held, keys, [F.desc("_age")]).drop("_age")
    return fill_missing(current, best, keys, cols, zero_is_missing=False)


def rebuilt(stats: DataFrame, backup: DataFrame, key: str, fallback: dict[str, str]) -> DataFrame:
    """stats with the columns that only the backup has; `fallback` columns take another column where null.

    Of several backup rows of a key the last counts, by the values of those columns."""
    more = [c for c in backup.columns if c not in stats.columns]
    out = stats.join(one_update(backup.select(key, *more), [key], more, None), key, "left") if more else stats
    for c, other in fallback.items():
        out = out.withColumn(c, F.coalesce(c, other))
    return out


def add_missing(base: DataFrame, names: DataFrame, key: str, defaults: dict[str, Column]) -> DataFrame:
    """Rows with defaults for names that base lacks."""
    missing = names.select(key).distinct().join(base, key, "left_anti").select(key, *[v.alias(k) for k, v in defaults.items()])
    return base.unionByName(missing, allowMissingColumns=True)


def audit(before: DataFrame, after: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Each row's columns now and, as <name>_before, as they were; rows that came or went have nulls on one side."""
    old = before.select(*keys, *[F.col(c).alias(f"{c}_before") for c in cols])
    return after.select(*keys, *cols).join(old, keys, "full")

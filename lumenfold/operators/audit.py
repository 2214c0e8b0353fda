"""Relational constraint audit (A18), re-aimed from DDL to a violations table.

``constraint_audit`` gives a row per constraint with its number of violating rows
(0 when it holds): one scan evaluates every row-level rule (NOT NULL, CHECK,
generated columns) as a global aggregate; key uniqueness is a partial-aggregating
``groupBy``; foreign keys are ``left_anti`` joins.

``constraint_violations`` names the rows: a row per constraint and key, at most
``max_keys`` keys of each constraint, with the exact totals beside them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


ForeignKey = tuple[Sequence[str], DataFrame, Sequence[str], str]


def row_rules(
    not_null: Sequence[str] = (), checks: dict[str, Column] | None = None, generated: dict[str, Column] | None = None
) -> list[tuple[str, Column]]:
    """(constraint name, condition of a violating row) of the rules that a row alone can break.

    ``checks`` maps a constraint name to a predicate that must hold (NULL counts as
    holding, as in SQL CHECK); ``generated`` a column to the expression that it must equal.
    """
    rules = [(f"not_null:{c}", F.col(c).isNull()) for c in not_null]
    rules += [(name, ~F.coalesce(holds, F.lit(True))) for name, holds in (checks or {}).items()]
    return rules + [(f"generated:{c}", ~F.col(c).eqNullSafe(value)) for c, value in (generated or {}).items()]


def repeated_keys(table: DataFrame, key: Sequence[str]) -> DataFrame:
    """(``key``, n) of keys that more than one row has."""
    return table.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def orphans(table: DataFrame, child: Sequence[str], parent: DataFrame, parent_cols: Sequence[str]) -> DataFrame:
    """Rows (``child`` columns) whose reference is set and stands in no row of ``parent``."""
    keys = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, child)]).distinct()
    return table.dropna(subset=list(child)).join(keys, list(child), "left_anti")


def constraint_audit(
    table: DataFrame,
    name: str,
    primary_key: Sequence[str] = (),
    not_null: Sequence[str] = (),
    checks: dict[str, Column] | None = None,
    foreign_keys: Sequence[ForeignKey] = (),
    generated: dict[str, Column] | None = None,
) -> DataFrame:
    """Violations per constraint: ``(table_name, constraint_name, violations)``.

    ``foreign_keys`` items are ``(child_cols, parent_df, parent_cols, constraint_name)``.
    """
    rules = row_rules(not_null, checks, generated)
    parts: list[DataFrame] = []
    if rules:
        agg = table.agg(*[F.count_if(cond).alias(f"r{i}") for i, (_, cond) in enumerate(rules)])
        stack = F.inline(
            F.array(*[F.struct(F.lit(cname).alias("constraint_name"), F.col(f"r{i}").alias("violations"))
                      for i, (cname, _) in enumerate(rules)])
        )
        parts.append(agg.select(stack))
    if primary_key:
        dup = repeated_keys(table, primary_key).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"))
        parts.append(dup.select(F.lit("primary_key:" + ",".join(primary_key)).alias("constraint_name"), "violations"))
    for child_cols, parent, parent_cols, cname in foreign_keys:
        lost = orphans(table.select(*child_cols), child_cols, parent, parent_cols)
        parts.append(lost.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(cname).alias("constraint_name"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.lit(name).alias("table_name"), "constraint_name", F.col("violations").cast("bigint"))


def constraint_violations(
    table: DataFrame,
    name: str,
    key: Sequence[str],
    primary_key: Sequence[str] = (),
    not_null: Sequence[str] = (),
    checks: dict[str, Column] | None = None,
    foreign_keys: Sequence[ForeignKey] = (),
    generated: dict[str, Column] | None = None,
    max_keys: int = 100,
) -> DataFrame:
    """Violations with their keys: ``(table_name, constraint_name, violations, keys, key, rows)``.

    ``key`` names the columns that tell a row (null parts are written ``NULL``);
    ``rows`` of a key break the constraint. The first ``max_keys`` keys in text order
    are named; ``violations`` and ``keys`` count all. A constraint that holds has one
    row with 0, 0 and nulls. One scan serves all rules that a row alone can break;
    keys are counted before they are ranked, and the ranking is cut in every task
    before its rows meet, so a constraint that most rows break stays cheap.
    """
    written = F.array_join(F.array(*(F.col(c).cast("string") for c in key)), ",", "NULL").alias("key")
    rules = row_rules(not_null, checks, generated)
    broken = F.filter(
        F.array(*(F.when(condition, F.lit(cname)) for cname, condition in rules)), lambda c: c.isNotNull()
    )
    parts, names = [], [cname for cname, _ in rules]
    if rules:
        parts.append(table.select(F.explode(broken).alias("constraint_name"), written, F.lit(1).cast("bigint").alias("rows")))
    if primary_key:
        names.append("primary_key:" + ",".join(primary_key))
        rows = table.join(repeated_keys(table, primary_key).drop("n"), list(primary_key), "left_semi")
        parts.append(rows.select(F.lit(names[-1]).alias("constraint_name"), written, F.lit(1).cast("bigint").alias("rows")))
    for child_cols, parent, parent_cols, cname in foreign_keys:
        names.append(cname)
        lost = orphans(table.select(*dict.fromkeys([*key, *child_cols])), child_cols, parent, parent_cols)
        parts.append(lost.select(F.lit(cname).alias("constraint_name"), written, F.lit(1).cast("bigint").alias("rows")))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    counted = found.groupBy("constraint_name", "key").agg(F.sum("rows").alias("rows"))
    totals = counted.groupBy("constraint_name").agg(F.sum("rows").alias("violations"), F.count("*").alias("keys"))
    place = F.row_number().over(Window.partitionBy("constraint_name").orderBy("key"))
    first = counted.withColumn("place", place).where(F.col("place") <= max_keys).drop("place")
    known = table.sparkSession.createDataFrame([(n,) for n in names], "constraint_name string")
    none = F.lit(0).cast("bigint")
    return known.join(totals, "constraint_name", "left").join(first, "constraint_name", "left").select(
        F.lit(name).alias("table_name"), "constraint_name", F.coalesce("violations", none).alias("violations"),
        F.coalesce("keys", none).alias("keys"), "key", "rows",
    )


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` whose key is not yet present (conflict -> skip); one row per key."""
    return incoming.dropDuplicates(list(key)).join(existing.select(*key).distinct(), list(key), "left_anti")

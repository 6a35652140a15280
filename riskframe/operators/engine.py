"""Running rules over a set of tables, and what follows from the violations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.config import KEY_COLUMNS
from riskframe.functions.exprs import any_of, compact, record_key
from riskframe.operators.rules import RowRule, SetRule, Tables

SCHEMA = "`table` string, record_key string, rule_name string, severity string, detail string"


def finding(rule_name: str, severity: str, detail: Column) -> Column:
    return F.struct(F.lit(rule_name).alias("rule_name"), F.lit(severity).alias("severity"), detail.alias("detail"))


def findings(df: DataFrame, rules: list[RowRule]) -> Column:
    """What the row rules find in each row, as one array column."""
    found = [F.when(detail.isNotNull(), finding(rule.name, rule.severity, detail)) for rule in rules for detail in rule.details(df)]
    return compact(found) if found else F.expr("cast(array() as array<struct<rule_name:string,severity:string,detail:string>>)")


def row_violations(df: DataFrame, table: str, rules: list[RowRule]) -> DataFrame | None:
    """All row rules of one table in a single pass.  Works on a stream as well."""
    if not rules:
        return None
    return df.select(
        F.lit(table).alias("table"), record_key(KEY_COLUMNS[table]).alias("record_key"),
        F.explode(findings(df, rules)).alias("v"),
    ).select("table", "record_key", "v.*")


def violations(tables: Tables, rules: Sequence[RowRule | SetRule]) -> DataFrame:
    """table, record_key, rule_name, severity, detail of every violation."""
    parts = []
    for table in tables:
        mine = [r for r in rules if isinstance(r, RowRule) and r.table == table]
        # A table without a rule is not asked for.
        part = row_violations(tables[table], table, mine) if mine else None
        if part is not None:
            parts.append(part)
    for rule in rules:
        if isinstance(rule, SetRule):
            found = rule.check(tables)
            if found is not None:
                parts.append(found.select(
                    F.lit(rule.table).alias("table"), "record_key", F.lit(rule.name).alias("rule_name"),
                    F.lit(rule.severity).alias("severity"), "detail",
                ))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def violation_keys(tables: Tables, table: str, rules: Sequence[RowRule | SetRule]) -> DataFrame:
    """record_key of rows that break one of the rules of a table.  No findings are made:
    row rules only filter, and texts of the details are built for offending rows at most."""
    row_rules = [r for r in rules if isinstance(r, RowRule)]
    set_rules = [r for r in rules if isinstance(r, SetRule)]
    parts = []
    if row_rules:
        df = tables[table]
        bad = any_of([detail.isNotNull() for rule in row_rules for detail in rule.details(df)])
        parts.append(df.where(bad).select(record_key(KEY_COLUMNS[table]).alias("record_key")))
    if set_rules or not parts:
        parts.append(violations(tables, set_rules).select("record_key"))
    return reduce(DataFrame.unionByName, parts)


@dataclass
class ValidationRun:
    """Tables, the rules they were checked by, their violations and the derived tables."""

    tables: Tables
    rules: Sequence[RowRule | SetRule]

    @cached_property
    def violations(self) -> DataFrame:
        return violations(self.tables, self.rules)

    def rule_counts(self) -> DataFrame:
        return (
            self.violations.groupBy("rule_name", "severity", "table").agg(F.count("*").alias("count"))
            .orderBy(F.desc("count"), "rule_name", "table")
        )

    def error_keys(self, table: str) -> DataFrame:
        """Keys by the ERROR rules of the table; tables that they don't read are not asked for."""
        mine = [r for r in self.rules if r.severity == "ERROR" and r.table == table]
        return violation_keys(self.tables, table, mine).select(F.col("record_key").alias("_error_key")).distinct()

    def flagged(self, table: str) -> DataFrame:
        """The table with ``is_quarantined``: its key has an ERROR."""
        df = self.tables[table]
        if table not in KEY_COLUMNS:
            return df.withColumn("is_quarantined", F.lit(False))
        keyed = df.withColumn("_key", record_key(KEY_COLUMNS[table]))
        joined = keyed.join(self.error_keys(table), F.col("_key") == F.col("_error_key"), "left")
        return joined.select(*df.columns, F.col("_error_key").isNotNull().alias("is_quarantined"))

    def _split(self, table: str, how: str) -> DataFrame:
        df = self.tables[table]
        keyed = df.withColumn("_key", record_key(KEY_COLUMNS[table]))
        return keyed.join(self.error_keys(table), F.col("_key") == F.col("_error_key"), how).drop("_key")

    def clean(self, table: str) -> DataFrame:
        return self._split(table, "left_anti")

    def quarantined(self, table: str) -> DataFrame:
        return self._split(table, "left_semi")

    def passed(self) -> bool:
        """No ERROR anywhere."""
        return self.violations.where(F.col("severity") == "ERROR").isEmpty()

    def row_counts(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [
            df.agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table"), "n_rows")
            for t, df in self.tables.items()
        ])

    def summary(self) -> DataFrame:
        """Rows in, flagged and left per table."""
        parts = [
            self.flagged(t).agg(
                F.count("*").alias("rows_in"), F.count_if("is_quarantined").alias("rows_quarantined"),
            ).select(F.lit(t).alias("table"), "rows_in", "rows_quarantined",
                     (F.col("rows_in") - F.col("rows_quarantined")).alias("rows_out"))
            for t in self.tables
        ]
        return reduce(DataFrame.unionByName, parts)

    def counts_with_share(self) -> DataFrame:
        """Violations per rule and their share of the table's rows in percent."""
        share = F.when(F.col("n_rows") > 0, F.col("count") / F.col("n_rows") * 100)
        return self.rule_counts().join(self.row_counts(), "table").withColumn("pct_of_rows", share).drop("n_rows")

    def examples(self, n: int = 20) -> DataFrame:
        """The first n violations, errors first."""
        return self.violations.orderBy("severity", "table", "record_key", "rule_name", "detail").limit(n)

    def violation_rate(self) -> DataFrame:
        """Distinct flagged keys over all rows, and its status.  A key that occurs
        in two tables counts once, as in the reported figure."""
        keys = self.violations.agg(F.count_distinct("record_key").alias("flagged_keys"))
        total = self.row_counts().agg(F.sum("n_rows").alias("total_rows"))
        out = keys.select("flagged_keys", total.scalar().alias("total_rows"))
        rate = F.when(F.col("total_rows") > 0, F.col("flagged_keys") / F.col("total_rows")).otherwise(F.lit(0.0))
        return out.withColumn("violation_rate", rate)

    def issues(self) -> DataFrame:
        """Violations in the shape of the issue log."""
        return self.violations.withColumnRenamed("table", "table_name")


def run(tables: Tables, rules: Sequence[RowRule | SetRule]) -> ValidationRun:
    return ValidationRun(tables, rules)


def rate_status(rate, warning: float, alert: float):
    return F.when(rate >= alert, "ALERT").when(rate >= warning, "WARNING").otherwise("OK")


def numeric_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, median, max per numeric column."""
    from riskframe.operators.explore import numeric_summary

    return numeric_summary(df, columns).select(
        "feature", F.col("n").alias("count"), "mean", "std", "min", "median", "max"
    )


def rule_violation_trend(issues: DataFrame, since) -> DataFrame:
    """Violations per rule, severity and day from ``since`` on."""
    return (
        issues.where(F.to_date("detected_at") >= F.lit(since))
        .groupBy("rule_name", "severity", F.to_date("detected_at").alias("day"))
        .agg(F.count("*").alias("n")).orderBy("day")
    )

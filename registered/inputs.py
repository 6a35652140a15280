"""The credit tables, derived from the driver's tables by SQL both engines read.

Spark gets the text through ``spark.sql`` with DataFrames for the braces; the SQL
checks get it as common table expressions.  Every derivation keeps all rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.operators.ordered import lasting, materialize, passing, read_slices, shared_dir, slice_of, slices_of, write_slices

RAW = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

_CUSTOMER = """
    cast(c_custkey as string) as customer_id,
    cast(15 + c_custkey % 90 as int) {shift} as age,
    case when c_custkey % 3 = 0 then 'MALE' when c_custkey % 3 = 1 then 'FEMALE' else 'OTHER' end as gender,
    case when c_custkey % 5 = 0 then 'SINGLE' when c_custkey % 5 = 1 then 'MARRIED'
         when c_custkey % 5 = 2 then 'DIVORCED' when c_custkey % 5 = 3 then 'WIDOWED' end as marital_status,
    cast(c_custkey % 13 as int) as dependents,
    case when c_nationkey % 4 = 0 then 'HIGH_SCHOOL' when c_nationkey % 4 = 1 then 'GRADUATE'
         when c_nationkey % 4 = 2 then 'POSTGRADUATE' else 'DOCTORATE' end as education,
    case when c_mktsegment = 'AUTOMOBILE' then 'SALARIED' when c_mktsegment = 'BUILDING' then 'SELF_EMPLOYED'
         when c_mktsegment = 'FURNITURE' then 'BUSINESS_OWNER' when c_mktsegment = 'MACHINERY' then 'UNEMPLOYED'
         else 'SALARIED' end as employment_type,
    case when c_custkey % 17 = 0 then null else cast((c_custkey * 7) % 45 as double) end as employment_years,
    case when c_custkey % 29 = 0 then null else c_acctbal * cast(120 as double) end as annual_income,
    case when c_custkey % 11 = 0 then c_acctbal * cast(8 as double) else c_acctbal * cast(10 as double) end as monthly_income,
    cast(c_nationkey % 5 as int) as city_tier
"""

_LOAN = """
    cast(o_orderkey as string) as loan_id,
    case when o_orderkey % 97 = 0 then concat('X', cast(o_custkey as string)) else cast(o_custkey as string) end as customer_id,
    case when o_orderpriority = '1-URGENT' then 'PERSONAL' when o_orderpriority = '2-HIGH' then 'HOME'
         when o_orderpriority = '3-MEDIUM' then 'AUTO' when o_orderpriority = '5-LOW' then 'CREDIT_CARD'
         else 'BUSINESS' end as loan_type,
    o_totalprice {factor} as loan_amount,
    cast(o_orderkey % 620 as int) as loan_tenure_months,
    cast(o_orderkey % 430 as double) / 10 as interest_rate,
    case when o_orderkey % 31 = 0 then null else concat('PURPOSE_', cast(o_orderkey % 9 as string)) end as loan_purpose,
    cast(o_orderdate as date) as application_date,
    cast(o_orderdate as date) + cast(o_orderkey % 20 - 3 as int) as decision_date,
    o_orderstatus as status
"""

DERIVED = {
    # Customers with a load number; rich ones were loaded twice, the very rich again one year older.
    "customers_loaded": f"""
        select {_CUSTOMER.format(shift="")}, c_custkey * 10 as row_no from {{customer}}
        union all
        select {_CUSTOMER.format(shift="")}, c_custkey * 10 + 1 as row_no from {{customer}} where c_acctbal > 9000
        union all
        select {_CUSTOMER.format(shift="+ 1")}, c_custkey * 10 + 2 as row_no from {{customer}} where c_acctbal > 9500
    """,
    "customers": """
        select customer_id, age, gender, marital_status, dependents, education, employment_type,
               employment_years, annual_income, monthly_income, city_tier from {customers_loaded}
    """,
    "loans_loaded": f"""
        select {_LOAN.format(factor="")}, o_orderkey * 10 as row_no from {{orders}}
        union all
        select {_LOAN.format(factor="* 2")}, o_orderkey * 10 + 1 as row_no from {{orders}} where o_totalprice > 480000
    """,
    "loan_applications": """
        select loan_id, customer_id, loan_type, loan_amount, loan_tenure_months, interest_rate, loan_purpose,
               application_date, decision_date, status from {loans_loaded}
    """,
    "financial_profiles": """
        select cast(o_custkey as string) as customer_id, cast(l_shipdate as date) as as_of_date,
               max(l_extendedprice) / 5 as monthly_income,
               min(l_extendedprice) / 4 as monthly_expenses,
               cast(count(*) as int) as existing_loan_count,
               max(l_quantity) * 1000 as existing_loan_amount,
               max(l_extendedprice) * max(l_discount) as monthly_emi,
               max(l_extendedprice) - 5000 as savings_balance,
               case when cast(max(l_quantity) as int) % 9 = 0 then null else max(l_extendedprice) * 3 end as total_assets,
               min(l_extendedprice) * max(l_tax) * 10 as total_liabilities
        from {lineitem} join {orders} on l_orderkey = o_orderkey
        group by o_custkey, cast(l_shipdate as date)
    """,
    "credit_history": """
        select cast(o_custkey as string) as customer_id, cast(l_shipdate as date) + 3 as as_of_date,
               cast(min(l_partkey) % 650 as int) as credit_history_months,
               cast(max(l_suppkey) % 55 as int) as num_credit_accounts,
               max(l_extendedprice) as total_credit_limit,
               min(l_extendedprice) * max(l_quantity) / 25 as total_outstanding,
               min(l_extendedprice) * max(l_quantity) / 25 / max(l_extendedprice) as credit_utilization,
               cast(count(*) - 1 as int) as previous_defaults,
               cast(max(l_linenumber) % 4 as int) as late_payments_12m,
               cast(min(l_linenumber) % 3 as int) as missed_payments_12m,
               cast(max(l_linenumber) as int) as active_loans,
               cast(min(l_quantity) as int) as closed_loans
        from {lineitem} join {orders} on l_orderkey = o_orderkey
        group by o_custkey, cast(l_shipdate as date)
    """,
    "loan_outcomes": """
        select cast(o_orderkey as string) as loan_id,
               case when o_orderstatus = 'F' then 1 else 0 end as default_12m,
               cast(o_orderdate as date) + 365 as outcome_observed_date
        from {orders}
    """,
    # Unique loans with a label and a score without many ties.
    "scored_loans": """
        select o_orderkey, o_orderpriority, cast(o_orderdate as date) as d,
               case when o_orderstatus = 'F' then 1 else 0 end as y,
               o_totalprice / (o_totalprice + 200000) as p
        from {orders}
    """,
    # Line items with a label and a score with 11 distinct values.
    "scored_ties": """
        select l_returnflag, l_linestatus, case when l_returnflag = 'R' then 1 else 0 end as y,
               l_discount * 9 + cast(0.05 as double) as p
        from {lineitem}
    """,
    # Line items as feature rows: repeats, zeros, missing values, categories.
    "feature_rows": """
        select l_extendedprice as price, nullif(l_discount, 0) as discount, l_tax as tax, l_quantity as quantity,
               case when l_linenumber < 5 then 0 else l_linenumber end as mostly_zero,
               l_returnflag as flag, l_linestatus as state, l_shipdate as shipped,
               case when l_quantity > 25 then 1 else 0 end as y
        from {lineitem}
    """,
    "predictions": """
        select event_id as prediction_id, cast(event_id as string) as loan_id, cast(user_id as string) as customer_id,
               case when event_type = 'error' then 'm2' else 'm1' end as model_id,
               value / (value + 150) as default_probability,
               cast(floor(900 - 600 * (value / (value + 50))) as int) as credit_score,
               case when value < 17 then 'VERY_LOW' when value < 25 then 'LOW' when value < 36 then 'MODERATE'
                    when value < 70 then 'HIGH' else 'VERY_HIGH' end as risk_category,
               case when value < 20 then 'APPROVE' when value < 70 then 'REVIEW' else 'REJECT' end as recommendation,
               cast(user_id * 3 + event_id % 7 as int) as latency_ms,
               case when event_type = 'view' then 'PERSONAL' when event_type = 'click' then 'HOME'
                    when event_type = 'purchase' then 'AUTO' when event_type = 'signup' then 'BUSINESS' end as loan_type,
               cast(18 + user_id % 60 as int) as age,
               value * 20000 as annual_income,
               case when user_id % 4 = 0 then 'SALARIED' when user_id % 4 = 1 then 'SELF_EMPLOYED'
                    when user_id % 4 = 2 then 'BUSINESS_OWNER' end as employment_type,
               ts as created_at
        from {events}
    """,
}

# Check SQL of the per-loan frame: latest snapshot on or before the application.
MERGED = """
    select l.loan_id, l.customer_id, l.application_date, c.age, c.gender, c.marital_status, c.dependents, c.education,
           c.employment_type, c.employment_years, c.annual_income, c.city_tier, l.loan_type, l.loan_amount,
           l.loan_tenure_months, l.interest_rate, l.loan_purpose, f.as_of_date as financial_as_of_date,
           f.monthly_income, f.monthly_expenses, f.existing_loan_count, f.existing_loan_amount, f.monthly_emi,
           f.savings_balance, f.total_assets, f.total_liabilities, h.as_of_date as credit_as_of_date,
           h.credit_history_months, h.num_credit_accounts, h.total_credit_limit, h.total_outstanding,
           h.previous_defaults, h.late_payments_12m, h.missed_payments_12m, h.active_loans, h.closed_loans,
           h.credit_utilization as bureau
    from {loan_applications} l
    left join {customers} c on l.customer_id = c.customer_id
    asof left join {financial_profiles} f on l.customer_id = f.customer_id and l.application_date >= f.as_of_date
    asof left join {credit_history} h on l.customer_id = h.customer_id and l.application_date >= h.as_of_date
"""


def _braces(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


CREDIT = ("customers", "loan_applications", "financial_profiles", "credit_history", "loan_outcomes")
#: Derived tables with a row per customer and day of its line items.
DAILY = ("financial_profiles", "credit_history")
_DAY = "cast(l_shipdate as date)"
_AGGREGATE = r"\b(min|max|count)\((\w+|\*)\)"


def _aggregate_name(found: re.Match) -> str:
    return f"{found[1]}_{found[2].replace('*', 'rows')}"


def daily_rows_sql() -> tuple[str, str]:
    """The text of ``daily_sql`` in two steps: the joined rows, and their aggregates."""
    head, tail = re.split(r"(?=\bfrom \{)", daily_sql()[0], maxsplit=1)
    tail = tail[: tail.index("group by")]
    columns = dict.fromkeys(m[2] for m in re.finditer(_AGGREGATE, head) if m[2] != "*")
    rows = f"select cast(o_custkey as string) as customer_id, o_custkey, {_DAY} as day, {', '.join(columns)} {tail}"
    return rows, head.replace(_DAY, "day").replace("day as day", "day") + "from {rows} group by o_custkey, day"


def daily_sql() -> tuple[str, dict[str, str]]:
    """Text of one table with all aggregates that the DAILY tables take, and the text of
    each of those over it: line items and orders are joined and grouped once for both."""
    heads, tails = zip(*(re.split(r"(?=\bfrom \{)", DERIVED[n], maxsplit=1) for n in DAILY))
    if len({" ".join(tail.split()) for tail in tails}) > 1:
        raise ValueError("the daily tables are grouped differently")
    found = {m[0]: _aggregate_name(m) for head in heads for m in re.finditer(_AGGREGATE, head)}
    base = f"select o_custkey, {_DAY} as day, {', '.join(f'{a} as {n}' for a, n in found.items())} {tails[0]}"
    return base, {n: re.sub(_AGGREGATE, _aggregate_name, head).replace(_DAY, "day") + "from {daily}" for n, head in zip(DAILY, heads)}


class Asked(Mapping):
    """Tables by name, each got by ``read`` when it is asked for."""

    def __init__(self, read: Callable[[str], DataFrame], names: dict[str, str]) -> None:
        self._read, self._names = read, names

    def __getitem__(self, name: str) -> DataFrame:
        return self._read(self._names[name])

    def __contains__(self, name: object) -> bool:
        return name in self._names

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


_STORED: dict[tuple, DataFrame] = {}


class Inputs:
    """Lazily built tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in RAW:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                text = DERIVED[name]
                self._made[name] = self.spark.sql(text, **{n: self[n] for n in _braces(text)})
        return self._made[name]

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self[n] for n in _braces(text)})

    def stored(self, name: str) -> DataFrame:
        """A derived table written once per session and data folder, as the credit
        tables would lie on storage.  The DAILY tables are read from one written table."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            with lasting():
                if name in DAILY:
                    _STORED[key] = self.spark.sql(daily_sql()[1][name], daily=self.stored("daily"))
                elif name == "daily" and self.slices() > 1:
                    _STORED[key] = self._daily_by_slices()
                else:
                    _STORED[key] = materialize(self.sql(daily_sql()[0]) if name == "daily" else self[name])
        return _STORED[key]

    def slices(self) -> int:
        """How many slices of customers the line items are worked on in."""
        return slices_of(self["lineitem"].count())

    def _daily_by_slices(self) -> DataFrame:
        """The daily table, aggregated slice by slice; its column ``_slice`` has their numbers."""
        rows, daily = daily_rows_sql()
        path = f"{shared_dir(self.spark)}/riskframe-{uuid.uuid4().hex}"
        with passing(self.spark):
            for i, part in enumerate(write_slices(self.sql(rows), "customer_id", self.slices())):
                found = self.spark.sql(daily, rows=part)
                found.write.parquet(f"{path}/_slice={i}")
        return read_slices(self.spark, path, found.schema)

    def credit_slices(self) -> Iterator[dict[str, DataFrame]]:
        """The credit tables but outcomes, by slices of customers: all of a customer's rows are
        in the same one.  Few rows are one slice, of tables that are not written."""
        names, n = [t for t in CREDIT if t != "loan_outcomes"], self.slices()
        if n == 1:
            yield {t: self[t] for t in names}
            return
        for i in range(n):
            part = {t: self.spark.sql(daily_sql()[1][t], daily=self.stored("daily").where(F.col("_slice") == i)) for t in DAILY}
            yield part | {t: self[t].where(slice_of("customer_id", n) == i) for t in names if t not in DAILY}

    def credit(self, **replaced: str) -> Mapping[str, DataFrame]:
        """The credit tables by name; ``replaced`` names other tables to be taken for some."""
        return Asked(self.stored, {n: n for n in CREDIT} | replaced)

    def derived(self) -> Mapping[str, DataFrame]:
        """The credit tables by name, not written: for queries of few rules, which take
        the columns they need, and cost the same whatever ran before in the session."""
        return Asked(self.__getitem__, {n: n for n in CREDIT})


def with_inputs(body: str) -> str:
    """SQL whose braces name input tables, as one statement for the check engine.
    ``body`` may start with ``with``; input tables come first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in RAW or name in order:
            return
        for n in _braces(DERIVED[name]):
            visit(n)
        order.append(name)

    for n in _braces(body):
        visit(n)
    names = {n: n for n in [*RAW, *DERIVED]}
    ctes = [f"{n} as ({DERIVED[n].format(**names)})" for n in order]
    body = re.sub(r"\{(\w+)\}", r"\1", body).strip()
    if body.lower().startswith("with "):
        ctes.append(body[5:])
        return "with " + ",\n".join(ctes)
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body

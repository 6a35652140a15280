"""Sources and sinks: every query writes or reads through shared storage."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from registered.base import query
from riskframe.operators import registry
from riskframe.operators.ordered import shared_dir
from riskframe.sources import model_store, ranged, tables


def folder(t) -> str:
    return f"{shared_dir(t.spark)}/storage-{uuid.uuid4().hex}"


@query("write_and_read_dataset", """
    select 'customers' as "table", count(*) as n from {customers} union all select 'loan_applications', count(*) from {loan_applications}
    union all select 'financial_profiles', count(*) from {financial_profiles} union all select 'credit_history', count(*) from {credit_history}
    union all select 'loan_outcomes', count(*) from {loan_outcomes}
""")
def dataset(t):
    root, version = folder(t), tables.dataset_version({"seed": 42})
    tables.write_dataset(t.credit(), root, version, {"seed": 42})
    counts = tables.read_metadata(t.spark, root, version)["row_counts"]
    back = tables.read_tables(t.spark, root, version)
    if {n: df.count() for n, df in back.items()} != counts:
        raise ValueError("row counts of the metadata and the tables differ")
    return t.spark.createDataFrame(list(counts.items()), "`table` string, n long")


@query("fetch_filtered", "select * from {orders} where o_orderstatus = 'F' and o_orderpriority = '2-HIGH'")
def fetch(t):
    return tables.fetch(t["orders"], {"o_orderstatus": "F", "o_orderpriority": "2-HIGH"})


@query("get_by_id", "select * from {orders} where o_orderkey = 77")
def by_id(t):
    return tables.get_by_id(t["orders"], "o_orderkey", 77)


@query("insert_append", "select count(*) * 2 as n from {orders}")
def append(t):
    path = folder(t)
    tables.insert(t["orders"], path)
    tables.insert(t["orders"], path)
    return t.spark.read.parquet(path).agg(F.count("*").alias("n"))


@query("upsert", """
    select o_orderkey, case when o_orderstatus = 'F' then 'Z' else o_orderstatus end as o_orderstatus, o_totalprice from {orders}
    union all select -1 - o_orderkey, 'N', o_totalprice from {orders} where o_orderstatus = 'P'
""")
def upsert(t):
    path = folder(t)
    now = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    tables.reload(now, path)
    changed = now.where("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("Z"))
    new = now.where("o_orderstatus = 'P'").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    tables.upsert_table(t.spark, path, changed.unionByName(new), ["o_orderkey"])
    return tables.read_current(t.spark, path)


@query("upsert_ranges", """
    select o_orderkey, case when o_orderstatus = 'F' and o_orderkey % 1000 < 100 then 'Z' else o_orderstatus end as o_orderstatus, o_totalprice from {orders}
    union all select -1 - o_orderkey, 'N', o_totalprice from {orders} where o_orderstatus = 'P'
""")
def upsert_ranges(t):
    """The orders in files of key ranges; two upserts, one of old keys and one of new."""
    path = folder(t)
    now = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    ranged.upsert(t.spark, path, now, ["o_orderkey"])
    ranged.upsert(t.spark, path, now.where("o_orderstatus = 'F' and o_orderkey % 1000 < 100").withColumn("o_orderstatus", F.lit("Z")), ["o_orderkey"])
    new = now.where("o_orderstatus = 'P'").select((-1 - F.col("o_orderkey")).alias("o_orderkey"), F.lit("N").alias("o_orderstatus"), "o_totalprice")
    ranged.upsert(t.spark, path, new, ["o_orderkey"])
    return ranged.read(t.spark, path)


@query("model_artefacts", """
    select 'm' as model_id, '1.0.0' as model_version, 'counts' as artefact, o_orderstatus as item, count(*) as n, round(avg(o_totalprice), 4) as mean
    from {orders} group by o_orderstatus
""")
def model_artefacts(t):
    """A report of the orders, attached to a registered model and read back by its row."""
    root = folder(t)
    mean = t["orders"].agg(F.avg("o_totalprice")).first()[0]
    model_store.register(t.spark, root, {"model_id": "m", "metrics": {"mean": mean}})
    counts = t["orders"].groupBy(F.lit("counts").alias("artefact"), F.col("o_orderstatus").alias("item")).agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    model_store.attach(t.spark, root, "m", {"mean": mean}, {"counts": counts})
    row = model_store.models(t.spark, root).select("model_id", "model_version", F.explode("artefacts").alias("artefact", "folder")).drop("folder")
    return row.join(model_store.report(t.spark, root, "m")["counts"], "artefact")


@query("truncate_and_reload", "select o_orderkey, o_custkey from {orders}")
def reload(t):
    path = folder(t)
    rows = t["orders"].select("o_orderkey", "o_custkey")
    tables.reload(rows, path)
    tables.reload(rows, path)
    return t.spark.read.parquet(path)


@query("csv_export", "select o_orderpriority, count(*) as n from {orders} group by 1")
def csv(t):
    path = folder(t)
    tables.write_csv(t["orders"].groupBy("o_orderpriority").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("o_orderpriority string, n long").option("header", True).csv(path)


@query("json_export", "select o_orderstatus, count(*) as n from {orders} group by 1")
def json_export(t):
    path = folder(t)
    tables.write_report_json(t["orders"].groupBy("o_orderstatus").agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("o_orderstatus string, n long").json(path)


@query("issue_log", "select 'loan_applications' as table_name, cast(event_id as string) as record_key, event_type as rule_name from {events}")
def issue_log(t):
    path = folder(t)
    v = t["events"].select(F.lit("loan_applications").alias("table"), F.col("event_id").cast("string").alias("record_key"),
                           F.col("event_type").alias("rule_name"), F.lit("ERROR").alias("severity"), F.lit("").alias("detail"))
    tables.append_issues(v, path)
    return t.spark.read.parquet(path).select("table_name", "record_key", "rule_name")


def models(t):
    """One registered model per event type, with metrics from the events."""
    e = t["events"].groupBy("event_type").agg(F.avg("value").alias("v"), F.max("ts").alias("ts"))
    place = F.dense_rank().over(Window.orderBy("event_type"))
    return e.select(
        F.concat(F.lit("m_"), "event_type").alias("model_id"), F.concat(F.lit("1."), place.cast("string"), F.lit(".0")).alias("model_version"),
        F.lit("logistic_regression").alias("algorithm"), F.col("ts").cast("timestamp").alias("training_date"), F.lit("ds").alias("dataset_version"),
        F.array(F.lit("a"), F.lit("b")).alias("feature_list"), F.create_map(F.lit("C"), F.lit("1.0")).alias("hyperparameters"),
        F.create_map(F.lit("roc_auc"), F.round("v", 6), F.lit("chosen_threshold"), F.lit(0.1)).alias("metrics"),
        F.lit("").alias("artifact_path"), (F.col("event_type") == "click").alias("is_active"),
    )


@query("merge_metrics", """
    select 'm_' || event_type as model_id, round(avg(value), 6) as roc_auc, case when event_type = 'view' then 0.2::double else 0.1::double end as chosen_threshold,
        case when event_type = 'view' then 0.5::double end as gini from {events} group by event_type
""")
def merge(t):
    out = tables.merge_metrics(models(t), "m_view", {"chosen_threshold": 0.2, "gini": 0.5})
    return out.select("model_id", *[F.try_element_at("metrics", F.lit(k)).alias(k) for k in ("roc_auc", "chosen_threshold", "gini")])


@query("registry_next_version", "select '1.' || cast(count(distinct event_type) + 1 as string) || '.0' as next_version from {events}")
def next_version(t):
    return registry.next_version(models(t))


@query("registry_activate", "select distinct 'm_' || event_type as model_id, event_type = 'error' as is_active from {events}")
def activate(t):
    return registry.activate(models(t), "m_error").select("model_id", "is_active")


@query("registry_card", "select 'm_click' as model_id, round(avg(value), 6) as roc_auc, 0.1::double as chosen_threshold, 2 as feature_count from {events} where event_type = 'click'")
def card(t):
    return registry.model_card(models(t)).select("model_id", F.col("metrics")["roc_auc"].alias("roc_auc"), "chosen_threshold", "feature_count")


@query("registry_versions", """
    select 'm_' || event_type as model_id, cast(row_number() over (order by max(ts) desc) as int) as place from {events} group by event_type
""")
def versions(t):
    rows = [(row.model_id, i + 1) for i, row in enumerate(registry.versions(models(t)).collect())]
    return t.spark.createDataFrame(rows, "model_id string, place int")

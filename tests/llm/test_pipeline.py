import re

import __spark_entry__ as entry
import corpus_pipeline
from riskframe.llm import packing, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, words=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {" ".join(found[i:i + words]) for i in range(len(found) - words + 1)} or {" ".join(found)}


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert any(re.fullmatch(rf"op{n}_\w+", x) for x in names)
    assert names["pipeline"] is corpus_pipeline.run and set(queries.CHECKS) <= set(queries.QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "SimHash near-dedup", "secret scans", "packing"]


def planted(spark, prose):
    """Documents of the given table, to which cases are added."""
    base = spark.read.parquet(f"{SF}/documents.parquet").select(*COLUMNS)
    long = next(r["text"] for r in base.orderBy("doc_id").collect() if len(r["text"].split()) > 400)
    words = long.split(" ")
    near = " ".join([*words[:200], "changed", *words[201:]])
    rows = [
        (9001, "12 34 !!", "en"), (9002, None, "en"), (9003, long + "  \n", "en"), (9004, near, "en"),
        (9005, 'the hand and the sea. password = "hunter2hunter2" was there', "en"), (9006, "the sea and the hand that was there once more", None),
    ]
    extra = spark.createDataFrame([(i, t, k, "planted", len(t or "")) for i, t, k in rows], base.schema)
    return base.unionByName(extra), long


def test_stages_on_planted_cases(spark, prose):
    docs, long = planted(spark, prose)
    stages = dict(corpus_pipeline.STAGES)
    first = stages["language ID"](spark, docs, SF)
    assert first.columns == COLUMNS
    kept = {r["doc_id"]: r for r in first.collect()}
    assert set(docs.toPandas().doc_id) - set(kept) == {9001, 9002}
    assert kept[9006]["lang"] == "en"
    second = stages["exact dedup"](spark, first, SF)
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in second.collect()]
    assert second.columns == COLUMNS and len(texts) == len(set(texts)) and set(texts) == {re.sub(r"[\x20\x09-\x0D]", "", r["text"]) for r in kept.values()}
    # The planted copy has more code points than what it copies.
    assert 9003 in {r["doc_id"] for r in second.collect()}
    third = stages["SimHash near-dedup"](spark, second, SF)
    left, stays = second.collect(), {r["doc_id"] for r in third.collect()}
    assert third.columns == COLUMNS and len({9003, 9004} & stays) <= 1
    sets = {r["doc_id"]: shingles(r["text"]) for r in left}
    for r in left:
        if r["doc_id"] not in stays:
            best = max(len(sets[r["doc_id"]] & s) / len(sets[r["doc_id"]] | s) for i, s in sets.items() if i != r["doc_id"])
            assert best >= 0.6
    close = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    caught = sum(not {a, b} <= stays for a, b in close)
    assert caught >= 0.9 * len(close)
    fourth = stages["secret scans"](spark, third, SF)
    changed = {r["doc_id"]: r for r in fourth.collect()}
    assert fourth.columns == COLUMNS and set(changed) == stays
    assert changed[9005]["text"] == 'the hand and the sea. [SECRET]" was there' and changed[9005]["n_chars"] == len(changed[9005]["text"])
    assert changed[9006]["text"] == "the sea and the hand that was there once more"
    last = stages["packing"](spark, fourth, SF)
    assert {r["doc_id"] for r in last.select("doc_id").distinct().collect()} == stays
    assert set(packing.SCHEMA.replace(" long", "").replace(" binary", "").split(", ")) == set(last.columns)


def test_run_applies_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    total = out.groupBy("sequence_id").sum("length").collect()
    assert total and all(0 < r[1] <= 1024 for r in total)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0

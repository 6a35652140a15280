from riskframe.llm import near_copies


def texts(prose_words):
    long = " ".join(prose_words)
    return [(5, long), (3, long + " end"), (9, "quite another text of a few words"), (7, "  ".join(prose_words) + " end more")]


def test_simhash_links_are_part_of_the_search(spark, monkeypatch):
    words = [f"w{i * i % 611}" for i in range(700)]
    docs = spark.createDataFrame(texts(words), "doc_id long, text string")
    calls, links = [], near_copies.links

    def record(classes, count, *args, **kwargs):
        calls.append(count)
        return links(classes, count, *args, **kwargs)

    monkeypatch.setattr(near_copies, "links", record, raising=False)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, 0.8).collect()}
    assert calls and found == {5: 3, 3: 3, 7: 3, 9: 9}


def test_close_fingerprints_link_without_a_common_bucket(spark, monkeypatch):
    """The SimHash links stand by themselves: no two classes share a key here."""
    words = [f"w{i * i % 611}" for i in range(700)]
    docs = spark.createDataFrame(texts(words)[:3], "doc_id long, text string")
    signed = near_copies.signatures(docs, "doc_id", "text", 5)
    apart = signed.withColumn("keys", near_copies.F.transform("keys", lambda k: near_copies.F.xxhash64(k, near_copies.F.col("id"))))
    monkeypatch.setattr(near_copies, "signatures", lambda *args: apart)
    found = {r["doc_id"]: r["component_id"] for r in near_copies.near_copies(docs, 0.8).collect()}
    assert found == {5: 3, 3: 3, 9: 9}

import re

import numpy as np
import pytest
import xxhash

from riskframe.llm import components, embed_dedup, lattice, simhash


def brute_fingerprint(text, words=3):
    found = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not found:
        return 0
    runs = [" ".join(found[i:i + words]) for i in range(len(found) - words + 1)] or [" ".join(found)]
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_rows(prose):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "one"), (5, "One"), (6, "é È x"), (7, "é È x y")]
    for g in range(12):
        words = prose(g, 400).split()
        for k in range(6):
            some = list(words)
            for j in range(k):
                some[(37 * j + 11 * g) % 400] = f"new{k}{j}"
            rows.append((100 + 10 * g + k, " ".join(some)))
    return rows + [(100, rows[7][1])]


@pytest.mark.parametrize("bucket_rows", [20_000, 2])
def test_near_duplicates_match_brute_force(documents, prose, bucket_rows):
    rows = near_rows(prose)
    prints = {i: brute_fingerprint(t) for i, t in rows}
    ids = sorted(prints)
    linked = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1:] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = brute_components(ids, linked)
    assert len(set(want.values())) < len(ids) - 10
    got = simhash.near_duplicates(documents(rows), bucket_rows=bucket_rows).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert simhash.near_duplicates(documents([])).count() == 0


def test_index_finds_every_pair():
    g = np.random.default_rng(4)
    base = g.integers(0, 2**64, 60, dtype=np.uint64)
    fp = np.concatenate([base] + [base ^ (np.uint64(1) << g.integers(0, 64, 60, dtype=np.uint64)) ^ (np.uint64(1) << g.integers(0, 64, 60, dtype=np.uint64)) for _ in range(20)])
    bucket = np.sort(g.integers(0, 3, len(fp)))
    order = np.lexsort((simhash.gray_rank(fp), bucket))
    fp, bucket = fp[order], bucket[order]
    got = set()
    for a, b in simhash.GrayIndex(fp, bucket).pairs(3):
        got |= set(zip(a.tolist(), b.tolist()))
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    want = {(a, b) for a, b in zip(*map(np.ndarray.tolist, np.nonzero(near))) if a < b and bucket[a] == bucket[b]}
    assert got == want and len(want) > 500


def test_tables_of_any_size_lose_no_pair():
    for classes in (10, 1 << 20, 1 << 34):
        for distance in (3, 6):
            tables = [sum(1 << b for b in bits) for bits in simhash._tables(classes, distance)]
            g = np.random.default_rng(classes % 97)
            for _ in range(300):
                flip = sum(1 << int(b) for b in g.choice(64, distance, replace=False))
                assert any(not flip & t for t in tables)


def test_verified_links_keep_different_texts_apart(documents, prose):
    words = prose(1, 300).split()
    shuffled = words[150:] + words[:150]
    changed = words[:100] + ["other"] + words[101:]
    rows = [(1, " ".join(words)), (2, " ".join(reversed(shuffled))), (3, " ".join(changed))]
    found = simhash.near_duplicates(documents(rows), words=1, distinct=True, distance=6, check_words=5, check_distance=simhash.check_limit(0.8))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 2, 3: 1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(10, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(200, 201 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 10 for i in range(11, 41)} | {101: 100} | {201 + i: 200 for i in range(50)}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_decoding_gives_the_nearest_lattice_point():
    x = np.random.default_rng(2).normal(size=(300, 8)) * 2
    got = lattice.decode(x)
    doubled = (2 * got).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all()) and (got.sum(axis=1) % 2 == 0).all()
    distance = ((x - got) ** 2).sum(axis=1)
    around = got[:, None] + lattice.roots()[None]
    assert (distance <= ((x[:, None] - around) ** 2).sum(axis=2).min(axis=1) + 1e-9).all() and distance.max() <= 1 + 1e-9


def vectors():
    g = np.random.default_rng(8)
    rows, i = [], 0
    for label in (0, 1, None):
        for _ in range(40):
            centre = g.normal(size=16)
            for _ in range(4):
                rows.append((i, (centre + g.normal(size=16) * 0.1 * g.random()).tolist(), label))
                i += 1
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [1.0] * 15 + [None], 0), (1003, [float("nan")] * 16, 0), (1004, [float("inf")] + [1.0] * 15, 0), (1005, [], 1)]
    rows += [(1006, rows[0][1], 0), (1007, [-x for x in rows[0][1]], 0), (1008, [2 * x for x in rows[0][1]], 0), (1009, rows[0][1][:8], 0), (1010, rows[0][1], 1)]
    return rows


@pytest.mark.parametrize("block", [8192, 3])
def test_vectors_match_brute_force(spark, block):
    rows = vectors()

    def fit(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    good = [(i, np.array(v) / np.linalg.norm(v), k) for i, v, k in rows if k is not None and fit(v)]
    linked = [(a[0], b[0]) for x, a in enumerate(good) for b in good[x + 1:] if a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.98]
    n = {i: 0 for i, _, _ in rows}
    for a, b in linked:
        n[a] += 1
        n[b] += 1
    want = brute_components(n, linked)
    df = spark.createDataFrame([(i, v, k, "x") for i, v, k in rows], "vec_id long, embedding array<double>, label int, cell string").repartition(3)
    got = {r["vec_id"]: r for r in embed_dedup.near_vectors(df, scale=8.0, block=block).collect()}
    assert len(got) == len(rows)
    missed = sum(n[i] - got[i]["n_links"] for i in n)
    assert all(got[i]["n_links"] <= n[i] for i in n) and missed <= 0.1 * 2 * len(linked) and len(linked) > 100
    if not missed:
        assert {i: got[i]["component_id"] for i in n} == want
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in n)


def test_blocks_count_the_same(spark):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    a, b = (sorted(map(tuple, embed_dedup.near_vectors(df, block=n).collect())) for n in (8192, 2))
    assert a == b


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embed_dedup.near_vectors(df).count() == 0


def test_recall_on_the_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = df.collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r["label"] for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(x), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in embed_dedup.near_vectors(df).collect()}
    found = sum(got.values())
    assert all(got[i] <= n for i, n in zip(ids.tolist(), near.sum(axis=1).tolist())) and found >= 0.9 * near.sum()

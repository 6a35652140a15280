import random

import pytest

import corpus_pipeline
from riskframe.llm import near_copies


def shingles(text, words=5):
    found = text.lower().split()
    return {" ".join(found[i:i + words]) for i in range(len(found) - words + 1)} or {" ".join(found)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(prose, seed, kind, share):
    """A text of 60 to 400 words and a copy with this share of it appended, cut off or substituted."""
    r = random.Random(seed)
    words = prose(seed, r.randint(60, 400)).split()
    n = max(1, round(share * len(words)))
    if kind == "appended":
        return " ".join(words), " ".join(words + prose(seed + 50_000, n).split())
    if kind == "cut":
        return " ".join(words), " ".join(words[:-n])
    some = list(words)
    for i in r.sample(range(len(words)), n):
        some[i] = f"new{i}"
    return " ".join(words), " ".join(some)


def stays(spark, documents, texts):
    docs = documents(list(enumerate(texts)))
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    return {r["doc_id"] for r in stage(spark, docs.select(*corpus_pipeline.DOCUMENTS), "").select("doc_id").collect()}


@pytest.mark.parametrize("kind, share", [("appended", 0.18), ("cut", 0.15), ("appended", 0.1), ("substituted", 0.012)])
def test_near_copies_are_found_however_they_differ(spark, documents, prose, kind, share):
    pairs = [edited(prose, s, kind, share) for s in range(80)]
    left = stays(spark, documents, [t for p in pairs for t in p])
    near = [i for i, p in enumerate(pairs) if jaccard(*p) >= 0.8]
    caught = sum(not {2 * i, 2 * i + 1} <= left for i in near)
    assert len(near) > 50 and caught >= 0.97 * len(near)


def test_nothing_below_the_similarity_is_dropped(spark, documents, prose):
    pairs = [edited(prose, s, "substituted", 0.026 if s % 2 else 0.03) for s in range(120)]
    pairs = [p for p in pairs if 0.6 <= jaccard(*p) < 0.8]
    assert len(pairs) > 80
    assert stays(spark, documents, [t for p in pairs for t in p]) == set(range(2 * len(pairs)))


def test_crowds_cut_into_blocks_match_brute_force(spark, documents, prose, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 4)
    monkeypatch.setattr(near_copies, "REACH", (1,))
    texts = ["", " ", "one two", "One  two", "one two three"]
    for g in range(3):
        words = prose(g, 200).split()
        for k in range(25):
            some = list(words)
            for i in random.Random(100 * g + k).sample(range(200), 1 + k % 6):
                some[i] = f"new{k}x{i}"
            texts.append(" ".join(some))
    ids = range(len(texts))
    label = list(ids)
    for a in ids:
        for b in range(a + 1, len(texts)):
            if label[a] != label[b] and jaccard(texts[a], texts[b]) >= 0.8:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    found = near_copies.near_copies(documents(list(enumerate(texts))), 0.8)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == dict(zip(ids, label))

"""Source divergence, benchmark decontamination and fill-in-middle against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskframe.llm import decontaminate, infill, source_audit

DOCS = "doc_id long, text string, lang string, source string, item string, rank string, h string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "i", "r", "h") for r in rows], DOCS).repartition(3)


# 11


def brute_divergence(rows, least=3, top=200):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or "")))) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        in_docs = Counter(t for d in mine for t in d[2])
        kept = [t for t, n in in_docs.items() if n >= least]
        groups, total = defaultdict(Counter), Counter()
        for _, source, c in mine:
            groups[source].update({t: n for t, n in c.items() if t in set(kept)})
            total.update({t: n for t, n in c.items() if t in set(kept)})
        scaled = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        p, q = {s: scaled(c) for s, c in groups.items()}, scaled(total)
        gap = lambda a, b: (a - b) ** 2 // b
        for s, c in groups.items():
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, gap(p[s][t], q[t])) for t in kept if c[t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1)]
    return sorted(out)


def audit_rows(prose):
    rows = [(i, prose(i % 7, 5 + i % 30), ("en", "de", None)[i % 3], f"s{i % 4}" if i % 11 else None) for i in range(90)]
    rows += [(500, None, "en", "silent"), (501, "", "xx", "a"), (502, "12 34 ", "xx", "b"), (503, "Été ÉTÉ été x", "fr", "only"), (503, "Été ÉTÉ été x", "fr", "only"), (504, "été É", "fr", "Only")]
    return rows + [(600, "w " * 20_000 + "amber", "en", "s0")]


def test_divergences_match_brute_force(spark, prose):
    rows = audit_rows(prose)
    got = sorted(map(tuple, source_audit.divergences(table(spark, rows)).collect()))
    assert got == brute_divergence(rows)


def test_small_pieces_shards_and_tiles(spark, prose, monkeypatch):
    """Answers don't depend on how texts, terms and sources are cut."""
    rows = [(i, prose(i % 5, 12), "en", f"s{i % 23}") for i in range(150)]
    want = brute_divergence(rows, top=3)
    batch = source_audit.pa.record_batch({"text": ["b a b", "", "c " * 50, "a"] * 5, "lang": ["x"] * 20, "source": ["y"] * 20})
    whole = list(source_audit._partial_counts(iter([batch])))
    monkeypatch.setattr(source_audit, "PIECE_BYTES", 8)
    monkeypatch.setattr(source_audit, "HELD_ROWS", 2)
    cut = list(source_audit._partial_counts(iter([batch])))
    assert len(cut) > len(whole)
    summed = Counter()
    for b in cut:
        for r in b.to_pylist():
            summed[r["term"]] += r["n"]
    assert summed == Counter({None: 0, "a": 10, "b": 10, "c": 250})
    monkeypatch.setattr(source_audit, "TILE", 4)
    got = source_audit.divergences(table(spark, rows), top=3, shard_rows=40)
    assert sorted(map(tuple, got.collect())) == want


def test_empty_audit(spark):
    assert source_audit.divergences(table(spark, [])).count() == 0


# 12


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = brute_words(text)
        for s in range(max(len(w) - size, 0) + 1 if w else 0):
            windows[tuple(w[s:s + size])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w, hit, held = brute_words(text), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                found = windows.get(tuple(w[s:s + n]))
                if found:
                    hit |= set(range(s, s + n))
                    held |= found
        out.append((i, len(w), len(hit), sorted(held, key=str.encode)))
    return out


def both(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "w", "h", "s") for i, t in docs], "doc_id long, text string, w string, h string, size string").repartition(3)
    b = spark.createDataFrame([(i, t, "w") for i, t in items], "item_id long, text string, wid string")
    got = [tuple(r) for r in decontaminate.contamination(d, b, **kw).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(got, key=key), sorted(brute_contamination(docs, items, kw.get("window", 10)), key=key)


def contaminated(prose):
    items = [(i, prose(1000 + i, 12 + i)) for i in range(12)] + [(50, prose(1003, 15)), (51, "Alpha, beta."), (52, "solo"), (53, None), (54, " .. "), (None, prose(77, 10)), (55, "a b a b a b a b a b a b")]
    docs = [(i, prose(i, 40)) for i in range(20)]
    docs += [(100 + i, prose(i, 10) + " " + (items[i % 12][1] or "").upper() + ". " + prose(i + 1, 5)) for i in range(30)]
    docs += [(200, None), (201, ""), (202, "x ALPHA beta solo, soloed Alpha--Beta"), (203, "b " + "a b " * 60), (204, prose(77, 10)), (None, items[2][1]), (205, items[0][1]), (205, items[0][1]), (205, "other " + items[1][1])]
    return docs + [(206, prose(5, 3000) + " " + items[4][1])], items


def test_contamination_matches_brute_force(spark, prose):
    got, want = both(spark, *contaminated(prose))
    assert got == want
    assert sum(r[2] > 0 for r in want) > 30


@pytest.mark.parametrize("kw", [{"broadcast_shingles": 0}, {"window": 4, "shingle": 2}, {"window": 3, "shingle": 5}, {"shingle": 1}])
def test_other_windows_and_the_shuffled_way(spark, prose, kw):
    got, want = both(spark, *contaminated(prose), **kw)
    assert got == want


def test_empty_documents_or_items(spark, prose):
    docs, items = contaminated(prose)
    assert both(spark, [], items)[0] == []
    got, want = both(spark, docs, [])
    assert got == want and not any(r[2] for r in got)


# 13


def brute_infill(i, text):
    n = len(text or "")
    digest = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return i, n, "plain", None, None, text or ""
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return i, n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = ["", None, "x", "\n", "\r\n \u0085", "🙂é\n🙂", "a<S>b", "<P", "<", "<<<>>>PSM<P <S <M", "$1\\$2", "(?s)", "é" * 3000, "🙂\n" * 70_000]


def test_infill_matches_brute_force_and_restores(spark, documents):
    rows = [(k * 100 + i, t) for i, t in enumerate(ODD) for k in range(12 if len(t or "") < 9999 else 2)] + [(None, "no id"), (9999, "again"), (9999, "again")]
    made = infill.transform(documents(rows)).withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r)[:6] for r in made), key=key) == sorted((brute_infill(*r) for r in rows), key=key)
    assert sorted(((r["doc_id"], r["back"]) for r in made), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}


@settings(max_examples=8, deadline=None)
@given(texts=st.lists(st.text(alphabet="<>PSM$\\é🙂\n x", max_size=40), max_size=30))
def test_infill_round_trip(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = infill.transform(docs).select("doc_id", infill.restore(F.col("output"), F.col("form")).alias("back"))
    assert {r["doc_id"]: r["back"] for r in made.collect()} == dict(enumerate(texts))


def test_infill_of_nothing_shuffles_nothing(documents):
    made = infill.transform(documents([]).coalesce(1))
    assert made.count() == 0
    plan = infill.transform(documents([(1, "x")]).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1  # the test table's own

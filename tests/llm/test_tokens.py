import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from riskframe.llm import bpe, chunks, packing, token_counts

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
ODD = " \n\t\r\x0b\x1c\x1f\x85\xa0​'sSdt0129٣½²ⅷaéñßжあ中\U0001f642.,!-́﻿"
TEXTS = [(1, None), (2, ""), (3, " "), (4, "plain words, and more words"), (5, "<|endoftext|> is ordinary"), (6, "x" * 5000), (7, "  lead\n\n and  trail  "), (8, "it's 'S 42's"), (4, "plain words, and more words")]


def odd_texts(n, seed=5):
    r = random.Random(seed)
    return [(100 + i, "".join(r.choice(ODD) for _ in range(r.randint(0, 40)))) for i in range(n)]


def oracle():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_encode_and_decode_match_the_library(documents):
    enc, rows = oracle(), TEXTS + odd_texts(300)
    got = bpe.decode(bpe.encode(documents(rows), RANKS, PATTERN), RANKS, PATTERN).collect()
    assert sorted((r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got) == sorted((i, enc.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r["doc_id"], bytes(r["decoded"])) for r in got) == sorted((i, (t or "").encode()) for i, t in rows)
    assert bpe.encode(documents([]), RANKS, PATTERN).count() == 0


def test_long_pre_tokens_merge_like_the_library():
    enc, b = oracle(), bpe.Bpe(bpe.read_ranks(RANKS), PATTERN)
    for text in ("ab" * 20_000, "abcdefghijklmnopqrstuvwxyz" * 500, "é" * 3000, "=" * 999):
        assert np.frombuffer(b.encode([text])[0], "<u4").tolist() == enc.encode_ordinary(text)
    assert b.decode(np.frombuffer(b.encode(["né 42"])[0], "<u4").tolist()) == "né 42".encode()


def test_equal_ranks_merge_from_the_left():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"aaa": 257}
    enc = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = ["a" * n for n in range(1, 20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Bpe(ranks, r"\w+").encode(words)] == [enc.encode_ordinary(w) for w in words]


def test_a_new_pair_may_have_a_lower_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"abc": 256, b"bc": 257, b"ab": 300, b"cab": 258, b"abab": 259}
    enc = tiktoken.Encoding("t", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    r = random.Random(2)
    words = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Bpe(ranks, r"\w+").encode(words)] == [enc.encode_ordinary(w) for w in words]


def test_joined_chunks_have_the_ids_of_each():
    for path in (JSON, public_tokenizers.path("word_bpe_49k.json")):  # the second is not byte-level: its chunks go singly
        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        parts = [" " + c for _, x in TEXTS + odd_texts(300) for c in chunks.split(x or "")] + ["first", "", "\u2003"]
        want = [np.array(t.encode(c, add_special_tokens=False).ids, dtype="<u4").tobytes() for c in parts]
        encoder = chunks.tokenizers_encoder(path)
        assert encoder.later.encode(parts) == want
        assert encoder.later.encode(parts[::-1]) == want[::-1]
    assert encoder.later.encode([]) == []
    # Lengths that do not meet the ends of the chunks divide nothing.
    wide = lambda cs: [c.encode("utf-32-le") for c in cs]
    assert chunks.encode_joined([" ab", " cd"], wide, np.full(256, 9)) == wide([" ab", " cd"])


def test_chunks_leave_ids_alone_while_the_cache_turns_over(monkeypatch):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    monkeypatch.setattr(chunks, "WINDOW", 50)
    encoder = chunks.tokenizers_encoder(JSON)
    encoder.later.size = encoder.first.size = 5
    texts = [x for _, x in TEXTS + odd_texts(200, 9)]
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder.texts(texts)]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_assign_fills_every_sequence_and_balances_cost():
    r = random.Random(1)
    lengths = [r.randint(1, 64) for _ in range(500)]
    out = packing.assign(lengths, 64)
    fill, cost = {}, {}
    for piece, start, n, s, offset in sorted(out, key=lambda x: (x[3], x[4])):
        assert offset == fill.get(s, 0)
        fill[s] = offset + n
        cost[s] = cost.get(s, 0) + n + n * n / 64
    assert sum(fill.values()) == sum(lengths)
    assert sorted(fill.values(), reverse=True) == packing.capacities(sum(lengths), 64)
    spans = {}
    for piece, start, n, _, _ in sorted(out):
        assert start == spans.get(piece, 0)
        spans[piece] = start + n
    assert spans == dict(enumerate(lengths))
    full = [c for s, c in cost.items() if fill[s] == 64]
    assert max(full) <= 2 * 64 and packing.assign([], 64) == []


def test_a_piece_goes_to_the_cheapest_sequence_with_room():
    # 8 + 8 open two sequences of 16; the next longest goes to the first of equal cost, and so on in turn.
    assert [x[3] for x in packing.assign([8, 8, 4, 4, 4, 4], 16)] == [0, 1, 0, 1, 0, 1]


def test_pieces_hold_each_id_once(documents):
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    rows = [*TEXTS[:-1], *odd_texts(40), (60, "many words of text " * 900)]
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in rows}
    got = packing.pack(documents(rows), JSON, block_tokens=600).collect()
    sequences, seen = {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == seen.get(r["doc_id"], 0) and r["doc_tokens"] == len(want[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        seen[r["doc_id"]] = r["start"] + r["length"]
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert seen == {i: len(x) for i, x in want.items()}
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(documents([]), JSON).count() == 0


def test_token_counts_across_blocks(documents):
    enc, rows = oracle(), TEXTS + odd_texts(60)
    for block in (7, 64, 1 << 18):
        got = token_counts.count_tokens(token_counts.token_blocks(documents(rows), JSON, 50256, block_ids=block), 50256).collect()
        assert sorted((r["doc_id"], r["n_tokens"]) for r in got) == sorted((i, len(enc.encode_ordinary(t or ""))) for i, t in rows)
        assert all(r["closed"] for r in got)
    assert token_counts.count_tokens(token_counts.token_blocks(documents([]), JSON, 50256), 50256).count() == 0


def test_flat_files_with_documents_over_many_blocks(spark, tmp_path):
    files = {"a": [3, 9, 1, 1, 1, 1, 1, 1, 9, 9, 5], "b": [9], "c": [1] * 12, "d": [], "e": [2, 2, 9]}
    for name, ids in files.items():
        (tmp_path / f"{name}.bin").write_bytes(np.array(ids, dtype="<u2").tobytes())
    got = token_counts.count_tokens(token_counts.file_blocks(spark, str(tmp_path), block_ids=2), 9).collect()
    counts = {n: [(r["n_tokens"], r["closed"]) for r in sorted(got, key=lambda r: r["ordinal"]) if r["file"].endswith(f"/{n}.bin")] for n in files}
    assert counts == {"a": [(1, True), (6, True), (0, True), (1, False)], "b": [(0, True)], "c": [(12, False)], "d": [], "e": [(2, True)]}
    wide = tmp_path / "wide"
    wide.mkdir()
    (wide / "w.bin").write_bytes(np.array([70000, 9, 9], dtype="<u4").tobytes())
    assert [r["n_tokens"] for r in token_counts.count_tokens(token_counts.file_blocks(spark, str(wide), width=4), 9, width=4).orderBy("ordinal").collect()] == [1, 0]


def test_crc_of_pieces_is_unsigned(spark):
    from pyspark.sql import functions as F

    data = b"\xff" * 12
    assert spark.range(1).select(F.crc32(F.lit(data))).first()[0] == zlib.crc32(data)

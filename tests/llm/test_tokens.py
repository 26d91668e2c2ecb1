import base64
import random

import pytest
from pyspark.sql import functions as F

from filament.llm import tokens

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = ["'", " ", "  ", "\n", "\t", "s", "t", "re", "ve", "ll", "d", "m", "a", "B", "1", "½", "²", "!", "'s", "é", "日", "　", " ", "\x85", "\x1c", "​", "😀", "<|endoftext|>", "\r\n", "_", "́", "Ⅷ", "٣", " ", "﻿"]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{tokens.TOKENIZERS}/{tokens.VOCABULARY}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts):
    enc, out = tokens.encoder(tokens.TOKENIZERS, tokens.VOCABULARY), []
    for n, ids, first in tokens.encode_batches(texts, enc):
        out += [ids[first[i] : first[i + 1]].tolist() for i in range(n)]
    return out


def test_against_the_library(reference):
    r = random.Random(1)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 14))) for _ in range(5000)]
    texts += ["".join(chr(r.choice([r.randint(0, 0xD7FF), r.randint(0xE000, 0x10FFFF)])) for _ in range(8)) for _ in range(2000)]
    assert encode(texts) == [reference.encode_ordinary(t) for t in texts]


def test_long_texts(reference, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_CHARS", 1000)
    r = random.Random(2)
    long = " ".join(r.choice(["don't", "stop", "x" * 30, "1 2", "\n\n ", "it's"]) for _ in range(4000))
    texts = [long, "", "x" * 5000, " " * 5000, long + "   ", "a"]
    assert encode(texts) == [reference.encode_ordinary(t) for t in texts]


def test_small_cache(reference, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_SLICES", 5)
    enc = tokens.Encoder(tokens.TOKENIZERS, tokens.VOCABULARY)
    for k in range(20):
        texts = [f"word{k} other{k * 7} {'z' * k}", "same words again"]
        ids, first, _ = enc.encode(texts)
        assert [ids[first[i] : first[i + 1]].tolist() for i in range(2)] == [reference.encode_ordinary(t) for t in texts]


def test_offsets():
    enc = tokens.encoder(tokens.TOKENIZERS, tokens.VOCABULARY)
    ids, first, begin = enc.encode(["ab cd", "", "ef"])
    assert first[-1] == len(ids) == len(begin) and begin[0] == 0 and begin[first[2]] == 5


def test_table_and_round_trip(spark):
    texts = ["Hello <|endoftext|> world", None, "", "  \n", "日本語 text", "Hello <|endoftext|> world", "\u0000x"]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = tokens.token_ids(df, "doc_id", "text")
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    ids = {r.doc_id: r.ids for r in got.collect()}
    assert ids[1] == ids[2] == [] and ids[0] == ids[5] and 50256 not in ids[0]
    back = {r.doc_id: r.text for r in tokens.decode_ids(got, "doc_id").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.token_ids(df.limit(0), "doc_id", "text").count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.lit(b"a\xff b").cast("string").alias("text"))
    assert tokens.decode_ids(tokens.token_ids(df, "doc_id", "text"), "doc_id").first().text == "a� b"


def test_offsets_of_all_ids(spark, reference, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_CHARS", 500)
    r = random.Random(4)
    texts = ["".join(r.choices(PIECES, k=r.randint(0, 14))) for _ in range(2000)] + [" ".join(r.choice(["don't", "x" * 30, "日本語😀", "\n\n "]) for _ in range(2000)), "", "é"]
    enc, got = tokens.encoder(tokens.TOKENIZERS, tokens.VOCABULARY), []
    for n, ids, first, where in tokens.batches_with_offsets(texts, enc):
        got += [(ids[first[i] : first[i + 1]].tolist(), where[first[i] : first[i + 1]].tolist()) for i in range(n)]
    assert got == [(ids, reference.decode_with_offsets(ids)[1]) for ids in map(reference.encode_ordinary, texts)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts[-200:], None])], "doc_id long, text string")
    table = tokens.token_ids(df, "doc_id", "text", offsets="offsets")
    assert table.dtypes == [("doc_id", "bigint"), ("ids", "array<int>"), ("offsets", "array<int>")]
    assert {x.doc_id: (x.ids, x.offsets) for x in table.collect()} == dict(enumerate([*got[-200:], ([], [])]))


def test_scan_against_single_steps():
    import numpy as np

    r = random.Random(7)
    after, cut = tokens.automaton()
    for k in (1, 2, 3, 50, 1000):
        texts = ["".join(r.choices(PIECES, k=r.randint(1, k))) for _ in range(5)]
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *map(len, texts[:-1])])
        state, expected = 0, []
        for s in tokens.symbols(points, starts):
            expected.append(bool(cut[s, state]))
            state = after[s, state]
        assert tokens.boundaries(points, starts).tolist() == expected


def test_merges_against_one_pair_at_a_time():
    merges = tokens.encoder(tokens.TOKENIZERS, tokens.VOCABULARY)._merges

    def slow(data):
        parts = [bytes([b]) for b in data]
        while True:
            least = min(((merges.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in merges.ranks), default=None)
            if least is None:
                return [merges.ranks[p] for p in parts]
            i = least[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    r = random.Random(9)
    data = [bytes(r.choices(b"aaabbetnioIN_19 \xe6\x97", k=r.randint(1, 60))) for _ in range(800)] + [b"a" * 47, b"a" * 300, b"ab" * 120]
    assert [list(x) for x in map(merges.one, data)] == [slow(d) for d in data]
    assert [list(x) for x in merges.many(data)] == [[merges.ranks[d]] if d in merges.ranks else slow(d) for d in data]
    assert merges.many([]) == []

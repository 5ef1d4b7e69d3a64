from __future__ import annotations

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from lodespan.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.read(PATH)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_equals_the_library(vocabulary, library):
    encoder, chance = bpe.Encoder(vocabulary, P.PATTERN), random.Random(1)
    letters = " \n\t aabbcdéß😀1２'sll==--__字한́<|endoftext|>"
    texts = ["".join(chance.choices(letters, k=chance.randint(0, 40))) for _ in range(3000)]
    for text in [*texts, "", "a" * 3000, "=" * 2000, " " * 2000, "ab" * 1500, "\n" * 99]:
        assert encoder.encode(text) == library.encode_ordinary(text)
        assert encoder.decode(encoder.encode(text)) == text.encode()


def test_appends_cuts_and_edits_are_exact(vocabulary):
    chance = random.Random(2)
    for _ in range(150):
        data = bytes(chance.choices(b"abcde ing the\xc3\xa9", k=chance.randint(0, 300)))
        prefixes = bpe.Prefixes(vocabulary, data)
        more = bytes(chance.choices(b"abcing", k=chance.randint(0, 9)))
        prefixes.append(more)
        assert prefixes.last == bpe.Prefixes(vocabulary, data + more).last
        a, b = sorted(chance.choices(range(len(prefixes.data) + 1), k=2))
        whole = prefixes.data[:a] + more + prefixes.data[b:]
        done = prefixes.replace(a, b, more)
        assert (prefixes.data, prefixes.last) == (whole, bpe.Prefixes(vocabulary, whole).last) and done <= len(whole)
        prefixes.cut(a)
        assert prefixes.ids() == bpe.Prefixes(vocabulary, whole[:a]).ids()


def test_edit_near_the_start_of_a_long_text_stays_local(vocabulary):
    prefixes = bpe.Prefixes(vocabulary, b"the quick brown fox " * 500)
    assert prefixes.replace(4, 9, b"slow") < 1000


def test_unknown_byte():
    with pytest.raises(ValueError, match="no token"):
        bpe.Prefixes(bpe.Vocabulary({b"a": 0}), b"ab")


def test_rows(spark, library):
    rows = [(1, None, "x"), (2, "", "x"), (3, "Hello  world's 𝛑\x00", None), (3, "Hello  world's 𝛑\x00", None), (4, "long " * 30_000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = bpe.digests(df, PATH, P.PATTERN).collect()
    assert len(got) == 5
    for (_, text, _), row in zip(rows, sorted(got, key=lambda r: r["doc_id"])):
        ids = library.encode_ordinary(text or "")
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).count() == 0
    coded = bpe.encode(df, PATH, P.PATTERN)
    assert coded.columns == ["doc_id", "text", "ids"] and coded.where("doc_id = 1").first()["ids"] == []


def test_round_trip_and_columns_of_any_name(spark):
    rows = [(i, f"word{i} — été", "x", 1, 2) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, c0 int, made0 int")
    apart = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH)
    assert apart.columns == [*df.columns, "ids", "decoded"]
    once = bpe.round_trip(df, PATH, P.PATTERN)
    assert once.columns == ["doc_id", "a.b", "c0", "made0", "ids", "decoded"]
    key = lambda r: r["doc_id"]
    for a, b, row in zip(sorted(apart.collect(), key=key), sorted(once.collect(), key=key), rows, strict=True):
        assert (a["ids"], a["decoded"], a["a.b"]) == (b["ids"], b["decoded"], "x") and bytes(a["decoded"]) == row[1].encode()


def test_full_caches_change_nothing(vocabulary, library, monkeypatch):
    for name in ("PIECE_BYTES", "STEM_BYTES", "PAIR_BYTES"):
        monkeypatch.setattr(bpe, name, 2000)
    encoder, chance = bpe.Encoder(bpe.Vocabulary(vocabulary.ranks), P.PATTERN), random.Random(3)
    text = " ".join("".join(chance.choices("abcdeing", k=chance.randint(1, 14))) for _ in range(2000))
    assert encoder.encode(text) == library.encode_ordinary(text)

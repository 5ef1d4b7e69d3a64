from __future__ import annotations

import random

import public_tokenizers as P
from tokenizers import Tokenizer, models

from lodespan.llm import tokencount

PATH = P.path("byte_bpe_50k.tiktoken")


def brute(data, scores):
    best = [(0, 0)]
    for end in range(1, len(data) + 1):
        best.append(max((best[a][0] + scores[data[a:end]], best[a][1] - 1) for a in range(end) if data[a:end] in scores))
    return -best[-1][1]


def test_equals_brute_force_at_any_trie_size():
    chance = random.Random(13)
    scores = {bytes([b]): -9000 for b in range(256)} | {bytes(chance.choices(b"abc", k=chance.randint(2, 6))): -chance.randint(5000, 30000) for _ in range(60)} | {b"": 0}
    scores.pop(b"")
    words = [bytes(chance.choices(b"abcd", k=chance.randint(0, 30))) for _ in range(500)] + [b"ab" * 100]
    for nodes in (40, 10_000):
        trie = tokencount.Trie(scores, nodes)
        for word in words:
            assert trie.count(word) == brute(word, scores)
            assert len(trie.best) <= max(nodes, 70)


def test_shared_beginnings_are_computed_once():
    trie = tokencount.Trie({bytes([b]): -1 for b in range(256)})
    for word in (b"abcd", b"abce", b"abc", b"abcd"):
        trie.count(word)
    assert len(trie.best) == 1 + 5


def test_equals_the_library():
    ranks = tokencount.read_ranks(PATH)
    scores = tokencount.zipf_scores(ranks)
    letters = [chr(0x100 + b) for b in range(256)]
    vocabulary = [("<unk>", -1e9), *(("".join(letters[b] for b in p), s / tokencount.UNIT) for p, s in scores.items())]
    library, trie, chance = Tokenizer(models.Unigram(vocabulary, 0, False)), tokencount.Trie(scores), random.Random(14)
    for _ in range(2000):
        data = bytes(chance.choices(b" the inging\xc3\xa9ation", k=chance.randint(1, 24)))
        assert trie.count(data) == len(library.encode("".join(letters[b] for b in data), add_special_tokens=False).ids)


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "Hello  world", 5), (3, "Hello  world", 5), (4, "x" * 50_000 + " the", None)], "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"], r["n_pretokens"], r["n_tokens"]) for r in tokencount.token_counts(df, PATH, P.PATTERN).collect())
    trie = tokencount.Trie(tokencount.zipf_scores(tokencount.read_ranks(PATH)))
    hello = sum(map(trie.count, [b"Hello", b" ", b" world"]))
    assert got == [(1, 0, 0), (2, 0, 0), (3, 3, hello), (3, 3, hello), (4, 2, trie.count(b"x" * 50_000) + trie.count(b" the"))]
    assert tokencount.token_counts(df.limit(0), PATH, P.PATTERN).count() == 0

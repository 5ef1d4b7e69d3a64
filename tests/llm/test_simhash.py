from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from lodespan.llm import components, simhash


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_stars_equal_union_find(spark):
    chance = random.Random(5)
    pairs = [(chance.randint(-40, 40), chance.randint(-40, 40)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.stars(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = groups(pairs, {n for p in pairs for n in p})
    assert got == {n: r for n, r in want.items() if n != r}
    assert components.stars(spark.createDataFrame([], "a long, b long")).count() == 0


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two", "a b c", "A\x0bB\x0cc\rD\te  f", "É é x ß 字 " * 9, "x y z " * 5000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def linked(prints, block, spark):
    rows = [(int(np.uint64(p).astype(np.int64)),) for p in prints]
    edges = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame(rows, "fp long"), block).collect()]
    signed = {r[0] for r in rows}
    want = [(a, b) for a in signed for b in signed if a < b and ((a & (1 << 64) - 1) ^ (b & (1 << 64) - 1)).bit_count() <= 3]
    assert all(((a & (1 << 64) - 1) ^ (b & (1 << 64) - 1)).bit_count() <= 3 for a, b in edges)
    assert groups(edges, signed) == groups(want, signed)
    return edges


def test_links_equal_brute_force(spark):
    chance, prints = random.Random(6), set()
    for _ in range(40):
        centre = chance.getrandbits(64)
        for _ in range(6):
            moved = centre
            for bit in chance.sample(range(64), chance.randint(0, 5)):
                moved ^= 1 << bit
            prints.add(moved)
    linked(prints | {0, 1, (1 << 64) - 1, (1 << 64) - 9}, simhash.BLOCK, spark)


def test_crowded_cells_are_dealt_in_blocks(spark):
    chance, prints = random.Random(7), set()
    for _ in range(260):
        moved = 0x0123456789ABCDEF
        for bit in chance.sample(range(64), chance.randint(0, 3)):
            moved ^= 1 << bit
        prints.add(moved)
    edges = linked(prints, 30, spark)
    assert len(edges) < len(prints) ** 2 / 10  # forests, not all pairs


def test_documents(spark):
    chance = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(chance.choices(words, k=400)) for _ in range(12)]
    rows = [(n, t, "c") for n, t in enumerate(base)]
    rows += [(100 + n, t, "c") for n, t in enumerate(base[:3])]
    rows += [(200 + n, t.replace(" w1 ", " w2 ", 1), None) for n, t in enumerate(base[:6])]
    rows += [(300, None, "c"), (301, "", "c"), (302, " \n", None), (302, " \n", None), (None, base[0], "c"), (None, "only here without an id", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component string")
    prints = {t: slow_fingerprint(t) for _, t, _ in rows}
    want = groups([(a, b) for a in prints.values() for b in prints.values() if (a ^ b).bit_count() <= 3], set(prints.values()))
    least = {}
    for key, text, _ in rows:
        root = want[prints[text]]
        least[root] = min((x for x in (least.get(root), key) if x is not None), default=None)
    got = simhash.components(df).collect()
    assert len(got) == len(rows)
    assert sorted(((r["doc_id"], r["component"]) for r in got), key=str) == sorted(((k, least[want[prints[t]]]) for k, t, _ in rows), key=str)
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted(((k, t, c) for k, t, c in rows if k == least[want[prints[t]]]), key=str)
    assert simhash.components(df.limit(0)).count() == 0 and simhash.deduplicate(df.limit(0)).count() == 0
    assert simhash.digests(df.where("doc_id = 300")).first()["fingerprint"] == "0" * 16

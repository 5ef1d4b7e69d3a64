from __future__ import annotations

import hashlib

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from lodespan.llm import bpe, linededup, mixing, simhash, toxicity
from lodespan.session import cut

BASE = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    columns, labels = docs.columns, spark.read.parquet(f"{BASE}/labels.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash", "mixing", "bpe"]
    stages, state = dict(corpus_pipeline.STAGES), docs

    toxic = {r["doc_id"] for r in toxicity.digests(docs, labels).where("predicted = 1").collect()}
    state = cut(stages["toxicity"](spark, state, BASE))
    rows = {r["doc_id"]: r for r in state.collect()}
    assert state.columns == columns and set(rows) == {r["doc_id"] for r in docs.collect()} - toxic

    holders = {}
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    for n, r in rows.items():
        for line in r["text"].split("\n"):
            if len(key(line)) >= linededup.MIN_LENGTH:
                holders.setdefault(key(line), set()).add(n)
    often = {k: max(v) for k, v in holders.items() if len(v) >= linededup.MIN_DOCUMENTS}
    want = {n: "\n".join(x for x in r["text"].split("\n") if often.get(key(x), n) == n) for n, r in rows.items()}
    state = cut(stages["line_dedup"](spark, state, BASE))
    assert state.columns == columns and {r["doc_id"]: r["text"] for r in state.collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in state.collect())

    prints = {n: simhash.fingerprint(t) for n, t in want.items()}
    root = {n: n for n in prints}
    for _ in range(6):
        root = {n: min([root[n], *(root[m] for m in prints if (prints[n] ^ prints[m]).bit_count() <= 3)]) for n in prints}
    state = cut(stages["simhash"](spark, state, BASE))
    assert state.columns == columns and {r["doc_id"] for r in state.collect()} == set(root.values())

    uses = {r["key"]: r["n"] for r in mixing._taken(mixing.schedule(state), "pass").where("taken > 0 and 2 * taken >= size").groupBy("key").agg(mixing.F.count("*").alias("n")).collect()}
    state = cut(stages["mixing"](spark, state, BASE))
    copies = {r["doc_id"]: r["count"] for r in state.groupBy("doc_id").count().collect()}
    assert state.columns == columns and copies == uses and max(copies.values()) <= 2

    vocabulary = bpe.Vocabulary.read(P.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in state.collect()}
    got = stages["bpe"](spark, state, BASE).collect()
    assert len(got) == sum(copies.values())
    for r in got:
        assert r["ids"] == library.encode_ordinary(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()

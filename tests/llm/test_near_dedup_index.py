"""The pipeline's near-dedup stage gets its first links from the fingerprint index."""

import random

from chronopanel.llm import simhash


def test_stage_links_through_the_index(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(500)]
    base = [rng.choices(words, k=400) for _ in range(6)]
    rows = [(10 * k + e, " ".join([*b[:200], f"new{e}", *b[201:]] if e else b)) for k, b in enumerate(base) for e in range(4)]
    prints = {i: simhash.fingerprint(t.encode(), simhash.STAGE_SHINGLE) for i, t in rows}
    near = {(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.MAX_BITS}
    assert near and all(a // 10 == b // 10 for a, b in near)
    linked, plain = [], simhash.near_links

    def spy(found):
        out = plain(found)
        linked.extend((r.a, r.b) for r in out.collect())
        return out

    monkeypatch.setattr(simhash, "near_links", spy)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == [10 * k for k in range(6)]
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    assert {frozenset(x) for x in linked} == {frozenset((signed[a], signed[b])) for a, b in near if prints[a] != prints[b]}

"""SimHash groups, benchmark windows and packing against plain versions."""

import random

import numpy as np
import pytest
import xxhash

from chronopanel.llm import components, decontam, packing, simhash
from chronopanel.llm.common import words_of


def plain_print(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c not in " \t\n\v\f\r" else " " for c in text or "").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 4]) for k in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(rows):
    """component of each row: the smallest id reachable over links of 4 bits or fewer."""
    prints = [plain_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, f"{p:016x}", least.get(root(k))) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True))]


def by_text(rows):
    return sorted(rows, key=str)


def test_groups_equal_brute_force(spark, small_docs, edge_docs):
    for docs in (small_docs, edge_docs):
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        got = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()]
        assert by_text(got) == by_text(plain_groups(rows))


def test_links_equal_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(150)]
    prints = set(base)
    for p in base:
        for flips in range(1, 8):
            q = p
            for b in rng.sample(range(64), flips):
                q ^= 1 << b
            prints.add(q)
    prints = sorted(prints)
    want = {tuple(sorted((a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b))) for k, a in enumerate(prints) for b in prints[:k] if (a ^ b).bit_count() <= 4}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    got = [tuple(r) for r in simhash.near_links(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 300)] + [(1000, 1000), (2000, 2001)], "a long, b long")
    got = {r.node: r.root for r in components.star_components(links).collect()}
    assert got == {k: 0 for k in range(301)} | {2000: 2000, 2001: 2000}


def test_no_documents(spark, no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each_group(no_docs).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.decontaminate(no_docs, bench).count() == 0
    assert packing.pack(no_docs).count() == 0


def test_one_of_each_group(edge_docs):
    kept = simhash.one_of_each_group(edge_docs)
    assert kept.columns == edge_docs.columns
    got = sorted((r.doc_id or -1, len(r.text or "")) for r in kept.collect())
    groups = plain_groups([tuple(r) for r in edge_docs.select("doc_id", "text").collect()])
    assert [i for i, _ in got] == sorted({c for _, _, c in groups})


def test_stage_groups_equal_brute_force_similarity(spark):
    """Every pair at Jaccard 0.8 or more of five-word shingles is in one group, also far beyond four bits; no other pair links."""
    rng = random.Random(12)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 5, 9, 60, 200]))]
        for edits in (0, 1, 1, 2, 4, 6, 9):
            own = list(base)
            for _ in range(edits):
                own[rng.randrange(len(own))] = f"v{rng.randrange(5000)}"
            texts.append(" ".join(["the same passage stands at the head of every text here"] * (len(base) > 100) + own))
    dense = [f"d{k}" for k in range(300)]
    texts += [" ".join([*dense[:k], f"x{k}", *dense[k:]]) for k in range(40)]
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) or {tuple(t.split())} for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    far = 0
    for a in range(len(texts)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                far += (plain_print(texts[a]) ^ plain_print(texts[b])).bit_count() > 4
                parent[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted({root(k) for k in range(len(texts))})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert far > 20 and sorted(r.doc_id for r in simhash.one_of_each_group(docs).collect()) == want


def plain_hits(text, items, window=10):
    words = words_of((text or "").encode())
    hit, found = set(), set()
    for item, body in items:
        own = words_of((body or "").encode())
        size = min(window, len(own))
        for k in range(len(own) - size + 1) if size else ():
            for at in range(len(words) - size + 1):
                if words[at:at + size] == own[k:k + size]:
                    hit.update(range(at, at + size))
                    found.add(item)
    return len(words), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("slice_chars", [1 << 23, 300])
def test_windows_equal_brute_force(spark, slice_chars):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b", "C", "dé", "7"])
    items = [(k % 25, " ".join(word() for _ in range(rng.choice([0, 1, 2, 3, 5, 9, 10, 11, 14])))) for k in range(40)] + [(None, "a b C dé"), (99, None), (98, " ., ")]
    items = [i for i in items if len((i[1] or "").split()) != 1 and len((i[1] or "").split()) != 2]
    docs = [(k, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.randrange(80)))) for k in range(120)] + [(500, None), (501, ""), (None, items[0][1]), (502, items[5][1]), (502, items[5][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.decontaminate(frame, bench, slice_chars=slice_chars).collect()
    want = [(i, n, h, len(x), decontam.digest_of(x), h > 0) for i, t in docs for n, h, x in [plain_hits(t, items)]]
    assert by_text([tuple(r) for r in got]) == by_text(want)
    clean = [r.doc_id for r in decontam.reject_contaminated(frame, bench, slice_chars=slice_chars).collect()]
    assert sorted(map(str, clean)) == sorted(str(w[0]) for w in want if not w[5])


def test_windows_edge_rows(spark, edge_docs):
    bench = spark.createDataFrame([(1, "two three four"), (1, "two three four"), (2, "aaaa")], "item_id long, text string")
    rows = decontam.decontaminate(edge_docs, bench).collect()
    assert len(rows) == edge_docs.count() and sum(r.contaminated for r in rows) == 5
    none = decontam.decontaminate(edge_docs, bench.where("false")).collect()
    assert not any(r.contaminated for r in none)


def plain_best_fit(sizes, lengths):
    room, used, out = [], [], []
    for k, s in enumerate(sizes):
        fit = [b for b in range(len(room)) if room[b] >= s]
        if fit:
            least = min(room[b] for b in fit)
            b = [b for b in fit if room[b] == least]
        else:
            room.append(packing.opening_length(s, sum(sizes[k + 1:]), lengths))
            used.append(0)
            b = [len(room) - 1]
        out.append(b)
        pick = b[-1]
        room[pick] -= s
        used[pick] += s
    return room, used


def test_best_fit_equals_plain_version():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = np.sort(rng.integers(1, 65, rng.integers(1, 60)))[::-1]
        bins, offsets, caps = packing.best_fit(sizes, (16, 32, 64))
        used = np.bincount(bins, sizes)
        _, plain = plain_best_fit(sizes.tolist(), (16, 32, 64))
        assert sorted(used) == sorted(plain)
        for b in range(len(used)):
            at = np.flatnonzero(bins == b)
            order = at[np.argsort(offsets[at])]
            assert (offsets[order] == np.concatenate([[0], np.cumsum(sizes[order])[:-1]])).all()
            assert caps[at[0]] == min(c for c in (16, 32, 64) if c >= used[b])


def test_packing_covers_every_row(spark, edge_docs):
    docs = edge_docs.unionByName(edge_docs.where("doc_id = 4"))
    rows = packing.pack(docs, shard=10).collect()
    want = sorted(len((r.text or "").split()) + 1 for r in docs.select("text").collect())
    got, bins = {}, {}
    for r in rows:
        key = (r.doc_id, r.copy, None)
        bins.setdefault((r.shard, r.bin, r.capacity), []).append((r.bin_offset, r.n_tokens))
        got.setdefault((r.doc_id, r.copy), []).append((r.first_token, r.n_tokens))
    totals = sorted(n for pieces in got.values() for n in [sum(x for _, x in pieces)])
    assert sum(totals) == sum(want)
    for (_, _, capacity), inside in bins.items():
        at = 0
        for start, size in sorted(inside):
            assert start == at
            at += size
        assert at <= capacity and capacity == min(c for c in packing.LENGTHS if c >= at)
    assert {r.n_tokens for r in rows if r.doc_id == 1} == {1}

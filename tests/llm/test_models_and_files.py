"""Language scores, toxicity, token files and vector search against plain versions, and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from chronopanel.llm import ann, decontam, maxent, packing, pii, simhash, tokenfile, toxicity
from chronopanel.llm.queries import QUERIES


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def words(text):
    return (text or "").encode().lower().split()


def test_base_scores_equal_brute_force(spark, small_docs, edge_docs):
    docs = small_docs.limit(60).union(edge_docs.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    counts = Counter()
    for i, t in rows:
        if crc(i) % 10:
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in rows:
        tokens = [*words(t), None]
        want.append((str(i), crc(i) % 10 == 0, len(tokens), sum(counts[w] > 0 for w in tokens), sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.base_score) for r in maxent.language_scores(frame, rounds=2).collect())
    for a, b in zip(got, sorted(want), strict=True):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9)


def test_model_beats_the_base_on_held_out_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = maxent.language_scores(docs).collect()
    held = [r for r in rows if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}


def test_class_probabilities_add_up_and_equal_a_plain_walk():
    rng = np.random.default_rng(0)
    weights = rng.normal(0, 1, (maxent.BUCKETS, maxent.CLASSES)).astype(np.float32)
    scorer = maxent.Scorer([b"", b"the"], {}, weights, rng.normal(0, 1, maxent.CLASSES))
    rows = [np.array([1, 5, 9, 0]), np.array([0]), np.array([2, 2, 2, 2, 0])]
    got = scorer.class_part(rows)
    for row, value in zip(rows, got, strict=True):
        total, one, two = 0.0, maxent.START, maxent.START
        for c in row:
            logs = maxent.log_softmax(weights, np.array([one * (maxent.CLASSES + 1) + two]))[0]
            assert np.isclose(np.exp(logs).sum(), 1, atol=1e-5)
            total += logs[c] / np.log(10) - scorer.log_sums[c]
            one, two = c, one
        assert np.isclose(total, value, atol=1e-4)


def test_language_scores_without_rows(spark, no_docs):
    assert maxent.language_scores(no_docs).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(200) if crc(i) % 10 == 0], "doc_id long, text string")
    rows = maxent.language_scores(only_held).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in rows)


def test_pairs_count_for_more_than_their_parts():
    """An insult with a mention of a group is toxic, either alone is not: only the pair weights can tell."""
    rng = np.random.default_rng(1)
    texts, y = [], []
    for _ in range(1500):
        a, b = rng.random(2) < 0.5
        texts.append(" ".join(["fool"] * int(a) + ["locals"] * int(b) + [f"w{k}" for k in rng.integers(0, 40, 8)]).encode())
        y.append(int(a == b))
    model = toxicity.FactorizationMachine(epochs=40, rate=0.2)
    rows = [np.array(sorted(toxicity.terms(t))) for t in texts[:1200]]
    model.fit(rows, y[:1200], np.unique(np.concatenate(rows)))
    assert ((model.score(texts[1200:]) >= 0.5) == np.array(y[1200:], bool)).mean() > 0.9


def test_toxicity_on_held_out_rows(spark, edge_docs, no_docs):
    rng = np.random.default_rng(2)
    bad = ["idiot", "scum", "moron"]
    rows, labels = [], []
    for i in range(900):
        toxic = int(rng.random() < 0.2)
        body = [f"word{k}" for k in rng.integers(0, 300, 40)] + list(rng.choice(bad, 2)) * toxic
        rows.append((i, " ".join(rng.permutation(body))))
        if i % 3:
            labels.append((i, 1, toxic))
    labels += [(5000, 1, 1), (7, 1, None), (None, 0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: any(b in t.split() for b in bad) for i, t in rows}
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == 900 and all(r.held_out == (crc(r.doc_id) % 5 == 0) and r.predicted == int(r.score >= 0.5) for r in got)
    assert np.mean([r.predicted == truth[r.doc_id] for r in got if r.held_out]) > 0.97
    kept = toxicity.reject_toxic(docs, marks)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if not r.predicted}
    assert toxicity.toxicity(edge_docs, marks).count() == edge_docs.count()
    assert toxicity.toxicity(no_docs, marks).count() == 0
    assert {r.score for r in toxicity.toxicity(edge_docs, marks.where("false")).collect()} == {0.0}


def test_token_files_round_trip(spark, small_docs, edge_docs, no_docs, tmp_path):
    odd = [(700, "  a  b \n c\n\n d  "), (701, "don't  's <|endoftext|>  b!!! c,"), (702, "\t a\x1c b \x85 c 12.5%"), (703, "字 🙂 é́ ²,")]
    docs = small_docs.union(edge_docs.select("doc_id", "text")).union(spark.createDataFrame(odd, "doc_id long, text string"))
    path = str(tmp_path / "ids")
    rows = tokenfile.token_file(docs, path, partitions=5).orderBy("start").collect()
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((-1 if i is None else i, zlib.crc32(np.array([*coder.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t in docs.collect())
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in rows) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert ids == sorted(ids) and [r.start for r in rows] == list(np.concatenate([[0], np.cumsum([r.n_tokens for r in rows])[:-1]]))
    part = tokenfile.read_tokens(spark, path, 10, 20)
    assert sorted({r.doc_id for r in part.select("doc_id").collect()}) == list(range(10, 21))
    meta = tokenfile.token_metadata(spark, path)
    assert sorted(r.start for r in meta.collect()) == [r.start for r in rows]
    assert tokenfile.token_file(no_docs).count() == 0


def plain_nearest(ids, x, k):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(5)
    x = (rng.normal(0, 1, (12, 16))[rng.integers(0, 12, 3000)] + rng.normal(0, 0.6, (3000, 16))).astype(np.float32)
    x[100:700] = x[100]                                              # a very common vector
    frame = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    from pyspark.sql import functions as F
    rows = ann.nearest(frame, F.col("id") % 20 == 0, sample=1500, block=500).collect()
    want = plain_nearest(np.arange(3000), x.astype(float), 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id]) and math.isclose(r.score, float((x[r.vec_id].astype(float) * x[r.query_id].astype(float)).sum()), rel_tol=1e-12)
    assert all(len(v) == 20 for v in got.values()) and got.keys() == want.keys()
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert [i for i, _ in got[120]] == [k for k in range(100, 121) if k != 120]


def test_vectors_that_take_no_part(spark):
    from pyspark.sql import functions as F
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 1.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (1, [1.0, 1.0]), (9, [1.0, 1.0]), (40, [0.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(frame, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 20, 0.0), (20, 1, 1, 1.0), (20, 2, 9, 1.0), (20, 3, 0, 0.0)]
    assert ann.nearest(frame.where("false"), F.col("id") % 20 == 0).count() == 0


def test_walk_goes_down_in_summed_products():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=9), rng.normal(size=7)
    pairs = list(ann.walk(a, b))
    assert len(set(pairs)) == 63 and (np.diff([a[i] + b[j] for i, j in pairs]) <= 1e-12).all()


def test_query_blocks_are_bounded():
    rng = np.random.default_rng(4)
    counts = {c: int(n) for c, n in enumerate(rng.integers(0, 3 * ann.QUERIES, 40))} | {5: 0, 6: 3, 7: 2}
    first, spread = ann.query_blocks(counts, 64)
    load = Counter()
    for c, n in counts.items():
        for k in range(spread[c]):
            load[first[c] + k] += n / spread[c]
    assert max(load.values()) <= ann.QUERIES / 2 and sum(load.values()) == sum(counts.values())


def test_multi_index_recall_on_the_table(spark, sf_dir):
    rows = QUERIES["op10_inverted_multi_index"](spark, sf_dir).collect()
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").toPandas()
    want = plain_nearest(table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy()).astype(float), 20)
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(found[q] & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (name, function) in enumerate(corpus_pipeline.STAGES):
        function(spark, docs, sf_dir).write.parquet(path := str(folder / str(k)))
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def first_of_similar(rows, width=5, least=0.8):
    """Smallest id of every group linked by the exact Jaccard similarity of shingle sets, all pairs compared."""
    def shingles(text):
        w = words(text)
        return {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()

    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both >= least * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {i for i in sets if parent[i] == i}


def test_pipeline_stages_equal_plain_versions(spark, sf_dir, stages):
    (_, source, mild), (_, _, single), (_, _, clean), (_, _, masked), (_, _, packed) = stages
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scores = {r.doc_id: r.score for r in toxicity.toxicity(source, labels).collect()}
    assert {r.doc_id for r in mild.collect()} == {i for i, s in scores.items() if s < 0.5}
    assert {r.doc_id for r in single.collect()} == first_of_similar([(r.doc_id, r.text) for r in mild.collect()])
    marks = {r.doc_id: r.contaminated for r in decontam.decontaminate(single, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, c in marks.items() if not c}
    before = {r.doc_id: r for r in clean.collect()}
    field = pii.train(clean)
    for r in masked.collect():
        assert r.text == pii.masked(before[r.doc_id].text, pii.all_spans(before[r.doc_id].text, field)[1]) and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
    totals = Counter()
    for r in packed.collect():
        totals[r.doc_id] += r.n_tokens
    assert totals == {r.doc_id: len(words(r.text)) + 1 for r in masked.collect()}
    for _, _, frame in stages[:-1]:
        assert frame.columns == source.columns
    assert len(packed.where(packed.capacity > max(packing.LENGTHS)).take(1)) == 0


def test_pipeline_on_odd_rows(spark, sf_dir, edge_docs, no_docs):
    for docs in (no_docs, edge_docs):
        for k, (_, function) in enumerate(corpus_pipeline.STAGES):
            out = function(spark, docs, sf_dir)
            assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
            assert (out.count() > 0) == (docs is edge_docs)


def test_registered_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))

"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its hashed words and word beginnings. The score is the logistic of bias + sum of weights + sum over
pairs of <v_i, v_j>, so a pair of terms (an insult next to a mention of a group) can count for more than its parts do.
The machine is fitted on at most ``max_rows`` labelled rows, those of the smallest id hash among the rows allowed for
training, and on the ``max_terms`` hashed terms that tell the labels apart best; all rows are scored over whole texts.
Word scores of a class are never taken from label, language, source or id.

Defined cases: a null text is empty and scores as the bias; labels that are null or whose ids name no document are left
out; a document labelled more than once takes the majority (toxic on a tie); without any labelled row, or with a single class,
the score is the share of toxic labels (0 without rows); repeated documents are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import column, doc_crc, filter_batches, map_batches, texts, words_of
from chronopanel.session import stage

BUCKETS, PREFIX, MAX_ROWS, MAX_TERMS, RANK, MAX_SEEN, LEAST_CHI, LEAST_ROWS = 1 << 20, 5, 20_000, 4_096, 8, 300_000, 15.0, 5


def word_terms(word: bytes) -> tuple[int, int]:
    return zlib.crc32(word) & (BUCKETS - 1), zlib.crc32(word[:PREFIX], 1) & (BUCKETS - 1)


def terms(text: bytes) -> set[int]:
    """Hashed words and word beginnings of a text."""
    return {t for w in set(words_of(text)) for t in word_terms(w)}


class FactorizationMachine:
    """Second-order machine on presence features, fitted by AdaGrad steps over shuffled mini-batches."""

    def __init__(self, rank: int = RANK, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7):
        self.rank, self.epochs, self.rate, self.decay, self.seed = rank, epochs, rate, decay, seed
        self.place: dict[int, int] = {}
        self.seen: dict[bytes, tuple[int, ...]] = {}
        self.bias, self.w, self.v = 0.0, np.zeros(1), np.zeros((1, rank))

    def fit(self, rows: list[np.ndarray], labels, chosen) -> FactorizationMachine:
        """Fits on the terms in ``chosen``; ``rows`` holds the terms of each text."""
        y = np.asarray(labels, float)
        share = y.mean() if len(y) else 0.0
        if not 0 < share < 1:
            self.constant = share
            return self
        self.constant = None
        rng = np.random.default_rng(self.seed)
        self.place = {int(t): k for k, t in enumerate(chosen)}
        kept = [np.array(sorted(self.place[t] for t in map(int, r) if t in self.place), np.int64) for r in rows]
        self.bias, self.w, self.v = float(np.log(share / (1 - share))), np.zeros(len(chosen)), rng.normal(0, 0.01, (len(chosen), self.rank))
        gw, gv, gb = np.full(self.w.shape, 1e-2), np.full(self.v.shape, 1e-2), 1e-2
        for _ in range(self.epochs):
            order = rng.permutation(len(kept))
            for start in range(0, len(order), 256):
                batch = order[start:start + 256]
                size = np.array([len(kept[k]) for k in batch])
                flat, of = np.concatenate([kept[k] for k in batch]), np.repeat(np.arange(len(batch)), size)
                score, sums = self._raw(flat, of, len(batch))
                g = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y[batch]) / len(batch) * 16
                dw = np.bincount(flat, g[of], len(self.w)) + self.decay * self.w
                dv = self.decay * self.v
                for r in range(self.rank):
                    dv[:, r] += np.bincount(flat, g[of] * (sums[of, r] - self.v[flat, r]), len(self.w))
                gw += dw ** 2
                gv += dv ** 2
                gb += g.sum() ** 2
                self.w -= self.rate * dw / np.sqrt(gw)
                self.v -= self.rate * dv / np.sqrt(gv)
                self.bias -= self.rate * g.sum() / np.sqrt(gb)
        return self

    def _raw(self, flat: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        sums = np.stack([np.bincount(of, self.v[flat, r], n) for r in range(self.rank)], axis=1)
        squares = np.bincount(of, (self.v[flat] ** 2).sum(1), n)
        return self.bias + np.bincount(of, self.w[flat], n) + 0.5 * ((sums ** 2).sum(1) - squares), sums

    def score(self, rows: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text; a word's known terms are looked up once and remembered in a bounded table."""
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        kept, seen, place = [], self.seen, self.place
        for text in rows:
            own: set[int] = set()
            for w in set(words_of(text)):
                hit = seen.get(w)
                if hit is None:
                    hit = seen[w] = tuple(place[t] for t in word_terms(w) if t in place)
                if hit:
                    own.update(hit)
            kept.append(sorted(own))
            if len(seen) > MAX_SEEN:
                seen.clear()
        flat, of = np.array([t for r in kept for t in r], np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in kept])
        return 1 / (1 + np.exp(-np.clip(self._raw(flat, of, len(rows))[0], -30, 30)))


def train(docs: DataFrame, labels: DataFrame, may_train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
          max_rows: int = MAX_ROWS, max_terms: int = MAX_TERMS) -> FactorizationMachine:
    """Machine fitted on at most ``max_rows`` labelled documents for which ``may_train`` (a column of the id) holds.

    Spark counts the terms of those documents by label and picks the ``max_terms`` of the largest chi-square (``LEAST_CHI``
    and ``LEAST_ROWS`` documents at least; ties to the smaller hash); only these come to the driver.
    """
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & may_train).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    drawn = marked.orderBy(F.xxhash64(id_col), id_col).limit(max_rows)            # the bound that allows the broadcast

    def build():
        def step(batch):
            return {"id": column(batch, "id"), "y": column(batch, "y"), "ids": pa.array([sorted(terms(t)) for t in texts(batch)], pa.list_(pa.int32()))}
        return step

    found = map_batches(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn.select(F.col(id_col).alias("id"), "y")), "id"), build, "id long, y int, ids array<int>")
    rows = stage(found.groupBy("id").agg(F.min(F.struct("y", "ids")).alias("r")).select("id", "r.*"), "toxicity-sample")     # a repeated document trains once
    total, share = rows.agg(F.count("*"), F.coalesce(F.avg("y"), F.lit(0.0))).first()
    if not 0 < share < 1:
        return FactorizationMachine().fit([], [share], [])
    counts = rows.select("y", F.explode("ids").alias("t")).groupBy("t").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    expected = F.col("n") * share
    chi = (F.col("pos") - expected) ** 2 / (expected * (1 - share) * F.greatest(1 - F.col("n") / total, F.lit(1e-9)) + 1e-9)
    best = counts.withColumn("chi", chi).where((F.col("n") >= LEAST_ROWS) & (F.col("chi") >= LEAST_CHI)).orderBy(F.desc("chi"), "t").limit(max_terms)
    chosen = np.sort(np.array([r["t"] for r in best.collect()], np.int64))

    def keep():
        def step(batch):
            return {"id": column(batch, "id"), "y": column(batch, "y"), "ids": pa.array([x[np.isin(x, chosen)] for x in (np.array(r, np.int64) for r in column(batch, "ids").to_pylist())], pa.list_(pa.int32()))}
        return step

    sample = map_batches(rows, keep, "id long, y int, ids array<int>").orderBy("id").toArrow()
    lists = sample.column("ids")
    return FactorizationMachine().fit([lists[k].values.to_numpy() for k in range(len(lists))], sample.column("y").to_numpy(), chosen)


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Id and ``score`` for every document."""
    def build():
        def step(batch):
            return {id_col: column(batch, id_col), "score": model.score(texts(batch, text_col))}
        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text_col), build, f"{id_col} long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: held_out, score, predicted; rows whose crc32(id) is a multiple of ``held_out_of`` lend no labels."""
    fold = doc_crc(id_col) % held_out_of
    model = train(docs, labels, fold != 0, id_col, **options)
    scored = score(docs, model, id_col)
    return scored.select(id_col, (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, held_out_of: int = 5, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """The rows that score under ``threshold``, with their columns."""
    model = train(docs, labels, doc_crc(id_col) % held_out_of != 0, id_col, text_col, **options)
    return filter_batches(docs, lambda: lambda batch: model.score(texts(batch, text_col)) < threshold)

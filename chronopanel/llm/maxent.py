"""Text scores from a hashed maximum-entropy model with a class-factored softmax, and from a smoothed unigram model.

Tokens are lower-cased words and one end per text. Every token belongs to a class: the end, one of the ``OWN`` most
frequent words, or a class hashed from how a word ends. The model is P(token | history) = P(class | history) *
P(token | class). The first factor is a softmax over classes whose weights belong to hashed features of the classes before: the
n-grams (one and two back) and the skip-gram (two back only). The second is (count + 0.1) over its class's sum, where each
class keeps one place for all words unknown to training, so the probabilities of a history add up to one.

Training covers all training rows. Tasks count (history, class) and send sums, so the table of counts follows the number of histories and not
that of tokens; then each round sends the weights to the partitions of that table, adds up their gradients and takes a
step. Counts of words come from one aggregation. For scoring, words whose count is at least ``HEAVY`` of all tokens (no more than
1/HEAVY words can be) go to every task; the other (document, word) pairs are joined to the counts by word.

Defined cases: a null text is empty and has the end only; a null id counts as the empty text for the split; repeated rows
are counted and scored each; without training rows every word is unknown (base score 0); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import column, doc_crc, map_batches, texts
from chronopanel.session import stage

OWN, ENDINGS, BUCKETS, HEAVY, SMOOTH, ROUNDS, PARTS, ROWS = 63, 64, 1 << 13, 2e-6, 0.1, 20, 4, 500
CLASSES = 1 + OWN + ENDINGS
START = CLASSES                                     # class of the places before a text
FLUSH = 400_000
MARKS = b".,;:!?|\"'()[]{}*#$%&-_/\\+=<>~^`@"


class Classes(dict):
    """Class of a word; words without an own class are hashed by their ending and remembered in a bounded table."""

    def __init__(self, own: list[bytes]):
        super().__init__()
        self.own = {w: k for k, w in enumerate(own)}
        self.update(self.own)

    def __missing__(self, word: bytes) -> int:
        if len(self) > FLUSH:
            self.clear()
            self.update(self.own)
        bare = word.rstrip(MARKS)
        ending = bare[-3:] + (b"." if len(bare) < len(word) else b"")
        found = self[word] = 1 + OWN + zlib.crc32(ending) % ENDINGS
        return found


def histories(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(history code, class) of every token; each array holds the classes of one text."""
    padded = np.concatenate([np.concatenate([[START, START], c]) for c in classes]).astype(np.int64)
    size = np.array([len(c) for c in classes])
    at = np.arange(size.sum()) + np.repeat(2 * np.arange(1, len(size) + 1), size)
    return padded[at - 1] * (CLASSES + 1) + padded[at - 2], padded[at]


def feature_ids(history: np.ndarray) -> np.ndarray:
    """Hashed features of each history: bias, one back, two back together, skip of one."""
    one, two = history // (CLASSES + 1), history % (CLASSES + 1)
    mix = np.array([0, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], np.uint64)
    keys = np.stack([np.zeros_like(one), one + 1, (one + 1) * 1021 + two + 1, two + 1], axis=1).astype(np.uint64)
    x = (keys + np.uint64(1)) * mix[None, :] + np.arange(4, dtype=np.uint64) * np.uint64(0x27D4EB2F)
    x ^= x >> np.uint64(15)
    ids = (x * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(40)
    ids = (ids % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    ids[:, 0] = 0                                   # the bias has a bucket of its own
    return ids


def log_softmax(weights: np.ndarray, history: np.ndarray) -> np.ndarray:
    logits = weights[feature_ids(history)].sum(axis=1)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def class_counts(docs: DataFrame, own: list[bytes], text_col: str) -> DataFrame:
    """``(history, class, n)`` over all tokens; each task sends sums."""
    def run(batches):
        classes, kept, size = Classes(own), [], 0

        def sums():
            codes, n = np.unique(np.concatenate(kept), return_counts=True)
            codes = codes.astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(codes // CLASSES), pa.array(codes % CLASSES), pa.array(n)], names=["history", "class", "n"])

        for part in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            h, c = histories([np.array([*map(classes.__getitem__, t.lower().split()), 0], np.int64) for t in texts(part, text_col)])
            kept.append((h * CLASSES + c).astype(np.int32))
            size += len(c)
            if size > 1 << 22:
                yield sums()
                kept, size = [], 0
        if kept:
            yield sums()

    return docs.select(text_col).mapInArrow(run, "history long, class long, n long").groupBy("history", "class").agg(F.sum("n").alias("n"))


def fit_weights(counts: DataFrame, rounds: int = ROUNDS, rate: float = 0.4, prior_weight: float = 2.0, parts: int = PARTS) -> np.ndarray:
    """Softmax weights by gradient steps; every round adds up one gradient from each of ``parts`` partitions."""
    table = stage(counts.repartition(parts, "history").sortWithinPartitions("history"), "history-counts")
    prior = np.full(CLASSES, SMOOTH)
    for row in table.groupBy("class").agg(F.sum("n").alias("n")).collect():      # one row per class
        prior[row["class"]] += row["n"]
    total = prior.sum()
    weights = np.zeros((BUCKETS, CLASSES), np.float32)
    weights[0] = np.log(prior / total)
    if total < 1:
        return weights
    anchor, square = weights.copy(), np.full(weights.shape, 1e-10, np.float32)         # the prior pulls weights to the plain class shares
    context = counts.sparkSession.sparkContext
    for _ in range(rounds):
        sent = context.broadcast(weights)               # of fixed size; gone from all disks after the round

        def partial(batches, sent=sent):
            weights = sent.value
            grad, like = np.zeros(weights.shape), 0.0
            for batch in batches:
                h, inverse = np.unique(column(batch, "history").to_numpy(), return_inverse=True)
                n = np.zeros((len(h), CLASSES))
                np.add.at(n, (inverse, column(batch, "class").to_numpy()), column(batch, "n").to_numpy())
                logs = log_softmax(weights, h)
                like += float((n * logs).sum())
                push = n - n.sum(axis=1, keepdims=True) * np.exp(logs)
                for f in feature_ids(h).T:
                    np.add.at(grad, f, push)
            top = np.maximum(np.abs(grad).max(axis=1, keepdims=True), 1e-30)         # half precision against each bucket's largest
            yield pa.RecordBatch.from_arrays([pa.array([(grad / top).astype(np.float16).tobytes()]), pa.array([top.astype(np.float32).tobytes()]), pa.array([like])], names=["grad", "top", "like"])

        grad = np.zeros(weights.shape, np.float32)
        for row in table.coalesce(parts).mapInArrow(partial, "grad binary, top binary, like double").collect():         # one row of fixed size per partition
            grad += np.frombuffer(row["grad"], np.float16).reshape(weights.shape) * np.frombuffer(row["top"], np.float32)[:, None]
        sent.destroy()
        grad = grad / np.float32(total) - np.float32(prior_weight / total) * (weights - anchor)
        square += grad * grad
        weights = weights + np.float32(rate) * grad / np.sqrt(square)
    return weights


class Scorer:
    """Per-text sums with the words known to every task, and the rest of the words to be joined."""

    def __init__(self, own: list[bytes], heavy: dict[bytes, float], weights: np.ndarray, log_sums: np.ndarray):
        self.classes, self.heavy, self.weights, self.log_sums = Classes(own), heavy, weights, log_sums

    def class_part(self, rows: list[np.ndarray]) -> np.ndarray:
        """Sum over tokens of log10 P(class | history) - log10 of the class sum, for each text."""
        h, c = histories(rows)
        distinct, inverse = np.unique(h, return_inverse=True)
        value = np.empty(len(c))
        for start in range(0, len(distinct), 4096):                     # weights of the histories at hand only
            logs = log_softmax(self.weights, distinct[start:start + 4096]) / np.log(10) - self.log_sums
            here = (inverse >= start) & (inverse < start + 4096)
            value[here] = logs[inverse[here] - start, c[here]]
        size = np.array([len(r) for r in rows])
        return np.add.reduceat(value, np.concatenate([[0], np.cumsum(size)[:-1]]))


def language_scores(docs: DataFrame, held_out_of: int = 10, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, train_on: Column | None = None) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities)."""
    spark = docs.sparkSession
    fold = doc_crc(id_col) % held_out_of
    training = docs.where(fold != 0 if train_on is None else train_on)

    def count_words(batches):
        seen: Counter = Counter()
        for batch in batches:
            for t in texts(batch, text_col):
                seen.update(t.lower().split())
            seen[b""] += batch.num_rows                                 # the end
            if len(seen) > FLUSH:
                yield _counts(seen)
                seen = Counter()
        if seen:
            yield _counts(seen)

    counts = stage(training.select(text_col).mapInArrow(count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    n_all, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    heavy_rows = counts.where(F.col("n") >= max(1, HEAVY * n_all)).orderBy(F.desc("n"), "word").collect()       # at most 1/HEAVY words
    own = [b"", *[bytes(r["word"]) for r in heavy_rows if r["word"]][:OWN]]
    heavy = {bytes(r["word"]): float(np.log10(r["n"] + SMOOTH)) for r in heavy_rows}
    del heavy_rows
    light = counts.where(F.col("n") < max(1, HEAVY * n_all))

    def sum_classes(batches):
        classes, sums = Classes(own), np.zeros(CLASSES)
        for batch in batches:
            k = np.array([classes[w] for w in column(batch, "word").to_pylist()], np.int64)
            sums += np.bincount(k, column(batch, "n").to_numpy() + SMOOTH, CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(sums)], names=["class", "s"])

    class_sums = np.full(CLASSES, SMOOTH)                               # the place of the unknown words
    for row in counts.mapInArrow(sum_classes, "class int, s double").groupBy("class").agg(F.sum("s").alias("s")).collect():
        class_sums[row["class"]] += row["s"]
    weights = fit_weights(class_counts(training, own, text_col), rounds)

    def build():
        scorer, part = Scorer(own, heavy, weights, np.log10(class_sums)), [0]

        def step(batch):
            rows, sums, known, sizes, words, times, at = [], [], [], [], [], [], [0]
            classes, get, end = scorer.classes, scorer.heavy.get, scorer.heavy.get(b"")
            for t in texts(batch, text_col):
                w = t.lower().split()
                rows.append(np.array([*map(classes.__getitem__, w), 0], np.int64))
                s, k = (float(np.log10(SMOOTH)), 0) if end is None else (end, 1)
                for word, n in Counter(w).items():
                    log = get(word)
                    if log is None:
                        words.append(word)
                        times.append(n)
                    else:
                        s += n * log
                        k += n
                sums.append(s)
                known.append(k)
                sizes.append(len(w) + 1)
                at.append(len(words))
            rest = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(times, pa.int32())], names=["word", "n"]))
            part[0] += len(rows)
            return {id_col: column(batch, id_col), "held_out": column(batch, "held_out"), "place": np.arange(part[0] - len(rows), part[0]), "task": column(batch, "task"),
                    "n_tokens": pa.array(sizes, pa.int64()), "known": pa.array(known, pa.int64()), "logs": sums, "classes": scorer.class_part(rows), "rest": rest}
        return step

    source = docs.select(F.col(id_col).cast("long").alias(id_col), text_col, (fold == 0).alias("held_out"), F.spark_partition_id().alias("task"))
    scored = stage(map_batches(source, build, f"{id_col} long, held_out boolean, place long, task int, n_tokens long, known long, logs double, classes double, rest array<struct<word:binary,n:int>>", ROWS), "scored")
    pairs = scored.select("task", "place", F.explode("rest").alias("r")).select("task", "place", "r.word", F.col("r.n").alias("times"))
    rest = (pairs.join(light, "word", "left").groupBy("task", "place")
            .agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("also")))
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    space = float(np.log10(n_all + SMOOTH * (n_types + 1)))
    return scored.drop("rest").join(rest, ["task", "place"], "left").select(
        id_col, "held_out", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n_all)).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(space)).alias("base_score"), (logs + F.col("classes")).alias("score"))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

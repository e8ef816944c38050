"""Ranked lexical search by Block-Max MaxScore over shards of an inverted index.

A shard is a run of documents of one task, at most ``SHARD_DOCS`` of them and about ``SHARD_POSTINGS`` postings. Its documents
are numbered by ascending id. A posting list is cut into blocks of ``BLOCK`` postings, each packed as gaps and frequencies of
one, two or four bytes. Beside a block stand its last document and the pairs (frequency, length) that no other pair of
the block beats on both sides: with them the block's highest score follows exactly once the corpus statistics are
known, without unpacking the block, so one pass over the texts is enough.

A query walks windows of ``WINDOW`` documents. The lists' global bounds, summed from the weakest, tell which lists alone cannot
lift a document over the ``k``-th score so far: these are non-essential and yield no candidates. Candidates of the
essential lists meet the non-essential ones from the strongest on; the maximum of the block that a candidate falls into
rejects it before the block is unpacked. Every shard returns its heap, a window over the heaps keeps the best.

The index holds the terms of the queries only. Queries are measured and taken in slices of about ``SLICE_CHARS`` characters,
one pass over the documents a slice, so what a task holds is bounded for any number of queries.

Defined cases: a null text has no terms; documents without a term count in nothing; rows of one item id are one item, whose
terms are those of all its rows; items without a term return nothing; a null id is an id; repeated documents each rank.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.llm.common import column, texts, words_of
from chronopanel.session import stage

BLOCK, WINDOW, SHARD_DOCS, SHARD_POSTINGS, SLICE_CHARS, TOP = 128, 4_096, 1 << 16, 1 << 20, 1 << 20, 50
WIDTHS = (np.dtype("<u1"), np.dtype("<u2"), np.dtype("<u4"))
INDEX = ("shard long, term string, df long, n_docs long, n_terms long, payload binary, last array<int>, place array<int>, edge array<int>, "
         "tf array<int>, length array<long>")
NO_ID = -1 << 63


def pack(docs: np.ndarray, tf: np.ndarray) -> bytes:
    """One block: two width codes, gaps (the first from -1), frequencies."""
    gaps = np.diff(docs, prepend=-1)
    codes = [next(c for c, w in enumerate(WIDTHS) if x.max() < 1 << 8 * w.itemsize) for x in (gaps, tf)]
    return bytes(codes) + gaps.astype(WIDTHS[codes[0]]).tobytes() + tf.astype(WIDTHS[codes[1]]).tobytes()


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b = WIDTHS[block[0]], WIDTHS[block[1]]
    n = (len(block) - 2) // (a.itemsize + b.itemsize)
    return (np.cumsum(np.frombuffer(block, a, n, 2), dtype=np.int64) - 1), np.frombuffer(block, b, n, 2 + n * a.itemsize).astype(np.int64)


def frontier(tf: np.ndarray, length: np.ndarray, block_of: np.ndarray, at: np.ndarray, n_blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every block the pairs (frequency, length) with no pair of at least that frequency and a smaller length: (tf, length, offsets)."""
    grid = np.full((n_blocks, BLOCK), np.iinfo(np.int64).max)
    grid[block_of, at] = ((1 << 31) - tf) << 32 | np.minimum(length, (1 << 32) - 1)        # sorted: frequency falls, length rises
    grid.sort(axis=1)
    size = grid & 0xFFFFFFFF
    best = np.minimum.accumulate(size, axis=1)
    keep = np.ones(grid.shape, bool)
    keep[:, 1:] = size[:, 1:] < best[:, :-1]
    keep &= grid < np.iinfo(np.int64).max
    edges = np.concatenate([[0], np.cumsum(keep.sum(axis=1))])
    return (1 << 31) - (grid[keep] >> 32), size[keep], edges


class ShardBuilder:
    """Gathers postings of one shard and turns them into index rows."""

    def __init__(self, vocabulary: list[str]):
        self.names, self.number = vocabulary, {t.encode(): k for k, t in enumerate(vocabulary)}
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths, self.terms, self.counts, self.sizes = [], [], [], [], []
        self.n_docs = self.n_terms = 0

    def add(self, doc_id, text: bytes) -> None:
        words = words_of(text)
        if not words:
            return
        self.n_docs, self.n_terms = self.n_docs + 1, self.n_terms + len(words)
        get = self.number.get
        found = Counter(k for k in map(get, words) if k is not None)
        if found:
            self.ids.append(NO_ID if doc_id is None else doc_id)
            self.lengths.append(len(words))
            self.terms.extend(found.keys())
            self.counts.extend(found.values())
            self.sizes.append(len(found))

    @property
    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS

    def rows(self, shard: int) -> pa.RecordBatch:
        ids, lengths = np.array(self.ids, np.int64), np.array(self.lengths, np.int64)
        by_id = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), np.int64)
        rank[by_id] = np.arange(len(ids))
        ids, lengths = ids[by_id], lengths[by_id]
        doc = np.repeat(rank, self.sizes) if len(ids) else np.zeros(0, np.int64)
        term, tf = np.array(self.terms, np.int64), np.array(self.counts, np.int64)
        order = np.lexsort((doc, term))
        doc, term, tf = doc[order], term[order], tf[order]
        first = np.flatnonzero(np.diff(term, prepend=-1))                                  # first posting of every term
        df = np.diff(np.append(first, len(term)))
        inside = np.arange(len(term)) - np.repeat(first, df)
        starts = np.flatnonzero(inside % BLOCK == 0)                                       # first posting of every block
        block_of = np.cumsum(inside % BLOCK == 0) - 1
        best_tf, best_length, edges = frontier(tf, lengths[doc], block_of, inside % BLOCK, len(starts))
        ends = np.append(starts[1:], len(term))
        packed = [pack(doc[a:b], tf[a:b]) for a, b in zip(starts, ends)]
        blocks = np.append(np.searchsorted(starts, first), len(starts))                    # first block of every term
        place, edge, payload = [[]], [[]], [ids.tobytes() + lengths.tobytes()]
        for a, b in zip(blocks[:-1], blocks[1:]):
            payload.append(b"".join(packed[a:b]))
            place.append(np.cumsum([0] + [len(x) for x in packed[a:b]]).tolist())
            edge.append((edges[a:b + 1] - edges[a]).tolist())
        lists = lambda values, offsets, kind: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], offsets]), pa.int32()), pa.array(values, kind))
        zeros = np.zeros(len(first), np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(len(first) + 1, shard), pa.int64()), pa.array([""] + [self.names[t] for t in term[first]], pa.string()), pa.array(np.append(0, df), pa.int64()),
            pa.array(np.append(self.n_docs, zeros), pa.int64()), pa.array(np.append(self.n_terms, zeros), pa.int64()), pa.array(payload, pa.binary()),
            lists(doc[ends - 1] if len(ends) and len(doc) else np.zeros(0, np.int64), blocks, pa.int32()), pa.array(place, pa.list_(pa.int32())), pa.array(edge, pa.list_(pa.int32())),
            lists(best_tf, edges[blocks], pa.int32()), lists(best_length, edges[blocks], pa.int64())], names=[f.split()[0] for f in INDEX.split(", ")])


def build_index(docs: DataFrame, vocabulary: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index rows: per shard one row without a term (ids, lengths and totals) and one row per term of ``vocabulary`` that occurs."""
    def run(batches):
        shard, builder = TaskContext.get().partitionId() << 32, ShardBuilder(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 1_000):
                part = batch.slice(start, 1_000)
                for doc_id, text in zip(column(part, id_col).to_pylist(), texts(part, text_col)):
                    builder.add(doc_id, text)
                    if builder.full:
                        yield builder.rows(shard)
                        builder.clear()
                        shard += 1
        if builder.n_docs:
            yield builder.rows(shard)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, INDEX)


class Postings:
    """One list of a shard: block bounds at once, blocks unpacked when asked for."""

    def __init__(self, row: dict, impact):
        self.payload, self.impact = row["payload"], impact
        self.last, self.place = np.array(row["last"], np.int64), row["place"]
        bounds = impact(np.array(row["tf"], np.int64), np.array(row["length"], np.int64))
        self.bounds = np.maximum.reduceat(bounds, np.array(row["edge"][:-1], np.int64))
        self.top = int(self.bounds.max())
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def block(self, b: int, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if b not in self.blocks:
            docs, tf = unpack(self.payload[self.place[b]:self.place[b + 1]])
            self.blocks[b] = docs, self.impact(tf, lengths[docs])
        return self.blocks[b]

    def read(self, blocks, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [self.block(int(b), lengths) for b in blocks]
        if len(found) == 1:
            return found[0]
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Shard:
    def __init__(self, rows: list[dict], n_docs: int, n_terms: int):
        def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
            m = 100 - 50 + (50 * length * n_docs) // n_terms
            return (1_000_000_000 * tf) // (1_000 * tf + 20 * m)

        head = next(r for r in rows if r["term"] == "")
        self.ids, self.lengths = np.frombuffer(head["payload"], np.int64).reshape(2, -1)
        self.lists = {r["term"]: Postings(r, impact) for r in rows if r["term"] != ""}

    def search(self, weights: dict[str, int], k: int = TOP) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best documents, best first, ties to the smaller id."""
        lists = sorted(((w * self.lists[t].top, w, t) for t, w in weights.items() if w > 0 and t in self.lists))
        best, score, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 0          # least: a document must score more
        bound = np.cumsum([x[0] for x in lists])                                      # of the lists up to here
        lists = [(w, self.lists[t]) for _, w, t in lists]
        for left in range(0, len(self.ids), WINDOW):
            essential = int(np.searchsorted(bound, least, "right"))
            if essential == len(lists):
                break
            right = min(left + WINDOW, len(self.ids))
            spans = [(int(np.searchsorted(p.last, left)), min(int(np.searchsorted(p.last, right - 1)) + 1, len(p.last))) for _, p in lists]
            if sum(w * int(p.bounds[a:b].max()) for (w, p), (a, b) in zip(lists, spans) if a < b) <= least:
                continue                                                              # block maxima reject the window
            sums = np.zeros(right - left, np.int64)
            for (w, p), (a, b) in zip(lists[essential:], spans[essential:]):
                if a < b:
                    docs, gain = p.read(range(a, b), self.lengths)
                    x, y = np.searchsorted(docs, left), np.searchsorted(docs, right)
                    sums[docs[x:y] - left] += w * gain[x:y]
            found = np.flatnonzero(sums)
            gained, found = sums[found], found + left
            for j in range(essential - 1, -1, -1):
                w, p = lists[j]
                below = int(bound[j - 1]) if j else 0
                at = np.searchsorted(p.last, found)
                here = np.append(p.bounds, 0)[at]
                keep = gained + w * here + below > least
                found, gained, at = found[keep], gained[keep], at[keep]
                asked = np.unique(at[at < len(p.last)])
                if len(asked):
                    docs, gain = p.read(asked, self.lengths)
                    spot = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    gained = gained + np.where(docs[spot] == found, w * gain[spot], 0)
            keep = gained > least
            best, score = np.concatenate([best, found[keep]]), np.concatenate([score, gained[keep]])
            order = np.lexsort((best, -score))[:k]
            best, score = best[order], score[order]
            if len(score) == k:
                least = int(score[-1])
        return self.ids[best], score


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _slice(docs: DataFrame, items: dict, k: int, id_col: str, text_col: str) -> DataFrame:
    vocabulary = sorted(set().union(*items.values()))
    index = stage(build_index(docs, vocabulary, id_col, text_col), "lexical-index")
    total = index.where("term = ''").agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("l")).first()
    n_docs, n_terms = total["n"] or 0, total["l"] or 0
    df = {r["term"]: r["df"] for r in index.where("term <> ''").groupBy("term").agg(F.sum("df").alias("df")).collect()}      # terms of this slice of queries
    weights = [(item, {t: weight(n_docs, df[t]) for t in terms if t in df}) for item, terms in items.items()]

    def run(table: pa.Table) -> pa.Table:
        shard = Shard(table.to_pylist(), n_docs, n_terms)
        out = [(item, *shard.search(w, k)) for item, w in weights]
        sizes = [len(x[1]) for x in out]
        ids = np.concatenate([x[1] for x in out])
        return pa.table({"item_id": pa.array([x[0] for x, n in zip(out, sizes) for _ in range(n)], pa.int64()), "doc_id": pa.array(ids, pa.int64(), mask=ids == NO_ID),
                         "score": pa.array(np.concatenate([x[2] for x in out]), pa.int64())})

    return index.groupBy("shard").applyInArrow(run, "item_id long, doc_id long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           slice_chars: int = SLICE_CHARS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of every item."""
    asked = queries.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("asked"))
    size = asked.agg(F.coalesce(F.sum(F.length("asked") + 16), F.lit(0))).first()[0]
    slices = max(1, math.ceil(size / slice_chars))
    found = []
    for s in range(slices):
        items: dict = {}
        for row in asked.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == s).toLocalIterator():
            items.setdefault(row["item"], set()).update(w.decode() for w in words_of((row["asked"] or "").encode()))
        items = {i: t for i, t in items.items() if t}
        if items:
            found.append(_slice(docs, items, k, id_col, text_col))
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    place = F.row_number().over(W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return reduce(DataFrame.union, found).withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


ORACLE = r"""
WITH word_lists AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
docs AS (SELECT id AS doc_id, w, CAST(len(w) AS BIGINT) AS n FROM word_lists WHERE kind = 0 AND len(w) > 0),
total AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
asked AS (SELECT DISTINCT id AS item_id, unnest(w) AS term FROM word_lists WHERE kind = 1),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
df AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY term),
scored AS (
  SELECT a.item_id, t.doc_id, CAST(sum(d.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * (100 - 50 + ((50 * t.n * nn) // ll))))) AS BIGINT) AS score
  FROM asked a JOIN tf t ON t.term = a.term JOIN df d ON d.term = a.term, total GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""

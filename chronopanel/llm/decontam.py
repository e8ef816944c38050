"""Benchmark passages found in documents by Wu-Manber multi-pattern search over words.

The alphabet is the word: a pattern is a window of ``WINDOW`` consecutive item words (or a whole shorter item). Patterns
of one length share a shift table over blocks of ``BLOCK`` words: a block that no pattern holds moves the search by the
largest step, one that patterns hold moves it to its nearest place before a pattern's end. At step zero the block selects
the patterns that end in it (the suffix bucket), and comparing the words confirms an occurrence.

The benchmark is measured before it is used: it is searched in slices of about ``SLICE_CHARS`` characters, one scan of
the documents per slice, with the hits so far carried along. So memory in a task is bounded for any benchmark.

Defined cases: a null text has no words; a null or word-free item has no window; a null item id counts for hits but not
as an item; repeated items and repeated documents each keep their rows; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import column, filter_batches, map_batches, texts, words_of
from chronopanel.session import stage

WINDOW, BLOCK, SLICE_CHARS = 10, 3, 1 << 23


class ShiftTables:
    """Search tables of one slice of the benchmark."""

    def __init__(self, items: list[tuple[int | None, bytes]], window: int = WINDOW, block: int = BLOCK):
        patterns: dict[int, dict[tuple[bytes, ...], set]] = {}
        for item_id, text in items:
            words = words_of(text)
            size = min(window, len(words))
            for k in range(len(words) - size + 1) if size else ():
                patterns.setdefault(size, {}).setdefault(tuple(words[k:k + size]), set()).add(item_id)
        self.classes = []
        for size, found in sorted(patterns.items()):
            width = min(block, size)
            shift: dict[tuple[bytes, ...], int] = {}
            bucket: dict[tuple[bytes, ...], list] = {}
            for words, ids in found.items():
                for end in range(width, size + 1):
                    key = words[end - width:end]
                    shift[key] = min(size - end, shift.get(key, size))
                bucket.setdefault(words[-width:], []).append((list(words), frozenset(ids)))
            self.classes.append((size, width, size - width + 1, shift, bucket))

    def search(self, words: list[bytes], hit: set[int], items: set) -> None:
        """Adds the positions inside any occurrence to ``hit`` and the item ids to ``items``."""
        n = len(words)
        for size, width, far, shift, bucket in self.classes:
            get, end = shift.get, size
            if width == 3:
                a = words
                while end <= n:
                    step = get((a[end - 3], a[end - 2], a[end - 1]), far)
                    if step:
                        end += step
                        continue
                    end += self._confirm(words, end, size, bucket[(a[end - 3], a[end - 2], a[end - 1])], hit, items)
            else:
                while end <= n:
                    step = get(key := tuple(words[end - width:end]), far)
                    end += step or self._confirm(words, end, size, bucket[key], hit, items)

    @staticmethod
    def _confirm(words, end, size, candidates, hit, items) -> int:
        here = words[end - size:end]
        for pattern, ids in candidates:
            if pattern == here:
                hit.update(range(end - size, end))
                items.update(ids)
        return 1


def _scan(frame: DataFrame, tables: ShiftTables, id_col: str, text_col: str, first: bool, last: bool) -> DataFrame:
    def build():
        def step(batch):
            n_words, hits, found = [], [], []
            before = (None, None) if first else (column(batch, "hits").to_pylist(), column(batch, "items").to_pylist())
            for k, text in enumerate(texts(batch, text_col)):
                words = words_of(text)
                hit, items = (set(), set()) if first else (set(before[0][k]), set(before[1][k]))
                tables.search(words, hit, items)
                n_words.append(len(words))
                hits.append(sorted(hit))
                found.append(sorted(x for x in items if x is not None))
            out = {id_col: column(batch, id_col), "n_words": pa.array(n_words, pa.int64()), "hits": pa.array(hits, pa.list_(pa.int32())), "items": pa.array(found, pa.list_(pa.int64()))}
            return out if last else out | {text_col: column(batch, text_col)}
        return step

    return map_batches(frame, build, f"{id_col} long, n_words long, hits array<int>, items array<long>" + ("" if last else f", {text_col} string"))


def benchmark_slices(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slice_chars: int = SLICE_CHARS) -> Iterator[tuple[bool, ShiftTables]]:
    """(last, tables) of each slice of the benchmark, of about ``slice_chars`` characters."""
    size = benchmark.agg(F.coalesce(F.sum(F.length(item_text_col) + 16), F.lit(0))).first()[0]
    slices = max(1, math.ceil(size / slice_chars))
    part = F.pmod(F.xxhash64(F.col(item_col), F.col(item_text_col)), F.lit(slices))
    for k in range(slices):
        rows = benchmark.where(part == k).select(F.col(item_col).cast("long"), item_text_col).collect()
        yield k + 1 == slices, ShiftTables([(r[0], (r[1] or "").encode()) for r in rows], window)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Per document: id, n_words, hits (positions of words inside an occurrence), items (ids of items that occur).

    No shuffle: documents are scanned where they lie, once for each slice of the benchmark.
    """
    frame = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    for k, (last, tables) in enumerate(benchmark_slices(benchmark, **options)):
        frame = _scan(frame, tables, id_col, text_col, k == 0, last)
        if not last:
            frame = stage(frame, "benchmark-slice")
    return frame


def reject_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows without any occurrence of a benchmark window, with their columns."""
    for last, tables in benchmark_slices(benchmark, **options):
        def build(tables=tables):
            def clean(text: bytes) -> bool:
                tables.search(words_of(text), hit := set(), set())
                return not hit
            return lambda batch: [clean(t) for t in texts(batch, text_col)]
        docs = filter_batches(docs, build)
        if not last:
            docs = stage(docs, "benchmark-slice")
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Digest per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, id_col, **options)
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select(id_col, "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(names, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def digest_of(items: set) -> str:
    """Plain form of ``items_sha256``, for checks."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


ORACLE = r"""
WITH word_lists AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
patterns AS (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, greatest(len(w) - 10, 0) + 2), lambda i: array_to_string(w[i:i + 9], ' '))) AS gram
  FROM word_lists WHERE kind = 1 AND len(w) > 0),
sizes AS (SELECT DISTINCT size FROM patterns),
places AS (
  SELECT id AS doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, w FROM word_lists, sizes WHERE kind = 0 AND len(w) >= size),
grams AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram FROM places),
found AS (SELECT g.doc_id, g.size, g.i, p.item_id FROM grams g JOIN patterns p ON g.size = p.size AND g.gram = p.gram),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM found) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM word_lists d LEFT JOIN hit h ON h.doc_id = d.id LEFT JOIN items t ON t.doc_id = d.id WHERE d.kind = 0
"""

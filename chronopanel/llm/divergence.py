"""Source divergence audit: which words set a source of a language apart, and how far sources are from each other.

Words are counted by sorting pointers. In every task the texts of an Arrow batch are one buffer; a pointer stands at each word
start, in order of (lang, source) group and document. Pointers are sorted by a multikey quicksort whose key is eight bytes
of the word at a time: runs that are still equal are sorted by their next eight bytes, from ``DEEP`` bytes on by the rest
of the word. The sort is stable, so a run of equal words lies group by group and document by document, and its edges
give occurrences and document frequency without a hash table. Slices hold about ``SLICE_BYTES`` of text, or one document.

Spark sums the runs by (lang, source, term), then by (lang, term); terms of at least ``LEAST_DOCS`` documents of a language are
kept. With p = 1 + floor(1e9 (count + 1) / (N + V)) and f(p, q) = floor((p - q)^2 / q), the sum over all V kept terms of a
pair of sources splits into exact parts that need no dense table: V f(p0, q0), with p0 and q0 the values of a count of zero;
a correction for each source's own counts, of which a source has few different ones; and one for terms that both sources hold.
The last is summed in NumPy: sources of a language lie in tiles of ``TILE``, a task holds at most ``HELD`` tile pairs and
emits their sums when it needs room.

Defined cases: null text, lang and source read as ''; a group without terms, and a language without kept terms, give pairs
(value 0 where nothing is kept) and no term rows; repeated documents count each time; a source alone in its language has no pairs;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.llm.common import column
from chronopanel.session import stage

LEAST_DOCS, TERMS, SLICE_BYTES, DEEP, TILE, HELD, SLOTS = 3, 200, 1 << 23, 64, 512, 64, 16
SCALE = 1_000_000_000
#: Lower-case letters and non-ASCII bytes stay, A-Z become lower case, the rest is zero.
LETTERS = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)
#: Masks of the first 0 to 8 bytes of a key.
HEADS = np.array([((1 << 64) - 1) ^ ((1 << 64 - 8 * n) - 1) for n in range(9)], np.uint64)


def pointers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes (eight zero bytes behind them), word starts, word lengths, and the document of every word."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    folded = np.zeros(len(raw) + 8, np.uint8)
    folded[:len(raw)] = LETTERS[raw]
    inside = folded[:len(raw) + 1] != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True                                              # words of neighbouring documents do not join
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:]
    end = inside[:-1] & (~inside[1:] | edge[1:])
    kind = np.int32 if len(folded) < 1 << 31 else np.int64
    starts = np.flatnonzero(start).astype(kind)
    return folded, starts, np.flatnonzero(end).astype(kind) + kind(1) - starts, (np.searchsorted(offsets, starts, "right") - 1).astype(np.int32)


def _keys(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, depth: int) -> np.ndarray:
    """Bytes ``depth`` to ``depth + 8`` of every word as one number that sorts like them."""
    windows = np.ndarray((len(folded) - 7,), ">u8", folded.data, strides=(1,))
    keys = windows[np.minimum(starts + depth, len(windows) - 1)].astype(np.uint64)
    keys &= HEADS[np.clip(lengths - depth, 0, 8)]
    return keys


def sort_words(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray, deep: int = DEEP) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the words by their bytes, and the flags of places where a new word begins."""
    keys = _keys(folded, starts, lengths, 0)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    depth = 8
    while True:
        run = np.cumsum(new, dtype=np.int32) - 1
        longer = np.zeros(run[-1] + 1 if len(run) else 0, bool)
        longer[run[lengths[order] > depth]] = True
        longer &= np.bincount(run, minlength=len(longer)) > 1
        places = np.flatnonzero(longer[run]) if len(run) else run
        if not len(places):
            return order, new
        words, group = order[places], run[places]
        if depth < deep:
            keys = _keys(folded, starts[words], lengths[words], depth)
        else:                                                         # few words are this long
            tails = [folded[s + depth:s + max(n, depth)].tobytes() for s, n in zip(starts[words], lengths[words])]
            number = {t: k for k, t in enumerate(sorted(set(tails)))}
            keys = np.array([number[t] for t in tails], np.uint64)
        sub = np.lexsort((keys, group))
        order[places], keys = words[sub], keys[sub]
        new[places[1:]] |= keys[1:] != keys[:-1]                      # runs keep their places, so group edges stay
        if depth >= deep:
            return order, new
        depth += 8


def _strings(folded: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    data = folded[np.repeat((starts - offsets[:-1]).astype(starts.dtype), lengths) + np.arange(offsets[-1], dtype=starts.dtype)]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())).cast(pa.string())


def count_runs(texts: pa.Array, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of every run of equal words of one group; ``groups`` numbers the documents' groups."""
    folded, starts, lengths, doc = pointers(texts)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, pa.array([], pa.string()), none, none
    by_group = np.argsort(groups[doc], kind="stable")
    starts, lengths, doc = starts[by_group], lengths[by_group], doc[by_group]
    order, new = sort_words(folded, starts, lengths)
    doc = doc[order]
    group = groups[doc]
    new[1:] |= group[1:] != group[:-1]
    first = np.flatnonzero(new)
    other = new.copy()
    other[1:] |= doc[1:] != doc[:-1]
    return group[first], _strings(folded, starts[order[first]], lengths[order[first]]), np.diff(np.append(first, len(new))), np.add.reduceat(other.astype(np.int64), first)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(column(batch, "bytes").to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``(lang, source, term, count, df)``: occurrences of a term in a group and the group's documents that hold it."""
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                pairs = pa.StructArray.from_arrays([column(part, "lang"), column(part, "source")], ["lang", "source"]).to_pylist()
                number: dict = {}
                codes = np.array([number.setdefault((p["lang"], p["source"]), len(number)) for p in pairs], np.int32)
                group, term, count, df = count_runs(column(part, "text"), codes)
                names = list(number)
                yield pa.RecordBatch.from_arrays([pa.array([n[0] for n in names], pa.string()).take(pa.array(group)), pa.array([n[1] for n in names], pa.string()).take(pa.array(group)),
                                                  term, pa.array(count, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "count", "df"])

    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source"), read(text_col).alias("text")).withColumn("bytes", F.octet_length("text").cast("long"))
    return rows.mapInArrow(run, "lang string, source string, term string, count long, df long").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("df").alias("df"))


def share(count, total, terms):
    """p of a count as a column."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("long") * (count + 1), total + terms)


def gap(p, q):
    """f(p, q) as a column."""
    return F.call_function("div", (p - q) * (p - q), q)


def shared_gaps(lists: DataFrame) -> DataFrame:
    """``(lang, a, b, part)``: partial sums over terms that both sources hold, of what holding it together changes.

    ``lists``: lang and ``held``, for one term the array of (sid, p, p0) of the sources that hold it.
    """
    f = lambda p, q: (p - q) * (p - q) // q

    def run(batches):
        sums: dict = {}

        def emit():
            for (lang, ta, tb), grid in sums.items():
                cell = np.flatnonzero(grid)
                a, b = cell // TILE, cell % TILE
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a + ta * TILE, pa.int64()), pa.array(b + tb * TILE, pa.int64()),
                                                  pa.array(grid[cell], pa.int64())], names=["lang", "a", "b", "part"])

        for batch in batches:
            held, lang = column(batch, "held"), np.array(column(batch, "lang").to_pylist(), object)
            size = np.diff(held.offsets.to_numpy()[:len(held) + 1])
            flat = held.flatten()
            sid, p, p0 = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("sid", "p", "p0"))
            first = np.concatenate([[0], np.cumsum(size)])[:-1]
            one_tile = bool(len(sid)) and int(sid.max()) < TILE
            for name in dict.fromkeys(lang):
                for n in np.unique(size[lang == name]):
                    rows = first[(lang == name) & (size == n)]
                    step = max(1, (1 << 18) // int(n))
                    for at in range(0, len(rows), step):                 # terms of one length side by side, against one of their sources at a time
                        spots = rows[at:at + step, None] + np.arange(n)
                        for x in range(n):
                            i = spots[:, x:x + 1]
                            change = f(p[i], p[spots]) - f(p[i], p0[spots]) - f(p0[i], p[spots]) + f(p0[i], p0[spots])
                            tiles = ((sid[i] // TILE) << 32) + sid[spots] // TILE
                            cell = (sid[i] % TILE) * TILE + sid[spots] % TILE
                            for k in [0] if one_tile else np.unique(tiles).tolist():
                                mark = (name, k >> 32, k & 0xFFFFFFFF)
                                if mark not in sums and len(sums) >= HELD:
                                    yield from emit()
                                    sums.clear()
                                grid = sums.setdefault(mark, np.zeros(TILE * TILE, np.int64))
                                here = slice(None) if one_tile else tiles == k
                                np.add.at(grid, cell[here].ravel(), change[here].ravel())
        yield from emit()

    return lists.mapInArrow(run, "lang string, a long, b long, part long").groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = LEAST_DOCS, terms: int = TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: distances of source pairs and the most over-used terms of each source."""
    counted = term_counts(docs, lang_col, source_col, text_col)
    kept = stage(counted.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("df").alias("df"), F.collect_list(F.struct("source", "count")).alias("held"))
                 .where(F.col("df") >= least_docs).drop("df"), "kept-terms")
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    occurring = docs.select(read(lang_col).alias("lang"), read(source_col).alias("source")).distinct()
    numbered = kept.withColumn("tid", F.monotonically_increasing_id())          # only joins rows of one reading of the table
    each = numbered.select("lang", "term", "tid", "total", F.explode("held").alias("h")).select("lang", "term", "tid", "total", "h.source", "h.count")
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    of_group = each.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = (occurring.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0, ["v", "lang_n", "n"])
              .withColumn("sid", (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long"))
              .withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v"))).otherwise(1)))
    groups = stage(groups, "groups")
    valued = stage(each.join(groups, ["lang", "source"]).withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
                   .withColumn("q", share(F.col("total"), F.col("lang_n"), F.col("v"))).select("lang", "source", "sid", "term", "tid", "p", "p0", "q"), "term-values")

    over = valued.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    top = over.withColumn("rank", place).where(F.col("rank") <= terms)

    slot = F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot")
    other = groups.select("lang", F.col("sid").alias("other"), F.col("p0").alias("other_p0"), slot)
    levels = valued.groupBy("lang", "sid", "p", "p0").agg(F.count("*").alias("k")).withColumn("slot", F.pmod(F.xxhash64("sid", "p"), F.lit(SLOTS)).cast("int"))
    met = levels.join(other, ["lang", "slot"]).where("sid <> other")
    base = gap(F.col("p0"), F.col("other_p0"))
    mine = met.groupBy("lang", F.col("sid").alias("a"), F.col("other").alias("b")).agg(F.sum(F.col("k") * (gap(F.col("p"), F.col("other_p0")) - base)).alias("part"))
    back = gap(F.col("other_p0"), F.col("p0"))
    theirs = met.groupBy("lang", F.col("other").alias("a"), F.col("sid").alias("b")).agg(F.sum(F.col("k") * (gap(F.col("other_p0"), F.col("p")) - back)).alias("part"))
    lists = valued.groupBy("tid").agg(F.any_value("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("sid", "p", "p0"))).alias("held")).where(F.size("held") > 1).select("lang", "held")
    one, two = groups.select("lang", "v", F.col("sid").alias("a"), "source", F.col("p0").alias("pa")), groups.select("lang", F.col("sid").alias("b"), F.col("source").alias("item"), F.col("p0").alias("pb"))
    pairs = one.join(two, "lang").where("a <> b")                          # the rows asked for: every other source of the language
    parts = mine.union(theirs).union(shared_gaps(lists).where("a <> b")).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"))
    value = F.when(F.col("v") > 0, F.col("v") * gap(F.col("pa"), F.col("pb")) + F.coalesce("part", F.lit(0))).otherwise(0).cast("long")
    far = pairs.join(parts, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value"))
    far = far.withColumn("rank", place)
    return far.union(top).withColumn("rank", F.col("rank").cast("int"))


ORACLE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS c FROM words GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
counts AS (SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
sizes AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(c) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n,
    (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM groups g),
dense AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000::BIGINT * (coalesce(c.c, 0) + 1)) // CAST(s.n + s.v AS BIGINT) AS p
  FROM sizes s JOIN kept k ON k.lang = s.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
lang_n AS (SELECT lang, sum(c) AS n, count(*) AS v FROM kept GROUP BY 1),
lang_p AS (SELECT k.lang, k.term, 1 + (1000000000::BIGINT * (k.c + 1)) // CAST(l.n + l.v AS BIGINT) AS q FROM kept k JOIN lang_n l USING (lang)),
pair_values AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(v.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair_values v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source),
terms AS (
  SELECT d.lang, d.source, 'term' AS part, d.term AS item, CAST(((d.p - q.q) * (d.p - q.q)) // q.q AS BIGINT) AS value
  FROM dense d JOIN lang_p q ON q.lang = d.lang AND q.term = d.term WHERE d.c > 0 AND d.p > q.q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

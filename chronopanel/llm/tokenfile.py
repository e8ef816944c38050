"""Token-id files: Parquet list columns in ascending document order, with encodings and page sizes under control.

A file row is ``(doc_id, chunk, local_start, n_tokens, ids)``. Ids are dictionary- or delta-packed (format v2 writers),
row groups and pages are bounded in bytes, and Parquet's page indexes over ``doc_id`` let a reader fetch a range of documents,
or only the metadata columns, without the ids of the rest. Documents are range-partitioned by id and sorted, so the part files in name order
hold them in ascending order; a chunk is one part. The start of a document among all ids is its start within its chunk
plus the ids of the chunks before, a running sum over one row per chunk.

Text is cut before every space that a non-space follows. The vocabulary's splitter always splits there, so the parts encode
alone as they do in place; each task remembers parts that it has encoded in a table of bounded size.

Defined cases: a null text is empty and has the end id only; a null doc_id comes first; rows of one id are ordered by a hash of their
text and each kept; an empty table gives an empty file set and result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from itertools import repeat

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from chronopanel.llm.common import column, map_batches
from chronopanel.session import scratch_path

VOCABULARY, END_ID, MAX_PARTS, SLICE_ROWS = "byte_bpe_50k.json", 2, 1_000_000, 1_500
NO_CUT = re.compile(r" (?=\s|\Z)")
MARKS = ",.;:!?|*$%&#)"
#: Byte-level vocabularies write visible Latin-1 bytes as themselves and the others, in order, from U+0100 on.
_VISIBLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
SPACE = chr(BYTE_CHARS[32])
#: Writer settings: bounded row groups and pages, dictionary pages with delta packing where a dictionary does not pay.
LAYOUT = {"parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.dictionary.page.size": str(256 << 10),
          "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#local_start": "false", "parquet.writer.version": "PARQUET_2_0", "compression": "zstd"}


class PartEncoder:
    """Token ids of whole texts through the ``tokenizers`` library, remembering the parts between cuts.

    A known part is a number; the ids of all of them lie in one growing pool, with a start and a size per number. Parts that follow
    a space are known without it, apart from those that begin a text. At ``MAX_PARTS`` those that no second slice has met are
    forgotten, and the others have to be met again.
    """

    def __init__(self, vocabulary: str = VOCABULARY):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.direct = self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel)
        self.spaced: dict[str, int] = {}
        self.first: dict[str, int] = {}
        self.pool, self.starts, self.sizes = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.hits = np.zeros(1 << 14, np.int64)
        self.used = self.count = 0

    def forget(self) -> None:
        """Keeps the parts that two slices have met; if they are over half of ``MAX_PARTS``, none."""
        keep = np.flatnonzero(self.hits[:self.count] > 1)
        keep = keep if len(keep) <= MAX_PARTS // 2 else keep[:0]
        place = np.full(self.count, -1, np.int64)
        place[keep] = np.arange(len(keep))
        sizes = self.sizes[keep]
        shift = self.starts[keep] - (np.cumsum(sizes) - sizes)
        pool = self.pool[np.repeat(shift, sizes) + np.arange(sizes.sum())]
        self.spaced, self.first = ({p: int(place[k]) for p, k in known.items() if place[k] >= 0} for known in (self.spaced, self.first))
        self.pool, self.starts, self.sizes, self.hits = pool, np.cumsum(sizes) - sizes, sizes, np.zeros(len(keep), np.int64)
        self.used, self.count = len(pool), len(keep)

    @staticmethod
    def parts(text: str) -> list[str]:
        """Pieces that join to ``text``, which must spell no special token, and encode alone as they do in place."""
        pieces = text.split(" ")
        if NO_CUT.search(text):
            joined, pieces = pieces, pieces[:1]
            for piece in joined[1:]:
                if piece and not piece[0].isspace():
                    pieces.append(" " + piece)
                else:
                    pieces[-1] += " " + piece
        else:
            pieces[1:] = [" " + p for p in pieces[1:]]
        return [x for p in pieces for x in PartEncoder.marks_apart(p)]

    def encode(self, texts: list[str], end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(sizes, ids): the number of ids of each text with its end id, and all ids one after another.

        Parts are found and numbered by Arrow, so Python looks each distinct part of a slice up once. Texts that spell a special
        token, or hold a space that is no cut, are cut one by one.
        """
        if len(self.spaced) + len(self.first) > MAX_PARTS:
            self.forget()
        plain = [not (any(s in t for s in self.special) or NO_CUT.search(t)) for t in texts]
        split = pc.split_pattern(pa.array([t if ok else "" for t, ok in zip(texts, plain, strict=True)], pa.large_string()), " ")
        numbered = split.flatten().dictionary_encode()
        at = split.offsets.to_numpy()
        numbers = self._numbers(self.spaced, numbered.dictionary.to_pylist(), " ")[numbered.indices.to_numpy()]
        numbers[at[:-1]] = self._numbers(self.first, [t.split(" ", 1)[0] if ok else "" for t, ok in zip(texts, plain, strict=True)], "")
        odd = {k: self._odd(texts[k]) for k, ok in enumerate(plain) if not ok}
        kept = self.used, self.count
        numbers[at[[*odd]]] = self._add([*odd.values()])                # odd texts come whole, in the place of their first part
        order = np.insert(numbers, at[1:], self._add([struct.pack("<I", end_id)])[0])
        n = self.sizes[order]
        shift = self.starts[order] - (np.cumsum(n) - n)
        ids = self.pool[np.repeat(shift, n) + np.arange(n.sum())]
        self.used, self.count = kept
        return np.add.reduceat(n, at[:-1] + np.arange(len(texts))), ids

    def _add(self, coded: list[bytes]) -> np.ndarray:
        """Numbers of new entries of the pool."""
        ids, sizes = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        room = lambda x, n: x if n <= len(x) else np.concatenate([x, np.zeros(max(len(x), n - len(x)), x.dtype)])
        used, count = self.used + len(ids), self.count + len(coded)
        self.pool, self.starts, self.sizes, self.hits = room(self.pool, used), room(self.starts, count), room(self.sizes, count), room(self.hits, count)
        self.hits[self.count:count] = 0
        self.pool[self.used:used], self.sizes[self.count:count] = ids, sizes
        self.starts[self.count:count] = self.used + np.cumsum(sizes) - sizes
        out = np.arange(self.count, count)
        self.used, self.count = used, count
        return out

    def _numbers(self, known: dict[str, int], names: list[str], space: str) -> np.ndarray:
        """Numbers of parts, each ``space`` and a name; new ones are encoded."""
        out = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = list(dict.fromkeys(names[k] for k in missing))
            known.update(zip(new, self._add(self._learn([space + n for n in new])).tolist(), strict=True))
            out[missing] = [known[names[k]] for k in missing]
        self.hits[np.unique(out) if space == "" else out] += 1
        return out

    def _odd(self, text: str) -> bytes:
        """Ids of a text with special tokens, or with spaces that are no cuts."""
        if any(s in text for s in self.special):
            return self._plain([text])[0]
        return b"".join(self._learn(self.parts(text)))

    @staticmethod
    def marks_apart(part: str) -> tuple[str, ...]:
        """A part and its last marks: after a letter or digit they are a token group of their own."""
        if part and not part[-1].isalnum():
            bare = part.rstrip(MARKS)
            if bare and len(bare) < len(part) and bare[-1].isalnum():
                return bare, part[len(bare):]
        return (part,)

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(c.ids)}I", *c.ids) for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> list[bytes]:
        """Ids of parts; a word of letters goes straight to the merge model, marks after it are encoded once."""
        pieces = [self.marks_apart(p) for p in new]
        coded, others, merge = {}, [], self.tokenizer.model.tokenize
        for p in {x for group in pieces for x in group}:
            known = self.spaced.get(p[1:]) if p[:1] == " " else self.first.get(p)
            if known is not None:
                coded[p] = self.pool[self.starts[known]:self.starts[known] + self.sizes[known]].tobytes()
            elif self.direct and (p[1:] if p[:1] == " " else p).isalpha():
                chars = p.replace(" ", SPACE) if p.isascii() else p.encode().decode("latin-1").translate(BYTE_CHARS)
                ids = [t.id for t in merge(chars)]
                coded[p] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                others.append(p)
        for start in range(0, len(others), 4096):
            part = others[start:start + 4096]
            coded.update(zip(part, self._plain(part), strict=True))
        return [coded[g[0]] if len(g) == 1 else coded[g[0]] + coded[g[1]] for g in pieces]


@functools.cache
def encoder(vocabulary: str) -> PartEncoder:
    """One encoder for a worker process, so that tasks go on with what earlier ones have met."""
    return PartEncoder(vocabulary)


def write_tokens(docs: DataFrame, path: str, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> None:
    """Encodes every text and writes the file set in ascending document order."""
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text", F.spark_partition_id().alias("chunk"))

    def build():
        coder, done = encoder(vocabulary), [0]

        def step(batch):
            sizes, ids = coder.encode(column(batch, "text").to_pylist(), end_id)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            starts = done[0] + ends
            done[0] = int(starts[-1])
            ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.view("<i4")))
            return {"doc_id": column(batch, "doc_id"), "chunk": column(batch, "chunk"), "local_start": starts[:-1], "n_tokens": sizes, "ids": ids}
        return step

    map_batches(ordered, build, "doc_id long, chunk int, local_start long, n_tokens long, ids array<int>", rows=SLICE_ROWS).write.options(**LAYOUT).parquet(path)


def chunk_starts(rows: DataFrame) -> DataFrame:
    """``(chunk, before)``: the ids of all chunks before it, from one row per part file."""
    ends = rows.groupBy("chunk").agg(F.sum("n_tokens").alias("size"))
    return ends.select("chunk", F.coalesce(F.sum("size").over(W.orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))


def token_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, chunk, local_start, n_tokens, start)`` without reading any ids."""
    rows = spark.read.parquet(path).select("doc_id", "chunk", "local_start", "n_tokens")
    return rows.join(chunk_starts(rows), "chunk").select("*", (F.col("before") + F.col("local_start")).alias("start")).drop("before")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``(doc_id, ids)`` of the documents with first <= doc_id <= last; row groups and pages outside are skipped."""
    rows = spark.read.parquet(path).select("doc_id", "chunk", "local_start", "n_tokens", "ids")
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    return rows if last is None else rows.where(F.col("doc_id") <= last)


def _list_bytes(lists: pa.ListArray) -> list[bytes]:
    """Little-endian bytes of every list of an int32 list column."""
    at = lists.offsets.to_numpy()
    raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))).cast("B")
    return [raw[4 * a:4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def build():
        def step(batch):
            found = _list_bytes(column(batch, "ids"))
            return {"doc_id": column(batch, "doc_id"), "chunk": column(batch, "chunk"), "local_start": column(batch, "local_start"),
                    "n_tokens": pa.array([len(x) // 4 for x in found], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x) for x in found], pa.int64())}
        return step

    read = map_batches(read_tokens(spark, path), build, "doc_id long, chunk int, local_start long, n_tokens long, ids_crc32 long")
    return read.join(chunk_starts(spark.read.parquet(path)), "chunk").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def token_file(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Writes the token files of ``docs`` and returns the digest read back from them."""
    path = path or scratch_path(docs.sparkSession, "token-ids")
    write_tokens(docs, path, **options)
    return token_digests(docs.sparkSession, path)

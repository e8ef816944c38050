"""Best-fit packing of documents into training sequences of several permitted lengths.

Only lengths are shuffled. A document of ``n`` tokens (its words and one end) gives pieces of at most the largest
permitted length; pieces are dealt by hash to shards of about ``SHARD`` pieces, so the number of shards follows the data
and no shard holds more than a task can pack. In a shard, pieces go in falling order of length. Each goes to the open bin that
it leaves least room in; if none fits, a new bin opens at the permitted length whose cost per token packed is least, counting
what the shard's shorter pieces can still add. At the end each bin shrinks to the smallest permitted length that holds
its contents.

Defined cases: null and empty texts have one token (the end); repeated rows are packed once per row and numbered by
``copy``; a null id is packed like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import WORD
from chronopanel.session import stage

LENGTHS, SHARD, OVERHEAD, STRETCH = (256, 512, 1024, 2048, 4096), 20_000, 16, 32_768


def cost(length: int) -> float:
    """Cost of one sequence: its tokens, a fixed part, and a part that grows with the square (attention)."""
    return length + OVERHEAD + length * length / STRETCH


def opening_length(size: int, still_to_come: int, lengths=LENGTHS) -> int:
    """Permitted length of least cost per packed token, if shorter pieces fill what they can; ties to the shorter."""
    return min((c for c in lengths if c >= size), key=lambda c: (cost(c) / (size + min(c - size, still_to_come)), c))


def best_fit(sizes: np.ndarray, lengths=LENGTHS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin number, offset and final length of the bin for each piece; ``sizes`` must fall and fit the largest length."""
    lengths = sorted(lengths)
    total, packed = int(sizes.sum()), 0
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    used: list[int] = []
    size_of: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]
    rooms = 0                                        # bit r is set if a bin with room r is open
    for k, size in enumerate(sizes.tolist()):
        packed += size
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            at = len(used)
            used.append(0)
            size_of.append(opening_length(size, total - packed, lengths))
        bins[k], offsets[k] = at, used[at]
        used[at] += size
        left = size_of[at] - used[at]
        if left:
            by_room[left].append(at)
            rooms |= 1 << left
    final = np.array([lengths[int(np.searchsorted(lengths, u))] for u in used], np.int64)
    return bins, offsets, final[bins] if len(used) else bins


def pieces_of(docs: DataFrame, largest: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, copy, piece, first_token, n_tokens)`` for every piece of every document."""
    n = (F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)) + 1).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), n.alias("total")).groupBy(id_col, "total").agg(F.count("*").alias("copies"))
    rows = rows.select(id_col, "total", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    rows = rows.select(id_col, "total", "copy", F.explode(F.sequence(F.lit(0), F.ceil(F.col("total") / largest).cast("long") - 1)).alias("piece"))
    return rows.select(id_col, "copy", "piece", (F.col("piece") * largest).alias("first_token"),
                       F.least(F.lit(largest).cast("long"), F.col("total") - F.col("piece") * largest).alias("n_tokens"))


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per piece: id, copy, piece, first_token, n_tokens, shard, bin (within the shard), bin_offset, capacity."""
    pieces = stage(pieces_of(docs, max(lengths), id_col, text_col), "pieces")
    shards = max(1, math.ceil(pieces.count() / shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(id_col, "copy", "piece"), F.lit(shards)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((rows["piece"], rows["copy"], rows[id_col].fillna(-1), -rows["n_tokens"]))
        rows = rows.iloc[order].reset_index(drop=True)
        rows["bin"], rows["bin_offset"], rows["capacity"] = best_fit(rows["n_tokens"].to_numpy(), lengths)
        return rows

    return dealt.groupBy("shard").applyInPandas(run, f"{id_col} long, copy long, piece long, first_token long, n_tokens long, shard long, bin long, bin_offset long, capacity long")

"""SimHash near-duplicate groups found with an inverted index over positional fingerprint bytes.

Fingerprints of 64 bits link at ``MAX_BITS`` or fewer differing bits. ``d`` differing bits touch at most ``d`` of the
eight bytes, so a linked pair shares at least ``8 - MAX_BITS`` bytes at their own positions: the guaranteed minimum of
the count filter. A posting list per single byte would hold 1/256 of all fingerprints, hence postings are keyed by every
choice of that many positions with their byte values (70 lists per fingerprint, 32-bit keys): a pair reaches the minimum
exactly if it meets in a list. Where two fingerprints meet, the tally of shared positional bytes up to the list's last
position tells whether this is the first list they share, so a pair is counted once; pairs under the minimum never
meet. The exact bit distance then verifies each pair inside the join, before any row leaves it.

The pipeline's stage (``one_of_each_group``) links by the same index: fingerprints of five-word shingles meet in the postings, and
a link holds where the whole sets have a similarity of 0.8 or more. At just that similarity fingerprints differ by 7 to 10 bits,
beyond what postings of 64 bits can tell from chance, so an exact way covers the rest: documents that are not in one
component by then meet by the shingles of a prefix of their sets, where every such pair meets; positions, sizes or bucket
counts exclude pairs, and the others are verified on whole sets.

Defined cases: a null or word-free text has fingerprint zero; texts under four words give one shingle; repeated rows and
repeated ids keep one output row each; a null id never names a group (a group of null ids only has a null id); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.llm.common import arrow_rows, column, filter_batches, free_names, map_batches, texts
from chronopanel.llm.components import star_components
from chronopanel.session import stage

MAX_BITS, SHINGLE, SEED, CHUNK = 4, 4, 42, 1 << 15
#: Of the pipeline's stage: shingle width; the bounds of the sample that tells which shingles are frequent.
STAGE_SHINGLE, MAX_SAMPLE, MAX_COMMON = 5, 20_000, 200_000
#: Bits of a shingle's hash in the stage (two sets of 1,000 shingles take a foreign one for their own once in a million pairs), and bits of the map of wanted documents.
HASH_BITS, MARKS = 40, 1 << 24
#: Texts, and pairs of sets, that a task holds at once.
ROWS = 1_000


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of all word shingles, as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < width:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    total = len(words) - width + 1
    hashes = (digest(join(x), SEED) for x in zip(*(islice(words, k, None) for k in range(width)), strict=False))
    counts = np.zeros(64, np.int64)
    while (part := np.fromiter(islice(hashes, CHUNK), np.uint64)).size:
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, fp)`` with the fingerprint as a signed 64-bit integer, and the 64-bit integer columns in ``keep``."""
    def build():
        def step(batch):
            return {id_col: column(batch, id_col).cast(pa.int64()),
                    "fp": pa.array(np.array([fingerprint(t) for t in texts(batch, text_col)], np.uint64).view(np.int64)), **{c: column(batch, c) for c in keep}}
        return step

    return map_batches(docs.select(F.col(id_col).cast("long").alias(id_col), text_col, *keep), build, f"{id_col} long, fp long" + "".join(f", {c} long" for c in keep))


def positional_lists(min_shared: int = 8 - MAX_BITS) -> list[tuple[int, int]]:
    """(byte mask, bits above the last position) of every choice of ``min_shared`` byte positions."""
    out = []
    for places in combinations(range(8), min_shared):
        mask = sum(0xFF << 8 * p for p in places)
        out.append((mask - (1 << 64) if mask >> 63 else mask, 8 * (7 - places[-1])))
    return out


def shared_bytes(x: Column) -> Column:
    """Tally of byte positions at which an exclusive-or is zero."""
    return sum((F.shiftrightunsigned(x, 8 * p).bitwiseAND(F.lit(255)) == 0).cast("int") for p in range(8))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints at ``max_bits`` or fewer differing bits; each pair once."""
    least = 8 - max_bits
    lists = F.array(*(F.struct(F.lit(m).cast("long").alias("mask"), F.lit(s).alias("above")) for m, s in positional_lists(least)))
    index = (prints.select("fp", F.explode(lists).alias("l"))
             .select("fp", F.col("l.mask").alias("mask"), F.col("l.above").alias("above"), F.col("fp").bitwiseAND(F.col("l.mask")).alias("bytes")))
    a, b = index.alias("a"), index.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    # bytes pushed out on the left leave as many zero bytes on the right, which are not shared ones
    tally = shared_bytes(F.call_function("shiftleft", differ, F.col("a.above"))) - F.col("a.above") / 8
    # ``above`` follows from the mask; both sides carry it so that one exchange serves both
    meets = (F.col("a.mask") == F.col("b.mask")) & (F.col("a.above") == F.col("b.above")) & (F.col("a.bytes") == F.col("b.bytes")) & (F.col("a.fp") < F.col("b.fp"))
    # Spark sizes the exploded index like its input, 70 times too low, and would broadcast it
    return a.join(b.hint("merge"), meets & (tally == least) & (F.bit_count(differ) <= max_bits)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def _groups(prints: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """``(fp, root, component_id, n_links)`` of every distinct fingerprint."""
    distinct = prints.groupBy("fp").agg(F.min(id_col).alias("least_id"))
    links = stage(near_links(distinct.select("fp"), max_bits), "simhash-links")
    roots = star_components(links)
    least = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least_id")
    groups = least.groupBy("root").agg(F.min("least_id").alias("component_id"))
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    return least.join(groups, "root").select("fp", "root", "component_id").join(degree, "fp", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits), ``component_id`` (smallest id reachable), ``n_links`` of its fingerprint."""
    prints = stage(fingerprints(docs, id_col, text_col), "simhash")
    return prints.join(_groups(prints, id_col, max_bits), "fp", "left").select(
        id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


# ---- the pipeline's stage: groups by shingle similarity -----------------------------------------------------------

def shingle_set(text: bytes, width: int = STAGE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (``HASH_BITS`` bits of XXH64) of the word shingles; a shorter text is one shingle, a word-free one has none."""
    words = text.lower().split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) < width:
        hashes = [digest(join(words), SEED)] if words else []
    else:
        hashes = (digest(join(x), SEED) for x in zip(*(islice(words, k, None) for k in range(width)), strict=False))
    return np.unique((np.fromiter(hashes, np.uint64) >> np.uint64(64 - HASH_BITS)).view(np.int64))


def prefix(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first n - ceil(0.8 n) + 1 shingles of a set, those in ``common`` (sorted) last.

    Two sets at similarity 0.8 or more share at least 0.8 of the larger one, so under any one order of all shingles
    their prefixes meet; ``common`` only keeps frequent shingles out of the lists and never decides what is found.
    """
    if len(common) and len(hashes):
        often = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~often], hashes[often]])
    n = len(hashes)
    return hashes[:n - -(-4 * n // 5) + 1 if n else 0]


def sketch(hashes: np.ndarray) -> bytes:
    """Shingles of a set by 64 buckets of their hash, 255 at most: two sets share no more than the smaller counts add up to."""
    return np.minimum(np.bincount(hashes & 63, minlength=64), 255).astype(np.uint8).tobytes()


def may_share(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """False where sketches (rows of ``a`` and ``b``) prove a similarity under 0.8; a full bucket proves nothing."""
    least = np.where(np.minimum(a, b) == 255, 1 << 40, np.minimum(a, b).astype(np.int64)).sum(axis=1)
    return 9 * least >= 4 * (n + m)


def packed(hashes: np.ndarray) -> bytes:
    """A set in ``HASH_BITS`` / 8 bytes a shingle."""
    return np.ascontiguousarray(hashes.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :HASH_BITS // 8]).tobytes()


def similar_sets(a: bytes, b: bytes) -> bool:
    """Whether two packed sets have a similarity of 0.8 or more."""
    size = HASH_BITS // 8
    wide = []
    for s in (a, b):
        rows = np.zeros((len(s) // size, 8), np.uint8)
        rows[:, :size] = np.frombuffer(s, np.uint8).reshape(-1, size)
        wide.append(rows.view("<i8").ravel())
    return 9 * len(np.intersect1d(*wide, assume_unique=True)) >= 4 * (len(wide[0]) + len(wide[1]))


def frequent_shingles(docs: DataFrame, text_col: str) -> np.ndarray:
    """Shingles held by several of at most ``MAX_SAMPLE`` documents, ``MAX_COMMON`` at most."""
    def build():
        def step(batch):
            return {"s": pa.array([shingle_set(t) for t in texts(batch, text_col)], pa.list_(pa.int64()))}
        return step

    drawn = docs.select(text_col).where(F.pmod(F.xxhash64(text_col), F.lit(16)) == 0).distinct().limit(MAX_SAMPLE)
    counts = map_batches(drawn, build, "s array<long>", ROWS).select(F.explode("s").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    return np.sort(np.array([r.s for r in counts.where("n >= 4").orderBy(F.desc("n"), "s").limit(MAX_COMMON).collect()], np.int64))


def similar_sizes(a: Column, b: Column) -> Column:
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def marks(rows: DataFrame) -> np.ndarray:
    """A bit per row of ``(i, h)`` at the row's hash, of ``MARKS`` bits: whoever has no bit is not among the rows."""
    spot = F.pmod(F.xxhash64("i", "h"), F.lit(MARKS)) + 1
    found = rows.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros(MARKS // 8, np.uint8)
    for row in found.toLocalIterator():                                # MARKS / 32,768 rows of 4 KB at most
        out[(row["bucket"] - 1) * 4096:row["bucket"] * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return out


def likely(pairs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of set numbers that their sketches do not exclude."""
    side = lambda name: chosen.select(F.col("sid").alias(name), F.col("n").alias(f"n_{name}"), F.col("sketch").alias(f"s_{name}"))
    grid = lambda batch, name: np.frombuffer(b"".join(column(batch, name).to_pylist()), np.uint8).reshape(-1, 64)
    number = lambda batch, name: column(batch, name).to_numpy()
    keep = lambda batch: may_share(grid(batch, "s_a"), grid(batch, "s_b"), number(batch, "n_a"), number(batch, "n_b"))
    return filter_batches(pairs.join(side("a"), "a").join(side("b"), "b"), lambda: keep).select(*pairs.columns)


def verified(pairs: DataFrame, sets: DataFrame, named: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have a similarity of 0.8 or more, counted on whole sets.

    Sets are built anew from the texts, and only those of documents in a pair leave their task: a bitmap of fixed size tells
    most of the others. One side of each pair travels to the other.
    """
    ids = lambda name: sets.select(F.col("sid").alias(name), F.col("i").alias(f"i_{name}"), F.col("h").alias(f"h_{name}"))
    asked = stage(pairs.join(ids("a"), "a").join(ids("b"), "b"), "shingle-pairs")
    bits = marks(asked.select(F.explode(F.array(F.struct(F.col("i_a").alias("i"), F.col("h_a").alias("h")), F.struct(F.col("i_b").alias("i"), F.col("h_b").alias("h")))).alias("x")).select("x.*"))

    def build():
        def step(batch):
            spot = column(batch, "spot").to_numpy()
            part = batch.filter(pa.array((bits[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)))
            return {"i": column(part, by[0]), "h": column(part, by[1]), "s": pa.array([packed(shingle_set(t)) for t in texts(part, text_col)], pa.binary())}
        return step

    rows = named.select(*by, text_col, F.pmod(F.xxhash64(*by), F.lit(MARKS)).cast("long").alias("spot"))
    held = stage(map_batches(rows, build, "i long, h long, s binary", ROWS), "shingle-sets")
    side = lambda name: held.select(F.col("i").alias(f"i_{name}"), F.col("h").alias(f"h_{name}"), F.col("s").alias(f"s_{name}"))
    both = asked.join(side("b"), ["i_b", "h_b"]).select("a", "b", "i_a", "h_a", "s_b").join(side("a"), ["i_a", "h_a"])
    same = lambda batch: [similar_sets(x, y) for x, y in zip(column(batch, "s_a").to_pylist(), column(batch, "s_b").to_pylist())]
    return filter_batches(both.select("a", "b", "s_a", "s_b"), lambda: same, ROWS).select("a", "b").distinct()


def fingerprint_candidates(chosen: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of set numbers by the inverted index: each fingerprint with its nearest linked smaller one, and sets of one fingerprint with their least."""
    prints = stage(chosen.where("n > 0").groupBy("fp").agg(F.min("sid").alias("least")), "shingle-fingerprints")
    near = near_links(prints.select("fp")).groupBy("b").agg(F.min_by("a", F.struct(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("bits"), "a")).alias("a"))
    side = lambda name: prints.select(F.col("fp").alias(name), F.col("least").alias(f"least_{name}"))
    across = near.join(side("a"), "a").join(side("b"), "b").select(F.col("least_a").alias("a"), F.col("least_b").alias("b"))
    within = chosen.where("n > 0").select("sid", "fp").join(prints, "fp").where("sid <> least").select(F.col("least").alias("a"), F.col("sid").alias("b"))
    return across.union(within)


def similar_links(chosen: DataFrame, sets: DataFrame, named: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs of sets at similarity 0.8 or more.

    Candidates of the fingerprint index come first (``fingerprint_candidates``). Each list of a shingle has a head, the member whose shingles most others hold: of a text and its many edits that is the text
    itself, near to all of them while they are far from each other. A member is first compared with one head, the best of its
    lists; so a dense group becomes one component by links in proportion to its members. Then all pairs of a list that are not in one component yet are
    compared. A pair in one component needs no link of its own.
    """
    lists = chosen.where("n > 0").select("sid", "n", F.posexplode("prefix").alias("pos", "shingle"))
    sizes = lists.groupBy("shingle").agg(F.count("*").alias("many")).where("many > 1")
    # exploded lists are sized too low, too: a plan that follows their sizes would broadcast them
    shared = stage(lists.join(sizes.hint("merge"), "shingle").select("shingle", "sid", "n", "pos", "many"), "shingle-lists")
    known = shared.join(shared.groupBy("sid").agg(F.sum("many").alias("pop")), "sid")
    heads = known.groupBy("shingle").agg(F.max(F.struct("pop", (-F.col("sid")).alias("minus"), "n", "pos")).alias("head"))
    met = known.join(heads, "shingle").select("sid", "n", "pos", F.col("head.pop").alias("rank"), (-F.col("head.minus")).alias("head"), F.col("head.n").alias("head_n"), F.col("head.pos").alias("head_pos"))
    # at the first shingle that two sets share, no more can be shared than what follows it in both
    enough = lambda n, pos, m, at: similar_sizes(n, m) & (9 * F.least(n - pos, m - at) >= 4 * (n + m))
    stars = met.where((F.col("head") != F.col("sid")) & enough(F.col("n"), F.col("pos"), F.col("head_n"), F.col("head_pos"))).select(F.col("head").alias("a"), F.col("sid").alias("b"), "rank").distinct()
    one = likely(stars, chosen).groupBy("b").agg(F.max_by("a", F.struct("rank", (-F.col("a")).alias("minus"))).alias("a"))
    asked = likely(fingerprint_candidates(chosen), chosen).union(one.select("a", "b")).distinct()
    first = stage(verified(asked, sets, named, by, text_col), "shingle-links")
    rooted = shared.join(star_components(first), F.col("sid") == F.col("node"), "left").select("shingle", "pos", "sid", "n", F.coalesce("root", "sid").alias("root"))
    rooted = stage(rooted, "shingle-roots")
    mixed = rooted.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    open_ = rooted.join(mixed, "shingle")                               # lists of one component are done
    x, y = open_.alias("x"), open_.alias("y")
    meets = ((F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.sid") < F.col("y.sid")) & (F.col("x.root") != F.col("y.root"))
             & enough(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos")))
    rest = x.join(y, meets).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b")).distinct()
    return stage(first.select("a", "b").union(verified(likely(rest, chosen), sets, named, by, text_col)), "shingle-all-links")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the smallest id stays (null ids last), one row of it.

    Groups are the components of all pairs of documents whose sets of five-word shingles have a similarity (Jaccard) of
    0.8 or more; word-free texts are one group. Where rows share that id but not their text, the smallest hash of the text decides.
    """
    own = free_names(docs, "id", "hash", "row")
    named = docs.select("*", F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias(own[0]), F.xxhash64(F.col(text_col)).alias(own[1]))
    with arrow_rows(docs.sparkSession, ROWS):
        common = frequent_shingles(docs, text_col)
    key_of = lambda found: pa.array(np.array([xxhash.xxh3_64_intdigest(s.tobytes(), SEED) for s in found], np.uint64).view(np.int64))

    def keys():
        def step(batch):
            found = [shingle_set(t) for t in texts(batch, text_col)]
            return {"i": column(batch, own[0]), "h": column(batch, own[1]), "key": key_of(found), "n": pa.array([len(s) for s in found], pa.int64())}
        return step

    def parts():
        def step(batch):
            found = [shingle_set(t) for t in texts(batch, text_col)]
            return {"i": column(batch, own[0]), "h": column(batch, own[1]), "prefix": pa.array([prefix(s, common) for s in found], pa.list_(pa.int64())),
                    "sketch": pa.array([sketch(s) for s in found], pa.binary()),
                    "fp": pa.array(np.array([fingerprint(t, STAGE_SHINGLE) for t in texts(batch, text_col)], np.uint64).view(np.int64))}
        return step

    with arrow_rows(docs.sparkSession, ROWS):
        rows = named.select(*own[:2], text_col)
        equal = map_batches(rows, keys, "i long, h long, key long, n long", ROWS).groupBy("key").agg(F.min(F.struct("i", "h")).alias("least"), F.any_value("n").alias("n"))
        sets = stage(equal.select(F.monotonically_increasing_id().alias("sid"), "least.*", "n"), "shingle-keys")
        chosen = stage(map_batches(rows, parts, "i long, h long, prefix array<long>, sketch binary, fp long", ROWS).join(sets, ["i", "h"]).select("sid", "n", "prefix", "sketch", "fp"), "shingle-prefixes")
        roots = star_components(similar_links(chosen, sets, named, own[:2], text_col))
    names = F.struct(F.col("i").alias(own[0]), F.col("h").alias(own[1]))
    best = sets.select("sid", names.alias("least")).join(roots, F.col("sid") == F.col("node"), "left").groupBy(F.coalesce("root", "sid")).agg(F.min("least").alias("k")).select("k.*").distinct()
    once = F.row_number().over(W.partitionBy(*own[:2]).orderBy(*(F.xxhash64(c) for c in docs.columns)))
    return named.join(best, own[:2], "left_semi").withColumn(own[2], once).where(F.col(own[2]) == 1).select(*docs.columns)

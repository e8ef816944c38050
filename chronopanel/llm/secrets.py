"""Secret scans over an incremental ledger of text blobs, in DataFrame operations only.

Every version of a text is named by its SHA-256 (its blob). The ledger holds one row per scanned (blob, rule version)
with the findings. A scan takes the blobs of the given table, leaves out those which the ledger has under the current rule
version, scans each remaining text once however many paths hold it, appends the result, and joins findings back to
all paths. New rules get a new version and so scan everything again; earlier rows stay for other versions.

Positions come from splitting a text at its matches: the pieces between matches and the matches themselves, in order,
give each start as a running sum of lengths (code points). The running sum is a window over small rows, so a text with
very many findings costs time in proportion.

Defined cases: null texts are empty; repeated texts and rows share one scan and each get its findings; an empty table
gives an empty result and an empty append; a null id is kept; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronopanel.session import scratch_path, stage

#: (kind, pattern, group that must be long enough, its least length), in the order in which kinds are listed.
RULES = (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
         ("access", r"AKIA[A-Z0-9]+", 0, 18),
         ("hex", r"[0-9a-f]{16,}", 0, 16))      # a run of 16 or more is the same as a whole run that is long enough
RULE_VERSION = "2"
LEDGER = "rule_version string, blob string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _matches(text: Column, order: int, rule: tuple) -> Column:
    """Array of (rule order, place, gap before, match length, long enough) in order of place; empty without a match."""
    kind, pattern, group, least = rule
    hit, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    rows = F.transform(F.arrays_zip(hit.alias("hit"), F.slice(gaps, 1, F.size(hit)).alias("gap"), part.alias("part")),
                       lambda x, i: F.struct(F.lit(order).alias("rule"), i.alias("place"), F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("size"), (F.length(x["part"]) >= least).alias("ok")))
    none = F.array().cast("array<struct<rule:int,place:int,gap:int,size:int,ok:boolean>>")
    return F.when(text.rlike(pattern), rows).otherwise(none)


def scan(blobs: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows for ``(blob, text)``, one row per blob."""
    text = F.col("text")
    raw = stage(blobs.select("blob", F.concat(*(_matches(text, k, r) for k, r in enumerate(RULES))).alias("m")), "blob-matches")
    each = raw.where(F.size("m") > 0).select("blob", F.explode("m").alias("m")).select("blob", "m.*").repartition("blob")
    before = W.partitionBy("blob", "rule").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    spans = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before)).where("ok").withColumn("start", F.col("end") - F.col("size"))
    kind = F.element_at(F.array(*(F.lit(r[0]) for r in RULES)), F.col("rule") + 1)
    listed = spans.groupBy("blob").agg(
        *(F.count_if(F.col("rule") == k).alias(f"n_{r[0]}") for k, r in enumerate(RULES)),
        F.array_sort(F.collect_list(F.struct("start", "rule", F.concat_ws(":", kind, F.col("start"), F.col("end")).alias("span")))).alias("found"))
    found = listed.withColumn("spans", F.array_join("found.span", ","))
    return raw.select("blob").join(found, "blob", "left").select(
        F.lit(rule_version).alias("rule_version"), "blob", *(F.coalesce(f"n_{r[0]}", F.lit(0)).cast("long").alias(f"n_{r[0]}") for r in RULES),
        F.sha2(F.coalesce("spans", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def update_ledger(docs: DataFrame, ledger_path: str, text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Scans the texts whose (blob, rule version) the ledger lacks, appends them, and returns the ledger of this version."""
    spark = docs.sparkSession
    spark.createDataFrame([], LEDGER).write.mode("append").parquet(ledger_path)
    known = spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == rule_version)
    unseen = (docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("blob", blob_of(F.col("text")))
              .join(known.select("blob"), "blob", "left_anti").dropDuplicates(["blob"]))
    scan(unseen, rule_version).write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == rule_version)


def secrets(docs: DataFrame, ledger_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """Per document (path): counts, base_sha256 and spans of its text; ``ledger_path`` names a ledger to continue, else a new one begins."""
    ledger = update_ledger(docs, ledger_path or scratch_path(docs.sparkSession, "blob-ledger"), text_col, rule_version)
    paths = docs.select(F.col(id_col).alias(id_col), blob_of(F.col(text_col)).alias("blob"))
    return paths.join(ledger.drop("rule_version"), "blob", "left").select(id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "blob")


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, rule, kind, unnest(range(1, len(hit) + 1)) AS place, unnest(hit) AS hit, unnest(part) AS part, unnest(gaps[1:len(hit)]) AS gap FROM (
    SELECT doc_id, 0 AS rule, 'assign' AS kind, regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS hit, regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS part,
      string_split_regex(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    UNION ALL SELECT doc_id, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    UNION ALL SELECT doc_id, 2, 'hex', regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))),
placed AS (
  SELECT doc_id, rule, kind, length(part) >= (CASE rule WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END) AS ok, length(hit) AS size,
    sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rule ORDER BY place ROWS UNBOUNDED PRECEDING) AS stop FROM cut),
spans AS (SELECT doc_id, rule, kind, CAST(stop - size AS BIGINT) AS start, kind || ':' || CAST(stop - size AS BIGINT) || ':' || CAST(stop AS BIGINT) AS span FROM placed WHERE ok),
listed AS (SELECT doc_id, count(*) FILTER (rule = 0) AS a, count(*) FILTER (rule = 1) AS b, count(*) FILTER (rule = 2) AS c, string_agg(span, ',' ORDER BY start, rule) AS spans FROM spans GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(b, 0) AS BIGINT) AS n_access, CAST(coalesce(c, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(d.text, '')) AS blob
FROM documents d LEFT JOIN listed USING (doc_id)
"""

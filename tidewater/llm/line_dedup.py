"""Line dedup: remove passages of three or more lines that were seen before.

Every run of ``window`` consecutive lines is hashed to 128 bits.  A window that
occurs more than once anywhere keeps its first occurrence, in the order
(id, hash of the text, position); every line that a later occurrence covers is
removed, overlapping occurrences being merged into one interval.

Defined results
  * null text stays null; a text of fewer lines than ``window`` is unchanged;
  * windows made only of blank lines are layout, not content, and are ignored;
  * rows equal in id and text are one document: they get the same answer and do
    not count as copies of each other; null ids form one id, which sorts first;
  * within a run of equal lines the later windows overlap the first one, so one
    line of the run stays;
  * columns beside id and text pass through, whatever their names (with ``counts``, ones named
    ``n_lines`` or ``n_removed`` are replaced).

Two shuffles of 28-byte window rows (the second joins only windows that repeat)
and one of the documents.  A hot window is pre-aggregated in the map tasks, and
the join of its occurrences has one row on the other side, so AQE can split it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import col, table


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(id, text hash, position, h1, h2) of every window that is not all blank."""
    lines = F.split(col(text_col), "\n", -1)
    hashed = F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(x).alias("a"),
            F.xxhash64(F.lit(7), x).alias("b"),
            (F.trim(x) != "").alias("c"),
        ),
    )
    rows = docs.where(col(text_col).isNotNull()).select(
        col(id_col).alias("id"), F.xxhash64(col(text_col)).alias("th"), hashed.alias("h")
    )
    n = F.size("h")
    shifted = [F.slice("h", k + 1, n) if k else F.col("h") for k in range(window)]
    zipped = F.arrays_zip(*[s.alias(f"w{k}") for k, s in enumerate(shifted)])
    rows = rows.where(n >= window).select("id", "th", F.slice(zipped, F.lit(1), F.greatest(n - (window - 1), F.lit(0))).alias("w"))
    rows = rows.select("id", "th", F.posexplode("w").alias("pos", "w"))
    part = [[F.col(f"w.w{k}.{f}") for k in range(window)] for f in "abc"]
    some: Column = part[2][0]
    for c in part[2][1:]:
        some = some | c
    return rows.where(some).select("id", "th", "pos", F.xxhash64(*part[0]).alias("h1"), F.xxhash64(*part[1]).alias("h2"))


def covered_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3) -> DataFrame:
    """(id, th, starts): the sorted first lines of a document's later occurrences."""
    wins = _windows(docs, id_col, text_col, window)
    at = F.struct("id", "th", "pos")
    # Written, so that the join has plain exchanges on both sides and AQE can split a hot window.
    repeated = table(wins.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "windows")
    later = wins.join(repeated, ["h1", "h2"]).where(~at.eqNullSafe(F.col("first")))
    return later.groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 3, counts: bool = False, emptied: bool = True) -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text_col``.

    With ``counts``, ``n_lines`` (before) and ``n_removed`` are added.  Without ``emptied``, documents of which
    nothing but blanks is left go; those that had nothing else before stay."""
    cover = covered_positions(docs, id_col, text_col, window).select(
        F.col("id").alias("__ld_id"), F.col("th").alias("__ld_th"), F.col("starts").alias("__ld_s")
    )
    keyed = docs.withColumn("__ld_h", F.xxhash64(col(text_col)))
    out = keyed.join(cover, (col(id_col).eqNullSafe(F.col("__ld_id"))) & (F.col("__ld_h") == F.col("__ld_th")), "left")
    lines, s = F.split(col(text_col), "\n", -1), F.col("__ld_s")
    n, k = F.size(lines), F.size(s)
    # Interval bounds: a start whose predecessor ended before it, an end whose successor begins after it.
    prev, nxt = F.slice(s, F.lit(1), k - 1), F.slice(s, F.lit(2), k)
    starts = F.concat(
        F.slice(s, 1, 1),
        F.transform(F.filter(F.arrays_zip(nxt.alias("x"), prev.alias("y")), lambda p: p["x"] - p["y"] > window), lambda p: p["x"]),
    )
    ends = F.concat(
        F.transform(
            F.filter(F.arrays_zip(prev.alias("x"), nxt.alias("y")), lambda p: p["y"] - p["x"] > window), lambda p: p["x"] + window
        ),
        F.transform(F.slice(s, -1, 1), lambda p: p + window),
    )
    out = out.withColumns({"__ld_lines": lines, "__ld_from": F.concat(F.array(F.lit(0)), ends), "__ld_to": F.concat(starts, F.array(n))})
    gaps = F.transform(
        F.arrays_zip(F.col("__ld_from").alias("x"), F.col("__ld_to").alias("y")), lambda g: F.struct(g["x"].alias("x"), (g["y"] - g["x"]).alias("len"))
    )
    kept = F.flatten(F.transform(gaps, lambda g: F.slice(F.col("__ld_lines"), g["x"] + 1, g["len"])))
    out = out.withColumn("__ld_kept", F.when(s.isNull(), F.col("__ld_lines")).otherwise(kept))
    if not emptied:
        out = out.where(s.isNull() | F.exists("__ld_kept", lambda x: x.rlike(r"\S")))
    text = F.when(s.isNull(), col(text_col)).otherwise(F.array_join("__ld_kept", "\n"))
    cols = [text.alias(c) if c == text_col else col(c) for c in docs.columns if not counts or c not in ("n_lines", "n_removed")]
    if counts:
        cols += [
            F.coalesce(F.size("__ld_lines"), F.lit(0)).cast("long").alias("n_lines"),
            F.coalesce(F.size("__ld_lines") - F.size("__ld_kept"), F.lit(0)).cast("long").alias("n_removed"),
        ]
    return out.select(*cols)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return line_dedup(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = """
WITH lines AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT DISTINCT doc_id, text FROM documents)),
wins AS (
  SELECT doc_id, pos, line AS a,
         lead(line, 1) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS rn
  FROM wins WHERE c IS NOT NULL AND NOT (trim(a) = '' AND trim(b) = '' AND trim(c) = '')),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM ranked, (VALUES (0), (1), (2)) t(k) WHERE rn > 1),
merged AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
         coalesce(string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos), '') AS text
  FROM lines l LEFT JOIN gone g USING (doc_id, pos) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_removed, 0) AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE m.text END AS text
FROM documents d LEFT JOIN merged m USING (doc_id)
"""

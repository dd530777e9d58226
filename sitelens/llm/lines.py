"""Line dedup by winnowing, in column expressions only.

Windows are the shortest sequences of lines with at least ``words`` words, taken from every line forwards and backwards. Each window
selects its smallest line hash (the first of equal ones); the distinct selected positions are the fingerprints. A repeated run of that
many words holds the same whole window at both places, so both select the same line: a window can repeat only where its
fingerprint stands at two positions. Positions are counted by fingerprint, windows of lone fingerprints go (nearly all of a corpus
without copies), the others are compared by a hash of all their lines, and all but the first place (by doc_id, then row) match an
earlier one. Forward windows carry a match to the run's start, backward ones to its end: their union is the match extended both ways.
All lines of runs seen earlier are deleted, blank lines between them too.

A match is extended by comparing further windows, not neighbour by neighbour of one earlier place: the longest match of a run may lie at
another place than the first. Hot fingerprints and windows are combined before each shuffle, joins back may be split.

Defined results: null and empty texts have no lines to compare; blank lines are ignored in matching; a null doc_id counts as the last
one; repeated rows are places of their own, the later ones are deleted; empty tables give no rows; other columns, whatever their
names, are kept as they are when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, materialize, table

WORDS = 50


def repeated_runs(rows: DataFrame, row: str, words: int = WORDS) -> DataFrame:
    """(row, runs): the [lo, hi] ranges of lines that repeat earlier ones, of rows(row, doc_id, text) where there are some."""
    lines = rows.select(F.col(row).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).where("line <> ''")
    lines = lines.select("row", "id", "pos", F.xxhash64("line").alias("h"), F.size(F.split("line", r"\s+")).cast("long").alias("w"))
    by = Window.partitionBy("row")
    lines = lines.withColumn("after", F.sum("w").over(by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.col("after") - F.col("w"))
    ahead, behind = by.orderBy("before").rangeBetween(0, words - 1), by.orderBy("after").rangeBetween(1 - words, 0)
    seen = lambda way, w: F.struct(
        F.lit(way).alias("way"), F.min("pos").over(w).alias("lo"), F.max("pos").over(w).alias("hi"), (F.max("after").over(w) - F.min("before").over(w)).alias("n"), F.min(F.struct("h", "pos")).over(w).alias("least"), F.xxhash64(F.collect_list("h").over(w)).alias("hs")
    )
    both = lines.select("row", "id", seen(0, ahead).alias("a"), seen(1, behind).alias("b")).select("row", "id", F.explode(F.array("a", "b")).alias("x")).select("row", "id", "x.*")
    windows = both.where(F.col("n") >= words).select("row", "id", "lo", "hi", F.col("least.h").alias("fp"), F.col("least.pos").alias("at"), F.xxhash64("way", "hs").alias("content"))
    windows = materialize(windows, "windows")
    # a fingerprint stands at two positions if its least and greatest differ
    position = F.struct("row", "at")
    shared = windows.groupBy("fp").agg(F.min(position).alias("a"), F.max(position).alias("z")).where("a <> z").select("fp")
    matched = materialize(windows.join(shared, "fp").select("row", "id", "lo", "hi", "fp", "content"), "matched")
    place = F.struct("id", "row", "lo")
    first = matched.groupBy("fp", "content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = matched.join(first, ["fp", "content"]).where(place != F.col("first"))
    gone = later.select("row", F.explode(F.sequence("lo", "hi")).alias("pos")).distinct()
    gone = gone.withColumn("island", F.col("pos") - F.row_number().over(by.orderBy("pos")))
    return gone.groupBy("row", "island").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))


def with_runs(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, str]:
    """docs with a column of the runs to delete (null where there are none), and its name."""
    row, runs = fresh(docs.columns, "row", "runs")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = repeated_runs(rows.select(row, "doc_id", "text"), row, words).select(F.col("row").alias(row), F.col("runs").alias(runs))
    return rows.join(found, row, "left").drop(row), runs


def left_over(runs: str) -> Column:
    """The text without the lines of the runs."""
    stay = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.exists(F.col(runs), lambda r: (r.lo <= i) & (i <= r.hi)))
    return F.when(F.col(runs).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))


def drop_repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with their columns; text without later repeated runs, n_chars (where there is one) renewed."""
    out, runs = with_runs(docs, words)
    out = out.withColumn("text", left_over(runs))
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, runs = with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r.hi - r.lo + 1), F.lit(0).cast("long"))
    return out.select(
        "doc_id",
        F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        removed.alias("n_removed"),
        F.sha2(F.coalesce(left_over(runs), F.lit("")), 256).alias("kept_sha256"),
    )


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later repeated runs go from the texts; no document goes."""
    return drop_repeated_lines(docs)


#: Brute force over all pairs of equal lines: the maximal runs that stand at two places. Places are those of distinct doc_ids, as in the tables.
ORACLE = """
WITH a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
l AS (
  SELECT doc_id, pos, trim(line) AS line, len(regexp_split_to_array(trim(line), '\\s+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i
  FROM a WHERE trim(line) <> ''),
p AS (
  SELECT x.doc_id AS d, x.i, x.pos, x.w, y.doc_id AS e, x.i - y.i AS diagonal
  FROM l x JOIN l y ON x.line = y.line AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.i < x.i)),
s AS (SELECT *, i - row_number() OVER (PARTITION BY d, e, diagonal ORDER BY i) AS island FROM p),
r AS (SELECT d AS doc_id, min(pos) AS lo, max(pos) AS hi FROM s GROUP BY d, e, diagonal, island HAVING sum(w) >= 50),
g AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos FROM r),
k AS (SELECT a.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(a.line, chr(10) ORDER BY a.pos) FILTER (WHERE g.pos IS NULL), '') AS kept FROM a LEFT JOIN g USING (doc_id, pos) GROUP BY a.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN k USING (doc_id)
"""

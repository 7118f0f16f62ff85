"""Line dedup: repeated windows of three lines are found globally and later occurrences removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import blank_trim, checkpointed, other_columns, quoted, read_table, sized, whole_row, without_lines


def _windows(documents: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """A row per window: its document (id, digest), 128 bits of hash and its first and last line."""
    worded = F.filter(F.transform(F.split(text_col, "\n"), lambda line, i: F.struct(i.alias("at"), blank_trim(line).alias("line"))), lambda x: x["line"] != "")
    lines = documents.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("digest"), worded.alias("lines")).where(F.size("lines") >= width)
    lines = lines.withColumn("lines", F.transform("lines", lambda x: F.struct(x["at"].alias("a"), x["at"].alias("z"), F.xxhash64(x["line"]).alias("h"), F.xxhash64(F.lit("g"), x["line"]).alias("g"))))
    for step in range(1, width):
        shifted = F.slice("__all", step + 1, F.size("__all"))
        lines = (lines if step > 1 else lines.withColumn("__all", F.col("lines"))).withColumn(
            "lines",
            F.zip_with("lines", shifted, lambda x, y: F.struct(x["a"].alias("a"), y["z"].alias("z"), F.xxhash64(x["h"], y["h"]).alias("h"), F.xxhash64(x["g"], y["g"]).alias("g"))),
        )
    return lines.select("id", "digest", F.inline(F.slice("lines", F.lit(1), F.size("lines") - (width - 1))))


def later_windows(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``(id, digest, gone)``: for each document with lines to remove, their places from 0, sorted.

    Null texts and texts of fewer lines have no window; an empty table gives an empty result.
    """
    windows = checkpointed(_windows(documents, id_col, text_col, width))  # read twice: texts are hashed once
    place = F.struct(F.col("id").isNull().alias("none"), "id", "digest", "a")
    first = windows.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").drop("n")
    first = checkpointed(first)  # AQE splits no join with an aggregate in it
    later = windows.join(first, ["h", "g"]).where(~place.eqNullSafe(F.col("first"))).select("id", "digest", "a", "z")
    spans = later.groupBy("id", "digest").agg(F.collect_set(F.struct("a", "z")).alias("spans"))
    return spans.select("id", "digest", F.sort_array(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["z"]))))).alias("gone"))


def drop_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """``documents`` with later occurrences of windows of ``width`` lines cut, and ``n_removed``.

    A window is ``width`` consecutive lines that have a word, as they are but for blanks at their
    ends; lines without a word between them belong to it. Of all its occurrences over all
    documents the first stays: smallest id (null ids last), then text digest, then line. Lines
    covered by any later occurrence are removed.

    Rows with the same id and text are one document and fare alike. Null texts stay null, texts
    with fewer lines stay as they are, and a text of which all is removed becomes empty; every row
    stays. An own column ``n_removed`` is replaced; other extra columns are kept.
    """
    cut = _cut(documents, id_col, text_col, width)
    return cut.select(
        *_own(documents, text_col, other_columns(documents, ["n_removed"])),
        F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long").alias("n_removed"),
    )


def without_repeated_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """As ``drop_repeated_lines``, with the columns of ``documents`` and no other."""
    return _cut(documents, id_col, text_col, width).select(*_own(documents, text_col, documents.columns))


def _own(documents: DataFrame, text_col: str, names: list[str]) -> list:
    return [F.col("__text").alias(c) if c == text_col else F.col(f"__row.{quoted(c)}").alias(c) for c in names]


def _cut(documents: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Whole rows, their texts without later windows, and the places of the lines cut."""
    gone = checkpointed(later_windows(documents, id_col, text_col, width))
    gone = gone.select(F.col("id").alias("__id"), F.col("digest").alias("__digest"), F.col("gone").alias("__gone"))
    own = documents.select(whole_row(documents), F.col(id_col).alias("__own_id"), F.xxhash64(text_col).alias("__own"))
    joined = own.join(sized(gone, 50_000, "__gone"), F.col("__own_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__digest")), "left")
    return without_lines(joined.select("__row", "__gone", F.col(f"__row.{quoted(text_col)}").alias("__text")), "__text", "__gone")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` without later windows; odd rows as in ``drop_repeated_lines``."""
    found = drop_repeated_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_removed")


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
QUERIES = {"op6_line_dedup": op6_line_dedup}
SQL = {
    "op6_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
   FROM documents WHERE text IS NOT NULL),
 w AS (SELECT doc_id, pos, trim(line, {_BLANKS}) AS line FROM l WHERE trim(line, {_BLANKS}) != ''),
 t AS (SELECT doc_id, pos AS a, line AS x, lead(line, 1) OVER o AS y, lead(line, 2) OVER o AS z, lead(pos, 2) OVER o AS c
   FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
 f AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, a) AS r FROM t WHERE c IS NOT NULL),
 gone AS (SELECT DISTINCT l.doc_id, l.pos FROM l JOIN f ON f.doc_id = l.doc_id AND l.pos BETWEEN f.a AND f.c WHERE f.r > 1),
 k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id),
 n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""
}

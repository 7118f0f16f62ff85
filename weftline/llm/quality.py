"""Quality rules: counts over each text, and lines that many documents of a host share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import BREAK, NOT_BREAK, blank_trim, checkpointed, other_columns, own_columns, quoted, read_table, row_count, sized, whole_row, without_lines

#: Words in a window of which repeats are counted.
WINDOW = 8


def _shifted(array: str, by: int) -> Column:
    return F.slice(array, by + 1, F.size(array))


def base_counts(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """``documents`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Null, empty and blank texts have no words and fail; each row is measured alone, whole and as
    often as it is there; an empty table gives an empty result.

    All steps are arrays of one row: window hashes are built by doubling (2, 4, 8 words), and only
    texts in which one occurs twice sort them to find the places covered. Each step is a column of
    its own, since a later one reads it more than once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BREAK))
    df = documents.withColumn("__words", F.split(blank_trim(text), BREAK + "+")).withColumn("__lines", lines)
    df = df.withColumns(
        {
            "n_words": F.when(F.element_at("__words", 1) == "", 0).otherwise(F.size("__words")).cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__w": F.transform("__words", lambda w: F.xxhash64(w)),
        }
    ).drop("__words", "__lines")
    for step in (1, 2, 4):
        df = df.withColumn("__w", F.zip_with("__w", _shifted("__w", step), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn("__w", F.slice("__w", F.lit(1), F.greatest(F.col("n_words") - (WINDOW - 1), F.lit(0)).cast("int")))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__w")) < F.size("__w"), F.sort_array(F.transform("__w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__w")
    df = df.withColumn("__e", F.zip_with("__s", _shifted("__s", 1), lambda x, y: x["h"].eqNullSafe(y["h"])))
    twice = F.zip_with(F.zip_with("__e", F.concat(F.array(F.lit(False)), F.col("__e")), lambda x, y: x | y), "__s", lambda d, s: F.when(d, s["i"]))
    df = df.withColumn("__p", F.sort_array(F.filter(twice, lambda i: i.isNotNull()))).drop("__s", "__e")
    covered = F.zip_with("__p", _shifted("__p", 1), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda total, n: total + n), F.lit(0).cast("long"))).drop("__p")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _host(host_col: str) -> Column:
    return F.xxhash64(host_col)


def _normal_lines(text_col: str) -> Column:
    """Lines in lower case, each run of blanks one space."""
    return F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[\x20\x09\x0B-\x0D]+", " "), "\n")


def _hashed_lines(text_col: str) -> Column:
    """Places (from 0), hashes and word counts of lines that have a word, normalised."""
    lines = F.filter(F.transform(_normal_lines(text_col), lambda line, i: F.struct(i.alias("at"), F.trim(line).alias("line"))), lambda x: x["line"] != "")
    return F.transform(lines, lambda x: F.struct(x["at"], F.xxhash64(x["line"]).alias("h"), (F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(" "))) + 1).alias("words")))


def _keyed(documents: DataFrame, id_col: str, text_col: str, host_col: str) -> list[Column]:
    return [_host(host_col).alias("__host"), F.col(quoted(id_col)).alias("__id"), F.xxhash64(quoted(text_col)).alias("__digest")]


def frequent_lines(rows: DataFrame, most: int = 10, share: float = 0.05) -> DataFrame:
    """``(__host, h, first_id, first_digest)`` of ``rows(__host, __id, __digest, __lines)``: lines above the limits.

    A line, normalised and hashed, is above them if it stands in over ``most`` documents of one
    host and in over ``share`` of all its documents. Each row is a document, exact copies too. Null
    hosts are one host. The document of the smallest id has it first; if all ids are null, the one
    of the smallest text digest. An empty table has no such line.
    """
    each = rows.select("__host", "__id", "__digest", F.explode(F.array_distinct(F.transform("__lines", lambda x: x["h"]))).alias("h"))
    first = [F.min("__id").alias("first_id"), F.min(F.when(F.col("__id").isNull(), F.col("__digest"))).alias("first_digest")]
    frequent = checkpointed(each.groupBy("__host", "h").agg(F.count(F.lit(1)).alias("n"), *first).where(F.col("n") > most))
    if share > 0:
        hosts = rows.groupBy("__host").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > most)
        hosts = sized(checkpointed(hosts), 50_000)
        frequent = checkpointed(frequent.join(hosts, "__host").where(F.col("n") > share * F.col("documents")))
    return frequent.select("__host", "h", "first_id", "first_digest")


def _is_first(first_id: Column, first_digest: Column) -> Column:
    return F.when(first_id.isNotNull(), F.coalesce(F.col("__id") == first_id, F.lit(False))).otherwise(F.col("__id").isNull() & (F.col("__digest") == first_digest))


def with_removed(rows: DataFrame, frequent: DataFrame, most_listed: int = 50_000) -> DataFrame:
    """``rows`` with ``removed``: the (at, words) of lines that ``frequent`` takes from each, null or empty if none.

    Up to ``most_listed`` frequent lines, a checked count, are broadcast as a list for each host and
    looked up within the row, so that texts don't move. More are joined with the single lines, and
    what they take from a document comes back by its host, id and text.
    """
    if row_count(frequent) <= most_listed:
        lists = frequent.groupBy("__host").agg(F.collect_list(F.struct("h", "first_id", "first_digest")).alias("__frequent"))
        found = rows.join(F.broadcast(lists), "__host", "left")
        found = found.withColumn("__hits", F.when(F.col("__frequent").isNotNull(), F.array_intersect(F.transform("__lines", lambda x: x["h"]), F.transform("__frequent", lambda x: x["h"]))))
        gone = F.filter("__frequent", lambda f: F.array_contains("__hits", f["h"]) & ~_is_first(f["first_id"], f["first_digest"]))
        found = found.withColumn("__gone", F.when(F.size("__hits") > 0, F.transform(gone, lambda f: f["h"])))
        removed = F.transform(F.filter("__lines", lambda x: F.array_contains("__gone", x["h"])), lambda x: F.struct(x["at"], x["words"]))
        return found.withColumn("removed", F.when(F.size("__gone") > 0, removed)).drop("__frequent", "__hits", "__gone")
    hit = rows.select("__host", "__id", "__digest", F.inline("__lines")).join(frequent, ["__host", "h"]).where(~_is_first(F.col("first_id"), F.col("first_digest")))
    key = [F.col("__host").alias("__h"), F.xxhash64("__id").alias("__i"), F.col("__digest").alias("__d")]
    lost = checkpointed(hit.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("at", "words"))).alias("removed")))
    return rows.join(sized(lost, 50_000, "removed"), (F.col("__host") == F.col("__h")) & (F.xxhash64("__id") == F.col("__i")) & (F.col("__digest") == F.col("__d")), "left").drop("__h", "__i", "__d")


_NEW = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "removed", "kept")


def _judged(documents: DataFrame, id_col: str, text_col: str, host_col: str, most: int, share: float, least_words: int, least_share: float, most_listed: int, keep_text: bool = True) -> DataFrame:
    """Whole rows of ``documents`` (their text too if ``keep_text``) beside the columns of ``_NEW``."""
    shape = documents if keep_text else documents.drop(text_col)
    keyed = _keyed(documents, id_col, text_col, host_col)
    rows = base_counts(documents.select(whole_row(shape), *keyed, F.col(quoted(text_col)).alias("__text")), "__text").withColumn("__lines", _hashed_lines("__text")).drop("__text")
    if keep_text:
        lines = documents.select(*keyed, _hashed_lines(quoted(text_col)).alias("__lines"))
    else:
        rows = lines = checkpointed(rows)  # one pass over the texts, of which only counts and hashes are left
    found = with_removed(rows, frequent_lines(lines, most, share), most_listed)
    found = found.withColumn("removed_words", F.aggregate(F.coalesce("removed", F.expr("cast(array() as array<struct<at:int,words:int>>)")), F.lit(0).cast("long"), lambda total, x: total + x["words"]))
    left = F.col("n_words") - F.col("removed_words")
    depleted = (F.col("removed_words") > 0) & ((left < least_words) | (left < least_share * F.col("n_words")))
    return found.select("__row", *_NEW[:6], "removed_words", F.when(F.size("removed") > 0, F.transform("removed", lambda x: x["at"])).alias("removed"), (~F.col("base_failed") & ~depleted).alias("kept"))


def quality(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = 10, share: float = 0.05, least_words: int = 20, least_share: float = 0.3,
    most_listed: int = 50_000, keep_text: bool = True,
) -> DataFrame:
    """``documents`` with the base counts, ``base_failed``, ``removed_words``, ``removed`` and ``kept``.

    A document fails if its base counts do, or if it is depleted: some of its lines are above the
    limits (``frequent_lines``), which are removed from all documents of the host but the first
    that has them, and what is left has under ``least_words`` words or under ``least_share`` of
    them. So of a text that a host has very often the first copy stays. ``removed`` holds the places
    of lines, from 0 and sorted; null if none.

    Each row is a document: repeated rows and exact copies count, and each stays a row. Null and
    empty texts have no words and fail. An empty table gives an empty result. Own columns named
    like new ones, in upper or lower case, are replaced, other extra columns kept; without
    ``keep_text`` the text is left out and read once only.
    """
    judged = _judged(documents, id_col, text_col, host_col, most, share, least_words, least_share, most_listed, keep_text)
    return judged.select(*own_columns([c for c in other_columns(documents, _NEW) if keep_text or c != text_col]), *_NEW)


def keep_good(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", most: int = 10, share: float = 0.05, least_words: int = 20, least_share: float = 0.3, most_listed: int = 50_000
) -> DataFrame:
    """The columns of ``documents``: those that ``quality`` keeps, without the lines removed from them.

    Null, empty and blank texts go, as they have no words. A null id or host is one like others;
    repeated rows fare alike. An empty table gives an empty result; all columns are kept.
    """
    judged = _judged(documents, id_col, text_col, host_col, most, share, least_words, least_share, most_listed)
    # as a generator's output, since a filter on the verdict itself would be pushed through all
    # columns that it comes from, with each step's expression copied into the next one's
    left = judged.select("__row", "removed", F.explode(F.array("kept")).alias("kept")).where("kept")
    return without_lines(left.select("__row", "removed", F.col(f"__row.{quoted(text_col)}").alias("__text")), "__text", "removed").select(
        *(F.col("__text").alias(c) if c == text_col else F.col(f"__row.{quoted(c)}").alias(c) for c in documents.columns)
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``quality`` of ``documents`` with its production parameters; odd rows as there."""
    found = quality(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


QUERIES = {"op2_quality": op2_quality}
SQL = {
    "op2_quality": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
 w AS (SELECT doc_id, text, source, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
 t AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
 x AS (SELECT doc_id, i, word || chr(0) || lead(word, 1) OVER o || chr(0) || lead(word, 2) OVER o || chr(0) || lead(word, 3) OVER o || chr(0) || lead(word, 4) OVER o
   || chr(0) || lead(word, 5) OVER o || chr(0) || lead(word, 6) OVER o || chr(0) || lead(word, 7) OVER o AS g FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 p AS (SELECT doc_id, i FROM x WHERE g IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
 r AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM p) GROUP BY doc_id),
 l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
 dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
 nl AS (SELECT doc_id, source, trim(regexp_replace(lower(line), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line
   FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d)),
 h AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
 f AS (SELECT nl.source, line, min(doc_id) AS first FROM nl JOIN h ON h.source IS NOT DISTINCT FROM nl.source WHERE line != ''
   GROUP BY nl.source, line HAVING count(DISTINCT doc_id) > 10 AND count(DISTINCT doc_id) > 0.05 * any_value(h.docs)),
 lost AS (SELECT doc_id, sum(len(string_split(nl.line, ' '))) AS n FROM nl JOIN f ON f.source IS NOT DISTINCT FROM nl.source AND f.line = nl.line WHERE doc_id != f.first GROUP BY doc_id),
 b AS (SELECT w.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
   length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS removed_words
   FROM w LEFT JOIN dl USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN lost USING (doc_id)),
 c AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
 CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, CAST(removed_words AS BIGINT) AS removed_words,
 NOT base_failed AND NOT (removed_words > 0 AND (n_words - removed_words < 20 OR n_words - removed_words < 0.3 * n_words)) AS kept FROM c"""
}

"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; what a
stage decides is done: rejected documents and removed lines are gone, copies of a document are
one, and sources are in their target proportions. ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import checkpointed, quoted, read_table, recounted
from weftline.llm.linededup import without_repeated_lines
from weftline.llm.mixing import mixed_documents
from weftline.llm.packing import packed_digests
from weftline.llm.quality import keep_good
from weftline.llm.simhash import keep_one_text


def _counted(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with ``n_chars`` counted anew (null for a null text)."""
    return recounted(found, "text").select(*(F.col(quoted(c)) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the lines above the limits.

    Null, empty and blank texts and those under 20 words go; null ids and sources are like others,
    repeated rows fare alike; an empty table stays empty.
    """
    return _counted(keep_good(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without later occurrences of three lines.

    Null texts stay null, texts of fewer lines whole, and one of which nothing is left is empty;
    repeated rows fare alike; an empty table stays empty.
    """
    return _counted(without_repeated_lines(docs), docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the smallest id, null ids last.

    Null texts and texts without a word are one component; of repeated rows one stays; an empty
    table stays empty.
    """
    return keep_one_text(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document that takes words of it.

    Texts without a word give no row; a null source is the last; an empty table stays empty.
    """
    return _counted(mixed_documents(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and where they lie.

    A null or empty text is one piece of one token; rows with one id are documents of their own;
    an empty table has no pieces.
    """
    return packed_digests(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing),
    ("packing", packing),
]

#: Tokens, fingerprints and permutations have no SQL; the stages are held against brute force in tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what the one before kept."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

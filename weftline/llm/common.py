"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A break between words: the space and \t \n \v \f \r. ``bytes.split()`` splits at the same six.
BREAK = r"[\x20\x09-\x0D]"
NOT_BREAK = r"[^\x20\x09-\x0D]"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the cluster's checkpoint folder, with its lineage cut.

    A session in one process may leave ``spark.checkpoint.dir`` unset and has a temporary folder;
    on a cluster that is an error, since executors don't see each other's local folders.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def row_count(df: DataFrame) -> int:
    return df.agg(F.count(F.lit(1))).first()[0]


def lower_ascii(column):
    """A-Z in lower case, every other character as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame):
    """All columns as one, so that no column of ``df`` can clash with one that an operator adds."""
    return F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("__row")


def own_columns(names: list[str]) -> list:
    return [F.col(f"__row.{quoted(c)}").alias(c) for c in names]


def other_columns(df: DataFrame, new) -> list[str]:
    """Names of ``df`` that no new column replaces; upper and lower case are one unless the session tells them apart."""
    exact = df.sparkSession.conf.get("spark.sql.caseSensitive") == "true"
    taken = set(new) if exact else {n.lower() for n in new}
    return [c for c in df.columns if (c if exact else c.lower()) not in taken]


def recounted(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the characters of its texts in ``n_chars``, if it has such a column in upper or lower case."""
    name = next((c for c in df.columns if c.lower() == "n_chars"), None)
    return df if name is None else df.withColumn(name, F.length(quoted(text_col)).cast(df.schema[name].dataType))


def blank_trim(column):
    return F.btrim(column, F.lit(" \t\n\x0b\f\r"))


def sized(small: DataFrame, rows: int, list_col: str | None = None, values: int = 2_000_000) -> DataFrame:
    """``small``, to be broadcast if it has at most ``rows`` rows and ``values`` values in its lists.

    Beyond that size the join shuffles both sides. All columns but ``list_col`` should be of
    bounded width, and the table cheap to count.
    """
    held = F.sum(F.size(list_col)) if list_col else F.lit(0)
    count, total = small.agg(F.count(F.lit(1)), F.coalesce(held, F.lit(0))).first()
    return F.broadcast(small) if count <= rows and total <= values else small


def numbered(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``__n``, its rows' places from 0 by ``order``; ranges are numbered in parallel, only their counts come together."""
    ordered = df.select("*", F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("__order"))
    # kept, since both the counts and the numbers read it: ranges drawn twice could differ
    ranged = checkpointed(ordered.repartitionByRange("__order").withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__base"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy("__order"))
    return ranged.join(F.broadcast(base), "__part").withColumn("__n", F.col("__base") + own - 1).drop("__part", "__base", "__order")


def without_lines(df: DataFrame, text_col: str, gone_col: str) -> DataFrame:
    """``df`` with the lines at the places in ``gone_col`` (from 0, distinct; null: none) cut out of ``text_col``.

    Lines and places are sorted together, so the work is in proportion to n log n for n lines.
    """
    marked = F.sort_array(
        F.concat(
            F.transform(F.split(text_col, "\n"), lambda line, i: F.struct(i.alias("at"), F.lit(1).alias("kind"), line.alias("line"))),
            F.transform(gone_col, lambda at: F.struct(at.cast("int").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("line"))),
        )
    )
    before = F.concat(F.array(F.lit(None).cast("struct<at:int,kind:int,line:string>")), F.col("__marked"))
    line = F.zip_with("__marked", before, lambda m, b: F.when((m["kind"] == 1) & ~F.coalesce((b["kind"] == 0) & (b["at"] == m["at"]), F.lit(False)), m["line"]))
    return (
        df.withColumn("__marked", F.when(F.col(gone_col).isNotNull(), marked))
        .withColumn(text_col, F.when(F.col("__marked").isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(line, lambda x: x.isNotNull()), "\n")))
        .drop("__marked")
    )

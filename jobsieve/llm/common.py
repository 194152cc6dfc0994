"""Small helpers that the operators for training text share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobsieve.operators.spread import salted_join
from jobsieve.session import new_path

WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"  # letters, digits and non-ASCII characters, in text with A-Z lower-cased


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share, and read back.

    This cuts the lineage: what follows survives lost executors without computing ``df`` again.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``stored`` wrote and that nothing will read again."""
    context = table.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string) of the rows that have an id; a null text is empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where(F.col("doc_id").isNotNull())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node of the links (a long, b long).

    Large-star and small-star steps in turn until nothing changes.  Each step is one
    combined aggregation and one lookup whose hot keys are split, so a node with a third
    of all links does not land in one task, and no component is ever gathered.
    """
    edges = stored(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(),
        "links",
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = salted_join(both, least, ["u"], "inner").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = salted_join(large, lowest, ["u"], "inner").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = lowest.select("u", F.col("m").alias("v"))
        edges = stored(own.union(rest).where("u != v").distinct(), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()

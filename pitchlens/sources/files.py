"""File and table sources / sinks."""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixtures as fx
from ..operators.clean import nan_to_null
from ..operators.joins import lookup_join
from ..schema import CAT_COLS, FINISHED_STATUS
from ..session import materialize, path_exists


def csv_schema(columns, cat_cols=CAT_COLS, index_col: str | None = "_c0") -> T.StructType:
    """Explicit schema: text for ``cat_cols``, double for everything else."""
    fields = [T.StructField(index_col, T.LongType())] if index_col else []
    cats = set(cat_cols)
    fields += [T.StructField(c, T.StringType() if c in cats else T.DoubleType()) for c in columns]
    return T.StructType(fields)


def read_snapshot_csv(spark: SparkSession, path: str, schema: T.StructType,
                      index_col: str | None = "_c0") -> DataFrame:
    """Header CSV, first column an index, ``nan`` = missing.

    Explicit schema (no inference pass over 100 TB); ``nan`` parses to NaN
    and is turned into null, which is what the rest of the library means
    by missing.
    """
    df = (spark.read.schema(schema).option("header", True).option("nanValue", "nan")
          .option("mode", "FAILFAST").csv(path))
    if index_col:
        df = df.drop(index_col)
    return nan_to_null(df)


def write_snapshot_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Snapshot CSV as the source files have it: index column first, missing as ``nan``."""
    out = df.select(F.monotonically_increasing_id().alias("_c0"), *df.columns)
    w = out.write.mode("overwrite").option("header", True).option("nullValue", "nan")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def numbered_files(spark: SparkSession, folder: str) -> dict[int, list[str]]:
    """Files (or folders of files) of ``folder`` by the last number in their name:
    ``stats2.csv`` comes before ``stats10.csv``.  Names without a number are left out."""
    if not path_exists(spark, folder):
        return {}
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    found: dict[int, list[str]] = {}
    for f in at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at):
        name = f.getPath().getName()
        number = re.search(r"(\d+)(?!.*\d)", name)
        if number and name[0] not in "._":
            found.setdefault(int(number[1]), []).append(f.getPath().toString())
    return found


def read_numbered_files(spark: SparkSession, folder: str, schema: T.StructType, which: str = "all",
                        number_col: str | None = None) -> DataFrame:
    """The files of ``folder``, ``which``: all of them, the one with the
    highest number (``latest``, the live input) or the others (``older``, for training).

    The highest number comes from the listing, so only wanted files are read.  An
    empty folder is an empty table; a value that does not parse raises, as for any
    other snapshot file.  ``number_col`` adds the file's number.
    """
    found = numbered_files(spark, folder)
    last = max(found, default=None)
    take = {n: p for n, p in found.items() if which == "all" or (n == last) == (which == "latest")}
    fields = [f for f in schema if f.name != "_c0"]
    empty = T.StructType([*fields, *([T.StructField(number_col, T.LongType())] if number_col else [])])
    paths = [p for some in take.values() for p in some]
    if not paths:
        return spark.createDataFrame([], empty)
    df = (spark.read.schema(schema).option("header", True).option("nanValue", "nan")
          .option("mode", "FAILFAST").csv(paths))
    if number_col:
        own = F.regexp_extract("_metadata.file_path", r"^(?:.*/)?" + _tail(folder) + r"/([^/]*)", 1)
        df = df.select(*df.columns, F.regexp_extract(own, r"(\d+)\D*$", 1).cast("long").alias(number_col))
    return nan_to_null(df.drop("_c0"))


def _tail(folder: str) -> str:
    return re.escape(folder.rstrip("/").rsplit("/", 1)[-1])


def union_sources(api: DataFrame, scraped: DataFrame) -> DataFrame:
    """Align by name; columns the API side lacks become null."""
    return api.unionByName(scraped, allowMissingColumns=True)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Processed table as parquet."""
    df.write.mode(mode).parquet(path)


def with_open_outcome(df: DataFrame) -> DataFrame:
    """Snapshots are saved before the match ends: final scores null."""
    return df.withColumns({"home_final_score": F.lit(None).cast("int"),
                           "away_final_score": F.lit(None).cast("int")})


def saved_match_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``match`` table as the live loop leaves it: finished (training)
    matches with outcomes, live matches appended with open outcomes."""
    h = fx.hist(spark, sf_dir).drop(*fx.MODEL_OUTPUT)
    lv = with_open_outcome(fx.live(spark, sf_dir).drop(*fx.MODEL_OUTPUT))
    return h.unionByName(lv)


def fixture_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per fixture, the status and goals an API would report now.

    A fixture whose snapshots reach minute 85 is reported finished.
    """
    return (fx.live(spark, sf_dir).groupBy("fixture_id").agg(
        F.when(F.max("minute") >= 85, F.lit(FINISHED_STATUS)).otherwise(F.lit("Second Half"))
         .alias("status"),
        F.max("home_final_score").alias("goalsHomeTeam"),
        F.max("away_final_score").alias("goalsAwayTeam")))


def backfill_outcomes(saved: DataFrame, results: DataFrame) -> DataFrame:
    """A fixture with an open outcome whose result is 'Match Finished'
    gets both final scores on all of its snapshots; a new table version.

    Open snapshots meet the finished results (one row per fixture).  Of the others only
    those of a fixture that has open ones too are filled in; these fixtures, few or none,
    are stored, so the join of the other snapshots is planned from their measured size.
    """
    opened, others = (saved.where(c) for c in (F.col("home_final_score").isNull(), F.col("home_final_score").isNotNull()))
    done = (results.where(F.col("status") == FINISHED_STATUS)
                   .select(F.col("fixture_id").alias("__fid"),
                           F.col("goalsHomeTeam").alias("__h"), F.col("goalsAwayTeam").alias("__a")))
    both = (opened.select(F.col("fixture_id").alias("__fid")).distinct()
                  .join(others.select(F.col("fixture_id").alias("__fid")).distinct(), "__fid", "left_semi"))
    partly = materialize(done.join(both, "__fid", "left_semi"), "partly-open")
    fill = F.col("__fid").isNotNull()

    def filled(rows: DataFrame, by: DataFrame) -> DataFrame:
        j = lookup_join(rows, by, ["fixture_id"], ["__fid"], "left")
        return j.select(*[F.when(fill, F.col("__h")).otherwise(F.col(c)).cast("int").alias(c)
                          if c == "home_final_score" else
                          F.when(fill, F.col("__a")).otherwise(F.col(c)).cast("int").alias(c)
                          if c == "away_final_score" else F.col(c)
                          for c in saved.columns])

    return filled(opened, done).unionByName(filled(others, partly))


#: Column of the stored match table that its folders are named by: the month of the match.
MONTH = "match_month"
#: Folders that a task writes to at once; a task with more of them sorts its rows by folder first.
OPEN_FOLDERS = "100"


@contextmanager
def unsorted_folders(spark: SparkSession):
    """Tasks keep a file open for each folder, so whole rows are not sorted, and spilled, to write them by month."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    held = spark.conf.get(name)
    spark.conf.set(name, OPEN_FOLDERS)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def store_matches(df: DataFrame, path: str, mode: str = "append") -> None:
    """Snapshots into the stored match table, a folder for each month."""
    month = F.coalesce(F.substring("match_date", 1, 7), F.lit("unknown"))
    with unsorted_folders(df.sparkSession):
        df.withColumn(MONTH, month).write.mode(mode).partitionBy(MONTH).parquet(path)


def backfill_stored(spark: SparkSession, path: str, results: DataFrame) -> list[str]:
    """S13 on the stored table: only folders in which a finished fixture is open are read as a whole
    and written anew; the files of all others stay as they are.  Returns the months written.

    The new rows lie in the shared folder before any folder is replaced, and filling
    in is repeatable, so a run that stopped is made good by running it again.
    """
    saved = spark.read.parquet(path)
    results = materialize(results.where(F.col("status") == FINISHED_STATUS), "finished")  # asked for several times below
    done = results.select(F.col("fixture_id").alias("__fid"))
    opened = saved.where(F.col("home_final_score").isNull()).select("fixture_id", MONTH)
    months = [r[0] for r in lookup_join(opened, done, ["fixture_id"], ["__fid"], "left_semi").select(MONTH).distinct().collect()]  # one a folder at most
    if months:
        new = materialize(backfill_outcomes(saved.where(F.col(MONTH).isin(months)), results), "backfill")
        with unsorted_folders(spark):
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    return sorted(months)

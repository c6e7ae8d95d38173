"""Files of a panel project: typed reads, partitioned writes, versioned upserts, search.

Nothing here lists or opens files by local paths; all goes through Spark's file systems."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import upsert
from .tables import nan_to_null

#: Longest strings by which paths are looked up.
GRAM = 3


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Runs SQL over the session's views and the given frames; nothing is fetched."""
    return spark.sql(sql, **tables)


def vendor_query(spark: SparkSession, url: str, sql: str, **options: str) -> DataFrame:
    """A vendor database's answer to a query, read when it is used."""
    return spark.read.format("jdbc").options(url=url, query=sql, **options).load()


def columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names under a folder, on whatever file system it is; empty if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def search(names: Sequence[str], wanted: str) -> list[str]:
    """Exact names, else those with that stem, else those that contain it."""
    stem = lambda n: PurePosixPath(n).stem
    for test in (lambda n: n == wanted, lambda n: stem(n) == stem(wanted), lambda n: stem(wanted).lower() in n.lower()):
        found = [n for n in names if test(n)]
        if found:
            return found
    return []


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, bytes, modified of all files below a folder, from the file source's metadata: no content is
    read. ``pattern``: a glob that names must match. The file source passes over empty files, so they are not listed."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    return found.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def _named(df: DataFrame, column: str, name: str, stem: str) -> DataFrame:
    """df with the last part of a path, and that less its extension."""
    own = F.substring_index(F.rtrim(F.col(column), F.lit("/")), "/", -1)
    cut = F.regexp_extract(own, r"^(.+)\.[^.]+$", 1)
    return df.withColumn(name, own).withColumn(stem, F.when(cut != "", cut).otherwise(own))


def _grams(text: Column) -> Column:
    """The distinct strings of up to GRAM characters within a text."""

    def of(n: int) -> Column:
        long = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(text, k, F.lit(n)))
        return F.when(F.length(text) >= n, long).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(of, range(1, GRAM + 1))))


def search_all(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """query, within, path, rank: for each row of wanted (query, within) the paths of the catalog whose name
    is the query's (rank 1); if there are none, those with its stem (2); if none, those that contain
    it (3). Of these only paths below a folder of the name ``within``, if that is not null.

    Containment joins on a query's string of up to GRAM characters that is in the fewest paths, then
    looks at the whole. All sides grow with the catalog, and the optimiser takes strings cut from a path for
    no more than the path, so the joins are told to sort both sides: none is sent through the driver. Defined cases: a null or empty query finds nothing; repeated rows count once."""
    asked = _named(wanted.select("query", "within").where("query <> ''").distinct(), "query", "_name", "_stem")
    held = _named(catalog.select("path").where("path is not null").distinct(), "path", "name", "stem")
    by_name = asked.join(held.hint("merge"), F.col("_name") == F.col("name"), "left_semi").select("query")
    first = asked.join(held.select("path", "name").hint("merge"), F.col("_name") == F.col("name")).withColumn("rank", F.lit(1))
    rest = asked.join(by_name.distinct().hint("merge"), "query", "left_anti")
    by_stem = rest.join(held.hint("merge"), F.col("_stem") == F.col("stem"), "left_semi").select("query")
    second = rest.join(held.select("path", "stem").hint("merge"), F.col("_stem") == F.col("stem")).withColumn("rank", F.lit(2))
    rest = rest.join(by_stem.distinct().hint("merge"), "query", "left_anti").select("query", "within")
    pieces = held.select("path", F.explode(_grams(F.col("path"))).alias("gram"))
    length = F.least(F.length("query"), F.lit(GRAM))
    keys = rest.select("query", F.explode(F.filter(_grams(F.col("query")), lambda g: F.length(g) == length)).alias("gram")).distinct()
    often = pieces.join(keys.select("gram").distinct().hint("merge"), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # a query with a gram that no path has is contained in none
    rare = keys.join(often.hint("merge"), "gram", "left").groupBy("query").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g")).where("g.n > 0")
    third = rare.select("query", F.col("g.gram").alias("gram")).join(pieces.hint("merge"), "gram").where(F.contains("path", "query")).select("query", "path")
    third = rest.join(third.hint("merge"), "query").withColumn("rank", F.lit(3))
    columns = ["query", "within", "path", "rank"]
    found = first.select(columns).unionByName(second.select(columns)).unionByName(third.select(columns))
    folders = F.slice(F.split(F.rtrim(F.col("path"), F.lit("/")), "/"), 1, F.greatest(F.size(F.split(F.rtrim(F.col("path"), F.lit("/")), "/")) - 1, F.lit(0)))
    return found.where(F.col("within").isNull() | F.array_contains(folders, F.col("within")))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet, CSV (with header) or JSON by extension; NaN becomes NULL. CSV and JSON need a schema,
    so that a file is read once. A missing path names its neighbours."""
    kind = PurePosixPath(path).suffix.lstrip(".") or "parquet"
    if kind not in ("parquet", "csv", "json"):
        raise ValueError(f"cannot read files of type {kind!r}")
    if kind != "parquet" and schema is None:
        raise ValueError(f"a {kind} file needs a schema")
    folder, _, name = path.rpartition("/")
    near = listing(spark, folder or ".")
    if name not in near:
        raise FileNotFoundError(f"{path} is not there; similar: {search(near, name)}")
    reader = spark.read.schema(schema) if schema else spark.read
    return nan_to_null(reader.csv(path, header=True) if kind == "csv" else reader.format(kind).load(path))


def write(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, one folder a value of ``by`` (sampling_date, year); rows of a value meet in few files."""
    out = df.repartition(*by) if by else df
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if by else "static")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, under spark.checkpoint.dir or else the warehouse;
    its file system deletes it when the program ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return p.toString()


def latest(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """Number and frame of the newest complete version of a stored table."""
    done = [int(n.split("=")[1]) for n in listing(spark, path) if n.startswith("version=") and "_SUCCESS" in listing(spark, f"{path}/{n}")]
    return (max(done), spark.read.parquet(f"{path}/version={max(done)}")) if done else (0, None)


def store(df: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Upserts df's columns into the stored table and returns the new version. Each version is
    a folder of its own, so readers of the old one are not disturbed and a lost job leaves
    nothing that would be read."""
    number, old = latest(df.sparkSession, path)
    new = df.na.drop("all", subset=[c for c in df.columns if c not in keys]) if old is None else upsert(old, df, keys)
    new.write.mode("overwrite").parquet(f"{path}/version={number + 1}")
    return df.sparkSession.read.parquet(f"{path}/version={number + 1}")


def combined(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The union of frames with unlike columns, without rows that agree in keys and values."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.dropDuplicates().orderBy(*keys)


def percent_factors(df: DataFrame, date: str = "date") -> DataFrame:
    """Factor files quote percent."""
    return df.select(date, *[(F.col(c) / 100).alias(c) for c in df.columns if c != date])


def dated(df: DataFrame, raw: str, pattern: str = "yyyyMMdd") -> DataFrame:
    """The column as a date; text that is no date becomes NULL."""
    return df.withColumn(raw, F.try_to_timestamp(F.col(raw).cast("string"), F.lit(pattern)).cast("date"))

"""Databases and snapshots. A mutation is a pure step from a state to the next; a snapshot is a new version of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.config import DEFAULT_DATABASE
from tessera.plans.session import settle

#: Tables whose rows go with their database; the last two only on request.
CASCADE = ("connections", "concepts", "chunks", "ingest_events")
CASCADE_FULL = (*CASCADE, "co_access_events", "associative_memory")


def create_database(catalog: DataFrame, name: str, as_of: Column, description: str | None = None) -> DataFrame:
    """The catalog with a new database `db_<name>`; the name is stripped and must be new and not empty."""
    name = name.strip()
    if not name:
        raise ValueError("a database needs a name")
    if catalog.where(F.col("name") == name).limit(1).count():
        raise ValueError(f"there is a database named {name}")
    one = catalog.sparkSession.range(1).select(F.lit(f"db_{name}").alias("id"), F.lit(name).alias("name"), F.unix_timestamp(as_of).alias("created_at"), F.lit(description).cast("string").alias("description"), F.lit("{}").alias("config_json"))
    return catalog.unionByName(one)


def delete_database(catalog: DataFrame, tables: dict[str, DataFrame], database: str, full: bool = False) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Catalog and tables without a database. The default one can't be deleted; events of co-access and models go only with `full`."""
    if database == DEFAULT_DATABASE:
        raise ValueError("the default database can't be deleted")
    gone = CASCADE_FULL if full else CASCADE
    return catalog.where(F.col("id") != database), {n: df.where(F.coalesce("database_id", F.lit("")) != database) if n in gone else df for n, df in tables.items()}


def backfill(df: DataFrame) -> DataFrame:
    """Null and empty database ids become the default one."""
    return df.withColumn("database_id", F.coalesce(F.nullif(F.col("database_id"), F.lit("")), F.lit(DEFAULT_DATABASE)))


def evolve(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Add the columns of `schema` that are missing, with their defaults; columns that are there stay as they are."""
    have = set(df.columns)
    return df.withColumns({f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in schema.fields if f.name not in have})


def check_dimensions(df: DataFrame, column: str, dims: int) -> DataFrame:
    """Rows pass through; a vector of another length ends the job."""
    return df.withColumn(column, F.when(F.col(column).isNull() | (F.size(column) == dims), F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dims} numbers is needed, this one has "), F.size(column).cast("string")))))


class Snapshots:
    """Versioned tables under a folder: whole states `<root>/<name>/v=<n>` and additions `<root>/<name>/d=<n>`.

    A table is its last whole state and the additions after it; readers see only what was
    written to the end. An addition costs what it adds, not what is there.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        settle(spark)
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):  # noqa: ANN202
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _parts(self, name: str) -> list[tuple[int, str]]:
        """(number, kind) of what was written to the end, in order."""
        fs, path = self._fs()
        base = path(f"{self.root}/{name}")
        if not fs.exists(base):
            return []
        names = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(base)]
        return sorted((int(n[2:]), n[0]) for n, full in names if n[:2] in ("v=", "d=") and fs.exists(path(f"{full}/_SUCCESS")))

    def version(self, name: str) -> int:
        return max((n for n, _ in self._parts(name)), default=0)

    def additions(self, name: str) -> int:
        """How many additions follow the last whole state."""
        parts = self._parts(name)
        whole = max((n for n, k in parts if k == "v"), default=0)
        return sum(1 for n, k in parts if k == "d" and n > whole)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        parts = [p for p in self._parts(name) if version is None or p[0] <= version]
        whole = max((n for n, k in parts if k == "v"), default=None)
        if whole is None:
            raise FileNotFoundError(f"no version of {name}")
        paths = [f"{self.root}/{name}/{k}={n}" for n, k in parts if n >= whole]
        # every part has the schema of the whole state
        schema = self.spark.read.parquet(paths[0]).schema
        df = self.spark.read.schema(schema).parquet(paths[0])
        for p in paths[1:]:
            df = df.unionByName(self.spark.read.schema(schema).parquet(p))
        return df

    def write(self, name: str, df: DataFrame, partition_by: str | None = None) -> int:
        """Write the next whole state; the parts before stay, so `df` may read from them."""
        n = self.version(name) + 1
        out = df.write.mode("overwrite")
        (out.partitionBy(partition_by) if partition_by else out).parquet(f"{self.root}/{name}/v={n}")
        return n

    def append(self, name: str, df: DataFrame) -> int:
        """Add rows; returns how many."""
        at = f"{self.root}/{name}/d={self.version(name) + 1}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at).count()

    def vacuum(self, name: str, keep: int = 10) -> None:
        """Remove what is older than the last whole state and all but the last `keep` versions."""
        fs, path = self._fs()
        parts = self._parts(name)
        whole = max((n for n, k in parts if k == "v"), default=0)
        last = self.version(name)
        for n, k in parts:
            if n < whole and n <= last - keep:
                fs.delete(path(f"{self.root}/{name}/{k}={n}"), True)

"""Names of tables and the DataFrames behind them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from treeline.errors import ResolverError

Loader = Callable[[], DataFrame]


class Catalog:
    """Tables by name; a loader is called once, when its table is first read."""

    def __init__(self, tables: Mapping[str, DataFrame | Loader] | None = None):
        self._tables: dict[str, DataFrame | Loader] = dict(tables or {})

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def names(self) -> list[str]:
        return sorted(self._tables)

    def add(self, name: str, table: DataFrame | Loader) -> Catalog:
        self._tables[name] = table
        return self

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            raise ResolverError(f"no source has the table '{name}'")
        got = self._tables[name]
        if not isinstance(got, DataFrame):
            got = self._tables[name] = got()
        return got

    @classmethod
    def files(cls, spark: SparkSession, folder: str, names: list[str], form: str = "parquet", suffix: str | None = None, **options: str) -> Catalog:
        """``folder/name.form`` for each name, by any of Spark's readers."""
        end = f".{form}" if suffix is None else suffix
        load = lambda name: lambda: spark.read.format(form).options(**options).load(f"{folder.rstrip('/')}/{name}{end}")
        return cls({n: load(n) for n in names})

    @classmethod
    def tables(cls, spark: SparkSession, names: list[str], database: str | None = None) -> Catalog:
        """Tables or views of the session's catalog."""
        load = lambda name: lambda: spark.table(f"{database}.{name}" if database else name)
        return cls({n: load(n) for n in names})

    @classmethod
    def jdbc(cls, spark: SparkSession, url: str, names: list[str], partition: Mapping[str, tuple[str, int, int, int]] | None = None, **properties: str) -> Catalog:
        """Tables of a database; ``partition``: by table the column, bounds and number of parallel reads."""

        def load(name: str) -> Loader:
            def read() -> DataFrame:
                if name in (partition or {}):
                    column, low, high, count = partition[name]
                    return spark.read.jdbc(url, name, column=column, lowerBound=low, upperBound=high, numPartitions=count, properties=properties)
                return spark.read.jdbc(url, name, properties=properties)

            return read

        return cls({n: load(n) for n in names})

    @classmethod
    def blobs(cls, spark: SparkSession, folder: str, name: str = "uploads", pattern: str = "*") -> Catalog:
        """Stored files as rows (path, modificationTime, length, content)."""
        return cls({name: lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)})


class Federation(Catalog):
    """Several services' catalogs as one: a join across them is an ordinary join."""

    def __init__(self, services: Mapping[str, Catalog], routes: Mapping[str, str] | None = None):
        """``routes``: the service of a table, where several have it."""
        super().__init__()
        self.services, self.routes = dict(services), dict(routes or {})

    def service(self, name: str) -> str:
        if name in self.routes:
            return self.routes[name]
        owners = [s for s, c in self.services.items() if name in c]
        if len(owners) != 1:
            raise ResolverError(f"table '{name}' is in {len(owners)} services; name one in routes" if owners else f"no service has the table '{name}'")
        return owners[0]

    def __contains__(self, name: str) -> bool:
        return name in self.routes or any(name in c for c in self.services.values())

    def names(self) -> list[str]:
        return sorted({n for c in self.services.values() for n in c.names()})

    def table(self, name: str) -> DataFrame:
        return self.services[self.service(name)].table(name)


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """The sink: nested results as files (Parquet, ORC and JSON keep structs and arrays)."""
    out = df.write.format(form).mode(mode).options(**options)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)

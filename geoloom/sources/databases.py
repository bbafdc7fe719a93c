"""Tables of SQLite files as a data source of Spark: read by ranges of their row ids, with comparisons pushed into the query.

The file must lie where all executors read it under the same path; it is opened read-only.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_PLAIN = (int, float, str)


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path.removeprefix('file://'))}?mode=ro", uri=True)


def _named(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> str:
    """The type that a column's declaration stands for."""
    d = declared.upper()
    if "BOOL" in d:
        return "boolean"
    if "INT" in d:
        return "long"
    if any(w in d for w in ("REAL", "FLOA", "DOUB", "NUMERIC", "DECIMAL")):
        return "double"
    return "binary" if "BLOB" in d else "string"


def columns_of(path: str, table: str) -> list[tuple[str, str]]:
    """(name, type) of a table's columns; a table that isn't there is an error."""
    with _connect(path) as c:
        found = c.execute(f"PRAGMA table_info({_named(table)})").fetchall()
    if not found:
        raise ValueError(f"no table {table} in {path}")
    return [(name, spark_type(kind)) for _, name, kind, *_ in found]


class Range(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class TableReader(DataSourceReader):
    def __init__(self, options, schema: StructType) -> None:
        self.path, self.table, self.n = options["path"], options["dbtable"], int(options.get("numpartitions", "4"))
        self.kinds = {f.name: f.dataType.simpleString() for f in schema}
        self.where: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802  (Spark's name)
        for f in filters:
            made = self._sql(f)
            if made is None:
                yield f
            else:
                self.where.append(made)

    def _sql(self, f: Filter) -> tuple[str, list] | None:
        """A condition and its values, where SQLite compares as Spark does: numbers with numbers, texts for equality."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name not in self.kinds:
            return None
        if isinstance(f, (IsNull, IsNotNull)):
            return f"{_named(name)} IS {'NOT ' * isinstance(f, IsNotNull)}NULL", []
        number = self.kinds[name] in ("bigint", "double")
        fits = lambda v: isinstance(v, _PLAIN) and not isinstance(v, bool) and (isinstance(v, str) != number)
        if isinstance(f, In) and all(map(fits, f.value)):
            return f"{_named(name)} IN ({', '.join('?' * len(f.value))})", list(f.value)
        if type(f) in _SIGNS and fits(f.value) and (number or isinstance(f, EqualTo)):
            return f"{_named(name)} {_SIGNS[type(f)]} ?", [f.value]
        return None

    def partitions(self) -> list[InputPartition]:
        with _connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_named(self.table)}").fetchone()
        if low is None:
            return [Range(0, -1)]
        n = max(1, min(self.n, high - low + 1))
        ends = [low + (high - low + 1) * i // n for i in range(n + 1)]
        return [Range(a, b - 1) for a, b in zip(ends, ends[1:], strict=False)]

    def read(self, partition: Range) -> Iterator[tuple]:
        conditions = "".join(f" AND {c}" for c, _ in self.where)
        values = [v for _, vs in self.where for v in vs]
        sql = f"SELECT {', '.join(map(_named, self.kinds))} FROM {_named(self.table)} WHERE rowid BETWEEN ? AND ?{conditions}"
        casts = [{"boolean": lambda v: bool(v), "double": float, "bigint": int, "string": str, "binary": bytes}[k] for k in self.kinds.values()]
        connection = _connect(self.path)
        try:
            for row in connection.execute(sql, [partition.low, partition.high, *values]):
                yield tuple(None if v is None else cast(v) for v, cast in zip(row, casts, strict=True))
        finally:
            connection.close()


class SqliteTable(DataSource):
    """format("sqlite_table"): options path, dbtable and numPartitions. The columns are all of the table's, or those of a schema given."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        return ", ".join(f"`{name.replace('`', '``')}` {kind}" for name, kind in columns_of(self.options["path"], self.options["dbtable"]))

    def reader(self, schema: StructType) -> TableReader:
        return TableReader(self.options, schema)


def table(spark: SparkSession, path: str, name: str, *, partitions: int = 4, columns: list[str] | None = None) -> DataFrame:
    """A table of a SQLite file, of which only the columns asked for are read. Values that don't fit their column's declared type are an error."""
    spark.dataSource.register(SqliteTable)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("sqlite_table").option("path", path).option("dbtable", name).option("numPartitions", str(partitions))
    if columns is not None:
        kinds = dict(columns_of(path, name))
        reader = reader.schema(", ".join(f"`{c.replace('`', '``')}` {kinds[c]}" for c in columns))
    return reader.load()

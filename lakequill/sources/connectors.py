"""Connectors: connection strings, JDBC sources of the three databases, and catalogs as sources."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import parse_qsl, quote, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigurationError, ConnectionFailed

#: Schemes, their JDBC drivers and ports.
DRIVERS = {
    "sqlite": ("org.sqlite.JDBC", None), "postgres": ("org.postgresql.Driver", 5432), "postgresql": ("org.postgresql.Driver", 5432), "mysql": ("com.mysql.cj.jdbc.Driver", 3306),
}
_ADO_NAMES = {
    "server": "host", "host": "host", "data source": "host", "datasource": "host", "port": "port", "database": "database", "initial catalog": "database",
    "user id": "user", "uid": "user", "user": "user", "username": "user", "password": "password", "pwd": "password",
}


@dataclass
class ConnectionString:
    """Parts of a connection string in URL form (``postgres://user:pw@host/db``) or as ``Key=Value;...``."""

    scheme: str
    host: str = ""
    port: int | None = None
    database: str = ""
    user: str = ""
    password: str = ""
    options: dict[str, str] = field(default_factory=dict)

    @classmethod
    def parse(cls, text: str) -> ConnectionString:
        if text.startswith("sqlite:"):
            path, _, query = text.removeprefix("sqlite:").removeprefix("//").partition("?")
            return cls("sqlite", database=path or ":memory:", options=dict(parse_qsl(query)))
        parts = urlsplit(text)
        if parts.scheme not in DRIVERS:
            raise ConfigurationError(f"unknown scheme {parts.scheme!r}")
        try:
            port = parts.port
        except ValueError as error:
            raise ConfigurationError("bad port") from error
        return cls(parts.scheme, unquote(parts.hostname or ""), port, unquote(parts.path.lstrip("/")), unquote(parts.username or ""), unquote(parts.password or ""), dict(parse_qsl(parts.query)))

    @classmethod
    def parse_ado(cls, text: str, scheme: str = "postgres") -> ConnectionString:
        found = cls(scheme)
        for key, quoted, plain in re.findall(r"\s*([^=;]+?)\s*=\s*(?:\"([^\"]*)\"|([^;]*))\s*(?:;|$)", text):
            name, value = _ADO_NAMES.get(key.lower()), quoted or plain.strip()
            if name == "port":
                found.port = int(value)
            elif name:
                setattr(found, name, value)
            else:
                found.options[key] = value
        return found

    @classmethod
    def parse_auto(cls, text: str) -> ConnectionString:
        return cls.parse(text) if re.match(r"[a-z]+:", text) else cls.parse_ado(text)

    def validate(self) -> ConnectionString:
        if self.scheme != "sqlite" and not self.host:
            raise ConfigurationError("no host")
        if not self.database:
            raise ConfigurationError("no database")
        return self

    def build(self) -> str:
        if self.scheme == "sqlite":
            return f"sqlite:{self.database}"
        login = quote(self.user, safe="") + (f":{quote(self.password, safe='')}" if self.password else "") + "@" if self.user else ""
        options = "?" + "&".join(f"{k}={v}" for k, v in self.options.items()) if self.options else ""
        return f"{self.scheme}://{login}{self.host}{f':{self.port}' if self.port else ''}/{quote(self.database)}{options}"

    def jdbc_url(self) -> str:
        if self.scheme == "sqlite":
            return f"jdbc:sqlite:{self.database}"
        scheme = "postgresql" if self.scheme.startswith("postgres") else self.scheme
        return f"jdbc:{scheme}://{self.host}:{self.port or DRIVERS[self.scheme][1]}/{self.database}"

    def redacted(self) -> str:
        return ConnectionString(self.scheme, self.host, self.port, self.database, self.user, "***" if self.password else "", self.options).build()


def read_jdbc(
    spark: SparkSession, connection: str | ConnectionString, table: str, *, partition_column: str | None = None, bounds: tuple[int, int] | None = None,
    partitions: int = 1, fetch_size: int = 10_000, **options: str,
) -> DataFrame:
    """A database table as a DataFrame. With a partition column and its bounds it is read by several tasks; filters and columns are pushed down."""
    found = (ConnectionString.parse_auto(connection) if isinstance(connection, str) else connection).validate()
    driver = DRIVERS[found.scheme][0]
    reader = spark.read.format("jdbc").options(url=found.jdbc_url(), dbtable=table, driver=driver, fetchsize=str(fetch_size), **options)
    if found.user:
        reader = reader.options(user=found.user, password=found.password)
    if partition_column:
        if bounds is None:
            raise ConfigurationError("a partition column needs bounds")
        reader = reader.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions))
    try:
        return reader.load()
    except Exception as error:
        if "ClassNotFoundException" in str(error):
            raise ConnectionFailed(f"the JDBC driver {driver} is not on the class path") from error
        raise


def read_table(spark: SparkSession, path: str, format: str = "parquet", **options: str) -> DataFrame:
    """Files of any format Spark reads."""
    return spark.read.format(format).options(**options).load(path)

"""Reader options for stores kept in a relational database."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

_DRIVERS = {"mysql": "com.mysql.cj.jdbc.Driver", "postgres": "org.postgresql.Driver", "sqlite": "org.sqlite.JDBC"}
_PORTS = {"mysql": 3306, "postgres": 5432}
# Defaults of the connection settings (fixed values).
_DEFAULTS = {"DATABASE_CLIENT": "sqlite", "DATABASE_HOST": "localhost", "DATABASE_NAME": "strapi",
             "DATABASE_USERNAME": "strapi", "DATABASE_PASSWORD": "strapi", "DATABASE_SCHEMA": "public",
             "DATABASE_FILENAME": ".tmp/data.db"}


def _flag(value: object, default: bool) -> bool:
    return default if value is None else str(value).lower() in ("true", "1")


def jdbc_options(cfg: Mapping[str, str]) -> dict[str, str]:
    """Spark JDBC options for the mysql, postgres or sqlite settings in `cfg`."""
    get = {**_DEFAULTS, **{k: v for k, v in cfg.items() if v is not None}}.get
    client = get("DATABASE_CLIENT")
    if client not in _DRIVERS:
        raise ValueError(f"unknown database client: {client}")
    options = {"driver": _DRIVERS[client]}
    if client == "sqlite":
        return {**options, "url": f"jdbc:sqlite:{get('DATABASE_FILENAME')}"}

    options |= {"user": get("DATABASE_USERNAME"), "password": get("DATABASE_PASSWORD")}
    address = f"{get('DATABASE_HOST')}:{get('DATABASE_PORT', _PORTS[client])}/{get('DATABASE_NAME')}"
    ssl, verify = _flag(get("DATABASE_SSL"), False), _flag(get("DATABASE_SSL_REJECT_UNAUTHORIZED"), True)
    if client == "mysql":
        options["url"] = f"jdbc:mysql://{address}"
        options["sslMode"] = ("VERIFY_CA" if verify else "REQUIRED") if ssl else "DISABLED"
        files = {"DATABASE_SSL_CA": "trustCertificateKeyStoreUrl", "DATABASE_SSL_CERT": "clientCertificateKeyStoreUrl"}
    else:
        whole = get("DATABASE_URL")
        options["url"] = f"jdbc:postgresql://{address}"
        if whole:
            rest = whole.split("://", 1)[-1]
            options["url"] = f"jdbc:postgresql://{rest.rsplit('@', 1)[-1]}"
            if "@" in rest:
                user, _, password = rest.rsplit("@", 1)[0].partition(":")
                options |= {"user": user, "password": password}
        options["currentSchema"] = get("DATABASE_SCHEMA")
        options["sslmode"] = ("verify-ca" if verify else "require") if ssl else "disable"
        files = {"DATABASE_SSL_CA": "sslrootcert", "DATABASE_SSL_CERT": "sslcert", "DATABASE_SSL_KEY": "sslkey"}
    if ssl:
        options |= {option: get(key) for key, option in files.items() if get(key)}
    return options


def read_table(spark: SparkSession, cfg: Mapping[str, str], table: str, partition_column: str = "id",
               bounds: tuple[int, int] | None = None, partitions: int = 64) -> DataFrame:
    """Read a stored table; with `bounds` of the id, in parallel ranges."""
    reader = spark.read.format("jdbc").options(**jdbc_options(cfg), dbtable=table)
    if bounds:
        reader = reader.options(partitionColumn=partition_column, lowerBound=bounds[0],
                                upperBound=bounds[1], numPartitions=partitions)
    return reader.load()

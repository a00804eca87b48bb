"""The planning entities, derived from the star-schema tables by integer arithmetic.

Each is a table, expressions that both Spark SQL and other engines read the
same way, and a condition; so one definition serves queries and their SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _x(k: str, a: int) -> str:
    return f"CAST(({k} * 7919 + {a}) % 10007 AS DOUBLE)"


def _y(k: str, b: int) -> str:
    return f"CAST(({k} * 104729 + {b}) % 10009 AS DOUBLE)"


def _lon(k: str, a: int) -> str:
    return f"-79.25e0 + {_x(k, a)} / 10007e0 * 0.35e0"


def _lat(k: str, b: int) -> str:
    return f"35.85e0 + {_y(k, b)} / 10009e0 * 0.25e0"


def _coords(k: str, a: int, b: int, p: str = "") -> list[str]:
    return [f"{_lon(k, a)} AS {p}lon", f"{_lat(k, b)} AS {p}lat", f"{_x(k, a)} AS {p}x", f"{_y(k, b)} AS {p}y"]


#: Fourteen classes of roads and four that have no weight.
ROAD_CLASSES = (
    "motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service", "unclassified", "living_street",
    "motorway_link", "trunk_link", "primary_link", "secondary_link", "tertiary_link", "footway", "path", "steps", "track",
)
SERVICES = ("driveway", "parking_aisle", "alley", "drive-through", "")


def _pick(n: str, values: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN {n} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


ENTITIES: dict[str, tuple[str, list[str], str]] = {
    "site": ("supplier", ["s_suppkey AS site", "s_name AS site_name", *_coords("s_suppkey", 13, 17, "site_")], "s_suppkey < 11"),
    "facility": ("customer", ["c_custkey AS facility", "c_acctbal AS capacity", "c_mktsegment AS kind", "CAST(c_nationkey AS BIGINT) AS nation", *_coords("c_custkey", 0, 0)], "true"),
    "sale": ("orders", ["o_orderkey AS sale", "o_custkey AS facility", "o_totalprice AS price", "o_orderdate AS sold", *_coords("o_custkey", 0, 0)], "true"),
    "development": ("part", ["p_partkey AS development", "CAST(p_size AS BIGINT) AS units", "CAST(floor(p_size / 5e0) AS BIGINT) AS students", *_coords("p_partkey", 5, 7)], "true"),
    "block_group": ("nation", [
        "CAST(n_nationkey AS BIGINT) AS bg", "n_name AS name",
        "CAST((n_nationkey % 5) * 2000 AS DOUBLE) AS x1", "CAST(floor(n_nationkey / 5e0) * 2000 AS DOUBLE) AS y1",
        "CAST((n_nationkey % 5) * 2000 + 2000 AS DOUBLE) AS x2", "CAST(floor(n_nationkey / 5e0) * 2000 + 2000 AS DOUBLE) AS y2",
    ], "true"),
    "zone": ("region", [
        "CAST(r_regionkey AS BIGINT) AS zone", "r_name AS zone_name",
        "CAST(r_regionkey * 1900 + 300 AS DOUBLE) AS x1", "CAST(500 AS DOUBLE) AS y1", "CAST(r_regionkey * 1900 + 2200 AS DOUBLE) AS x2", "CAST(9700 AS DOUBLE) AS y2",
    ], "true"),
    "parcel": ("part", [
        "p_partkey AS parcel", f"{_x('p_partkey', 1)} AS x1", f"{_y('p_partkey', 2)} AS y1", f"{_x('p_partkey', 1)} + p_size AS x2", f"{_y('p_partkey', 2)} + p_size AS y2",
        "CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN '110-A' WHEN p_partkey % 3 = 1 THEN 'EXHA' ELSE '200' END AS luc",
        "CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'Improved - ' || p_brand ELSE 'Vacant' END AS imp_vac", "p_retailprice AS value",
    ], "true"),
    "road": ("part", [
        "p_partkey AS road", f"{_pick('p_partkey % 18', ROAD_CLASSES)} AS class", f"{_pick('p_partkey % 5', SERVICES)} AS service",
        f"{_x('p_partkey', 3)} AS ax", f"{_y('p_partkey', 4)} AS ay", f"{_x('p_partkey', 3)} + 40 + p_size * 4 AS ex", f"{_y('p_partkey', 4)} + 30 AS ey",
    ], "true"),
    "station": ("supplier", [
        "s_suppkey AS station", f"{_x('s_suppkey', 19)} AS x", f"{_y('s_suppkey', 23)} AS y",
        "CASE s_suppkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN '0' WHEN 2 THEN '12,' || CAST(100 + s_suppkey % 900 AS VARCHAR(9)) ELSE CAST(s_suppkey * 37 AS VARCHAR(9)) END AS aadt_2022",
        "CASE s_suppkey % 3 WHEN 0 THEN 'n/a' WHEN 1 THEN CAST(s_suppkey * 11 + 5 AS VARCHAR(9)) ELSE '' END AS aadt_2021",
        "CAST(s_suppkey + 1 AS VARCHAR(9)) AS aadt_2020",
    ], "true"),
    "arc": ("part", ["p_partkey AS u", "p_partkey AS k", "CAST(p_size AS BIGINT) AS w"], "true"),
}


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns, condition = ENTITIES[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").where(condition).selectExpr(*columns)


def sql(*names: str) -> str:
    """WITH clauses of the entities, for their SQL."""
    parts = []
    for name in names:
        table, columns, condition = ENTITIES[name]
        parts.append(f"{name} AS (SELECT {', '.join(columns)} FROM {table} WHERE {condition})")
    return "WITH " + ",\n".join(parts) + "\n"

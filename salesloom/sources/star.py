"""Sales facts from an order star schema (lineitem, orders, part, supplier, nation).

The facts table is one wide row per order line. Here it is put together by
left joins, and only by those that the wanted columns need. An order line without
its order, part, supplier or nation stays, with nulls for their columns, and keys of
those tables are unique: so there are as many rows whatever the columns.

No join carries a broadcast hint. The optimizer broadcasts a side only when its
size is under the threshold, and otherwise shuffles, where AQE splits hot keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions.calendar import new_year
from salesloom.sources.sales import ALL_COLUMNS


# Menu ratings and city centres that fit the star schema's value lists. One part
# type has no menu entry, so the unmatched side of the join is exercised too.
STAR_MENUS = (
    ("ECONOMY", 4.0, "https://img.example/economy.jpg"),
    ("LARGE", 4.5, "https://img.example/large.jpg"),
    ("MEDIUM", 3.5, "https://img.example/medium.jpg"),
    ("SMALL", 5.0, "https://img.example/small.jpg"),
    ("STANDARD", 4.0, "https://img.example/standard.jpg"),
)
STAR_CENTERS = (("NATION_3", 50.0647, 19.9450), ("NATION_9", 52.2298, 21.0118))



# The columns read, by table. With a schema given, Spark opens no file to look for one.
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double",
    "orders": "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_retailprice double",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "nation": "n_nationkey int, n_name string",
}


def _lineitem_columns() -> dict[str, Column]:
    return {
        "order_key": F.col("l_orderkey"),
        "line_number": F.col("l_linenumber"),
        "part_key": F.col("l_partkey"),
        "supplier_key": F.col("l_suppkey"),
        "price": F.col("l_extendedprice"),
        "quantity": F.col("l_quantity"),
        "unit_price": F.try_divide("l_extendedprice", "l_quantity"),
        "latitude": F.lit(52.2298) + (F.col("l_suppkey") % 21 - 10) / F.lit(1000.0),
        "longitude": F.lit(21.0118) + (F.col("l_suppkey") % 17 - 8) / F.lit(1000.0),
    }


def _order_columns() -> dict[str, Column]:
    hour = (F.col("o_orderkey") * 7 + F.col("l_linenumber") * 5) % 24
    return {
        "order_total": F.col("o_totalprice"),
        "order_ts": F.col("o_orderdate") + F.make_dt_interval(F.lit(0), hour.cast("int")),
    }


def _part_columns() -> dict[str, Column]:
    return {
        "truck_brand_name": F.col("p_brand"),
        "menu_type": F.col("p_type"),
        "item_subcategory": F.split_part("p_name", F.lit(" "), F.lit(1)),
        "item_category": F.split_part("p_name", F.lit(" "), F.lit(2)),
        "menu_item_name": F.col("p_name"),
        "cost_of_goods_usd": F.col("p_retailprice"),
    }


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: The key by which orders meet their lines.
BUCKET_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def bucket_star(spark: SparkSession, sf_dir: str, folder: str, buckets: int) -> dict[str, str]:
    """Stores orders and their lines in buckets by order key; returns the tables' names.

    Done once, it saves the shuffle of both tables in every join by order key: each task
    reads the same bucket of both. Each bucket is one file, sorted by key. The tables are
    in the session's catalog, their files under ``folder``.
    """
    run = uuid.uuid4().hex
    names = {}
    for name, key in BUCKET_KEYS.items():
        names[name] = f"salesloom_{name}_{run}"
        rows = _read(spark, sf_dir, name).repartition(buckets, key)
        rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{folder.rstrip('/')}/{names[name]}").saveAsTable(names[name])
    return names


def star_sales(
    spark: SparkSession,
    sf_dir: str,
    columns: Sequence[str] = ALL_COLUMNS,
    years: tuple[int, int] | None = None,
    tables: Mapping[str, str] | None = None,
) -> DataFrame:
    """The wanted columns of the sales facts.

    Besides the facts' own there are a line's keys: ``order_key``, ``line_number``, ``part_key``, ``supplier_key``.
    ``tables`` names catalog tables to read in place of files, as ``bucket_star`` gives them.

    ``years`` says that only sales of those years will be kept. An order time lies
    within a day after its order date, so orders outside the years widened by a day
    are skipped in the scan already; the filter on the order time is left to the caller.

    Orders are joined first and parts last: what is shuffled in between is keys
    and numbers, and the strings of the parts come in where no further shuffle of
    order lines follows. Part columns are worked out once per part, before the join.
    """

    def table(name: str) -> DataFrame:
        if tables and name in tables:
            return spark.table(tables[name])
        return _read(spark, sf_dir, name)

    of_line, of_order, of_part = _lineitem_columns(), _order_columns(), _part_columns()
    sales = table("lineitem")
    if years is not None or any(name in of_order for name in columns):
        orders = table("orders")
        if years is not None:
            day_before = F.col("o_orderdate") >= new_year(years[0]) - F.expr("INTERVAL 1 DAY")
            orders = orders.filter(day_before & (F.col("o_orderdate") < new_year(years[1] + 1)))
        sales = sales.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        of_line |= of_order
    if "city" in columns:
        places = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
        sales = sales.join(
            places.select("s_suppkey", F.col("n_name").alias("city")), F.col("l_suppkey") == F.col("s_suppkey"), "left"
        )
    if any(name in of_part for name in columns):
        parts = table("part").select(
            "p_partkey", *(value.alias(name) for name, value in of_part.items() if name in columns)
        )
        sales = sales.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    return sales.select(*(of_line.get(name, F.col(name)).alias(name) for name in columns))

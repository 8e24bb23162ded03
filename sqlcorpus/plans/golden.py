"""The golden workload: the query shapes the corpus is about, as DataFrame plans.

Each takes the tables it needs, so the same plan runs on a five-row shop and on
a warehouse. Which side is broadcast is left to the optimiser. Adaptive execution
splits a hot key of an inner join by itself; where it cannot (the side an outer or
semi join only looks up), the plan here folds or separates that side first.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def filter_less(table: DataFrame, key: str, bound: int) -> DataFrame:
    return table.filter(F.col(key) < bound)


def project_filter(table: DataFrame, columns: list[str], key: str, bound: int) -> DataFrame:
    return table.filter(F.col(key) < bound).select(*columns)


def on_date(table: DataFrame, column: str, day: dt.date | None = None) -> DataFrame:
    """Rows of one day, today unless given.

    Compares with the day's two ends, so the scan can skip row groups.
    """
    start = F.current_date() if day is None else F.lit(day)
    at = F.col(column)
    return table.filter((at >= start) & (at < F.date_add(start, 1)))


def distinct_values(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).distinct()


def ends_with(table: DataFrame, column: str, suffix: str) -> DataFrame:
    return table.filter(F.col(column).endswith(suffix))


def equals(table: DataFrame, column: str, value: str) -> DataFrame:
    return table.filter(F.col(column) == value)


def join_filter(facts: DataFrame, dims: DataFrame, on: Column, condition: Column) -> DataFrame:
    """Facts with a partner, the further condition being part of the join."""
    return facts.join(dims, on & condition, "inner").select(*(facts[c] for c in facts.columns))


def left_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Every left row with its partners, or with nulls.

    An outer join cannot split a hot key of the right side. So the matches come from
    an inner join, which can, and the rest from an anti join with the distinct keys.
    """
    matched = left.join(right, left[left_key] == right[right_key], "inner")
    keys = right.select(F.col(right_key).alias("_key")).distinct()
    alone = left.join(keys, left[left_key] == keys["_key"], "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def in_subquery(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key occurs in the one column of ``keys``."""
    return table.join(keys.toDF(key).distinct(), key, "left_semi")


def group_count(
    facts: DataFrame, dims: DataFrame, fact_key: str, dim_key: str, name: str, label: str = "n"
) -> DataFrame:
    """Facts per dimension name, counted per key before they are joined."""
    per_key = facts.groupBy(F.col(fact_key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    named = dims.select(F.col(dim_key).alias("_key"), F.col(name))
    return per_key.join(named, "_key").groupBy(name).agg(F.sum("_n").alias(label))


# Wide enough for prices of eight decimals; their product still has all its digits.
QUANTITY, PRICE = "decimal(17,3)", "decimal(18,8)"


def money(quantity: Column, price: Column) -> Column:
    """Exact product, so that sums do not depend on the order of the rows."""
    return quantity.cast(QUANTITY) * price.cast(PRICE)


def revenue(
    details: DataFrame, products: DataFrame, detail_product: str, product: str, quantity: str, price: str
) -> DataFrame:
    """Quantity times price over all details; quantities are added up per product first."""
    sold = details.groupBy(F.col(detail_product).alias("_product")).agg(
        F.sum(F.col(quantity).cast(QUANTITY)).cast(QUANTITY).alias("_sold")
    )
    priced = products.select(F.col(product).alias("_product"), F.col(price).cast(PRICE).alias("_price"))
    return sold.join(priced, "_product").agg(
        F.sum(F.col("_sold") * F.col("_price")).cast("double").alias("total_revenue")
    )


def top_spender(
    users: DataFrame, orders: DataFrame, details: DataFrame, products: DataFrame, names: dict[str, str]
) -> DataFrame:
    """Name and sum of the one who spent most; users of the same name count as one.

    Details are summed per order and orders per user before the next join, so each
    join moves the fewest rows and a hot user or order is folded on the map side.
    """
    n = names
    spent = details.join(products, details[n["detail_product"]] == products[n["product"]]).select(
        details[n["detail_order"]].alias("_order"), money(F.col(n["quantity"]), F.col(n["price"])).alias("_spent")
    )
    per_order = spent.groupBy("_order").agg(F.sum("_spent").alias("_spent"))
    per_user = (
        orders.select(F.col(n["order"]).alias("_order"), F.col(n["order_user"]).alias("_user"))
        .join(per_order, "_order").groupBy("_user").agg(F.sum("_spent").alias("_spent"))
    )
    per_name = (
        users.select(F.col(n["user"]).alias("_user"), F.col(n["user_name"]).alias("name"))
        .join(per_user, "_user").groupBy("name").agg(F.sum("_spent").alias("total_spent"))
    )
    return per_name.orderBy(F.col("total_spent").desc(), "name").limit(1).select(
        "name", F.col("total_spent").cast("double").alias("total_spent")
    )

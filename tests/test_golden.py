"""The workload on a small shop whose answers can be worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sqlcorpus.operators.evaluate import same_result
from sqlcorpus.plans import golden


@pytest.fixture(scope="module")
def shop(spark):
    tables = {
        "users": ([(1, "Ann", "ann@gmail.com"), (2, "Bo", "bo@gmail.company"), (3, "Ann", "a2@gmail.com"), (9, "Jesus", "j@x.org")],
                  "id int, name string, email string"),
        "orders": ([(1, dt.date(2024, 6, 1), 1), (2, dt.date(2024, 6, 2), 2), (3, dt.date.today(), 3), (4, dt.date(2024, 6, 1), None)],
                   "id int, date date, user_id int"),
        "categories": ([(1, "Books"), (2, "Toys"), (3, "Food"), (4, "Toys")], "id int, name string"),
        "products": ([(1, "Novel", 10.1, 1), (2, "Car", 5.0, 2), (3, "Doll", 7.25, 4), (4, "Atlas", 30.0, 1)],
                     "id int, name string, price double, category_id int"),
        "details": ([(1, 1, 1, 2), (2, 1, 2, 1), (3, 2, 4, 1), (4, 3, 3, 2), (5, 3, 1, 1)],
                    "id int, order_id int, product_id int, quantity int"),
    }
    return {name: spark.createDataFrame(rows, schema) for name, (rows, schema) in tables.items()}


def test_filters(shop, rows):
    users = shop["users"]
    assert rows(golden.filter_less(users, "id", 5), "id") == [(1,), (2,), (3,)]
    assert rows(golden.project_filter(users, ["name"], "id", 3)) == [("Ann",), ("Bo",)]
    assert rows(golden.ends_with(users, "email", "@gmail.com"), "id") == [(1,), (3,)]
    assert rows(golden.equals(users, "name", "Jesus"), "id") == [(9,)]
    assert rows(golden.distinct_values(shop["categories"], "name")) == [("Books",), ("Food",), ("Toys",)]


def test_dates(shop, rows):
    assert rows(golden.on_date(shop["orders"], "date", dt.date(2024, 6, 1)), "id") == [(1,), (4,)]
    assert rows(golden.on_date(shop["orders"], "date"), "id") == [(3,)]
    at = shop["orders"].select("id", F.col("date").cast("timestamp_ntz").alias("date"))
    late = at.withColumn("date", F.expr("date + interval 23 hours 59 minutes"))
    assert rows(golden.on_date(late, "date", dt.date(2024, 6, 1)), "id") == [(1,), (4,)]


def test_joins(shop, rows):
    p, c, u, o = (shop[n] for n in ("products", "categories", "users", "orders"))
    assert rows(golden.join_filter(p, c, p.category_id == c.id, c.name == "Books"), "name") == [("Atlas",), ("Novel",)]
    left = golden.left_join(u.select("id"), o.select(F.col("id").alias("order_id"), "user_id"), "id", "user_id")
    assert rows(left, "id", "order_id") == [(1, 1), (2, 2), (3, 3), (9, None)]
    assert rows(golden.in_subquery(u, "id", o.select("user_id")), "id") == [(1,), (2,), (3,)]
    assert rows(golden.group_count(p.drop("name"), c, "category_id", "id", "name")) == [("Books", 2), ("Toys", 2)]


def test_money(shop):
    d, p = shop["details"], shop["products"]
    got = golden.revenue(d, p, "product_id", "id", "quantity", "price").first()[0]
    assert got == pytest.approx(20.2 + 5 + 30 + 14.5 + 10.1)
    names = {"user": "id", "user_name": "name", "order": "id", "order_user": "user_id", "detail_order": "order_id",
             "detail_product": "product_id", "product": "id", "quantity": "quantity", "price": "price"}
    # the two Anns count as one: 25.2 + 24.6
    assert tuple(golden.top_spender(shop["users"], shop["orders"], d, p, names).first()) == ("Ann", pytest.approx(49.8))


def test_same_results_by_other_plans(spark, shop):
    for name, df in shop.items():
        df.createOrReplaceTempView("shop_" + name)
    p, c, u = shop["products"], shop["categories"], shop["users"]
    sql = "SELECT p.* FROM shop_products p JOIN shop_categories c ON p.category_id = c.id AND c.name = 'Books'"
    assert same_result(spark.sql(sql), golden.join_filter(p, c, p.category_id == c.id, c.name == "Books"))
    sql = "SELECT * FROM shop_users WHERE id IN (SELECT user_id FROM shop_orders WHERE user_id < 5)"
    assert same_result(spark.sql(sql), golden.in_subquery(u, "id", shop["orders"].filter("user_id < 5").select("user_id")))

"""Inputs of the engine derived from the driver tables.

Orders are rating events: a customer rates the part (or, for a dense rating matrix, the
supplier) of each order line. Rows are split by order date into training, validation and
request periods; customers of one nation and items of one brand (or suppliers of one
nation) appear in the request period only, which gives unknown users and items. Every
order line is in exactly one of the three.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rateweave.session import materialize, spread

ORDER = ("ord1", "ord2", "ord3", "ord4")
VAL_FROM = "2000-04-01"
REQUESTS_FROM = "2000-12-01"
NEW_NATION = 7
NEW_BRAND = "Brand#13"
NEW_SUPPLIER_NATION = 13


class Inputs:
    """Lazily built input DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, dense: bool = False):
        self.spark = spark
        self.sf_dir = sf_dir
        self.dense = dense
        self._tables: dict[str, DataFrame] = {}
        self._bag: DataFrame | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def store(self) -> Inputs:
        """Write the rating events once, for queries that read several periods or one repeatedly."""
        self._bag = materialize(self.bag(), "events")
        return self

    def bag(self) -> DataFrame:
        """All rating events with the period each belongs to."""
        if self._bag is not None:
            return self._bag
        item = "l_suppkey" if self.dense else "l_partkey"
        lines = self.table("lineitem").select(
            "l_orderkey", F.col(item).alias("item_id"), "l_linenumber", "l_quantity", "l_shipdate"
        )
        orders = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        n = self.table("lineitem").count()
        lines, orders = spread(lines, "l_orderkey", rows=n), spread(orders, "o_orderkey", rows=n)
        newcomers = self.table("customer").filter(F.col("c_nationkey") == NEW_NATION).select(
            F.col("c_custkey").alias("user_id"), F.lit(True).alias("new_user")
        )
        if self.dense:
            launches = self.table("supplier").filter(F.col("s_nationkey") == NEW_SUPPLIER_NATION).select(
                F.col("s_suppkey").alias("item_id"), F.lit(True).alias("new_item")
            )
        else:
            launches = self.table("part").filter(F.col("p_brand") == NEW_BRAND).select(
                F.col("p_partkey").alias("item_id"), F.lit(True).alias("new_item")
            )
        new = F.col("new_user").isNotNull() | F.col("new_item").isNotNull()
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .withColumnRenamed("o_custkey", "user_id")
            .join(newcomers, "user_id", "left")
            .join(launches, "item_id", "left")
            .select(
                "user_id", "item_id",
                (1 + F.col("l_quantity").cast("int") % 5).cast("double").alias("stars"),
                F.date_format("l_shipdate", "yyyy-MM-dd").alias("rated_on"),
                F.col("l_orderkey").alias("ord1"), F.col("l_linenumber").alias("ord2"),
                F.col("l_shipdate").alias("ord3"), F.col("l_quantity").alias("ord4"),
                F.when(new | (F.col("o_orderdate") >= F.lit(REQUESTS_FROM).cast("timestamp")), "request")
                .when(F.col("o_orderdate") >= F.lit(VAL_FROM).cast("timestamp"), "val")
                .otherwise("train").alias("period"),
            )
        )

    def train(self) -> DataFrame:
        return self.bag().filter(F.col("period") == "train").drop("period")

    def val(self) -> DataFrame:
        return self.bag().filter(F.col("period") == "val").drop("period")

    def requests(self) -> DataFrame:
        """Requested pairs; a pair ordered twice is requested twice."""
        return self.bag().filter(F.col("period") == "request").select("user_id", "item_id")

    def users(self) -> DataFrame:
        customers = self.table("customer")
        nations = self.table("nation").select("n_nationkey", "n_name")
        votes = self.table("events").groupBy("user_id").agg(
            F.count(F.when(F.col("event_type") == "click", 1)).alias("funny"),
            F.count(F.when(F.col("event_type") == "view", 1)).alias("useful"),
            F.count(F.when(F.col("event_type") == "purchase", 1)).alias("cool"),
        )
        c = F.col("c_custkey")
        balance = F.col("c_acctbal")
        friends = (
            F.when(c % 6 == 0, "None").when(c % 31 == 0, "")
            .otherwise(F.concat_ws(", ", (c + 1).cast("string"), (c + 5).cast("string"), (c * 2 + 1).cast("string")))
        )
        return (
            customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .withColumn("user_id", c)
            .join(votes, "user_id", "left")
            .select(
                "user_id", F.col("n_name").alias("name"),
                F.when(balance < 0, F.lit(0.0)).otherwise(1 + F.floor(balance / 25).cast("double") / 100)
                .alias("average_stars"),
                ((c * 13) % 97).alias("review_count"),
                F.date_add(F.lit("2010-01-01").cast("date"), ((c * 17) % 2500).cast("int")).cast("string")
                .alias("member_since"),
                (c % 7).alias("fans"), "funny", "useful", "cool",
                (c % 5).alias("compliment_hot"), (c % 4).alias("compliment_note"),
                friends.alias("friends"),
            )
        )

    def items(self) -> DataFrame:
        size = F.col("p_size")
        parts = self.table("part")
        placed = F.col("p_brand") != "Brand#2"

        def entry(key: str, value: Column) -> Column:
            return F.struct(F.lit(key).alias("key"), value.alias("value"))

        attributes = F.array(
            entry("GoodForKids", F.when(size % 4 == 0, "True").when(size % 4 == 1, "False")),
            entry("RestaurantsGoodForGroups", F.when(size % 3 == 0, "True").when(size % 3 == 1, "False")),
            entry("WiFi", F.when(size % 5 == 0, "no").when(size % 5 == 1, "free").when(size % 5 == 2, "paid")),
            entry("RestaurantsPriceRange2", F.when(size % 6 < 4, (size % 6 + 1).cast("string"))),
        )
        days = F.filter(F.sequence(F.lit(0), F.lit(6)), lambda d: (size % 3 != 0) & ((size + d) % 5 != 0))

        def span(d: Column) -> Column:
            opens = F.concat(((size + d) % 12).cast("string"), F.lit(":"), (30 * (d % 2)).cast("string"))
            closes = F.concat((((F.col("p_partkey") + d) % 3) * 9 + 3).cast("string"), F.lit(":0"))
            return F.struct(d.cast("string").alias("key"), F.concat(opens, F.lit("-"), closes).alias("value"))

        return parts.select(
            F.col("p_partkey").alias("item_id"),
            F.when(size == 50, F.lit(0.0)).otherwise((2 + size % 9).cast("double") / 2).alias("stars"),
            size.cast("bigint").alias("review_count"),
            (size % 2).cast("bigint").alias("is_open"),
            F.when(placed, F.col("p_retailprice") / 50).alias("latitude"),
            F.when(placed, (-2 * size).cast("double")).alias("longitude"),
            F.map_from_entries(F.filter(attributes, lambda e: e["value"].isNotNull())).alias("attributes"),
            F.map_from_entries(F.transform(days, span)).alias("hours"),
        )

    def reviews(self) -> DataFrame:
        return self.train()

    def checkins(self) -> DataFrame:
        """Order lines per item and day of the month."""
        slots = (
            self.table("lineitem")
            .groupBy(F.col("l_partkey").alias("item_id"), F.dayofmonth("l_shipdate").cast("string").alias("slot"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        # At most 31 slots per item.
        return slots.groupBy("item_id").agg(
            F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("time")
        )

    def lookup(self) -> DataFrame:
        """Codes by nation name; those of one region say nothing."""
        region = F.col("n_regionkey")
        return self.table("nation").select(
            F.lower("n_name").alias("lookup_key"),
            F.when(region < 2, "F").when(region == 4, "U").otherwise("M").alias("code"),
        )

"""The given star-schema tables seen as clinical tables.

analyses = line items of an order's customer, admissions = orders, diagnoses = part
brands of the line items, second source = user events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAB_IDS = [1, 2, 3, 4, 5, 6, 7]
LAB_FEATURES = [str(i) for i in LAB_IDS]
EVENT_IDS = ["click", "error", "purchase", "signup", "view"]
SIGNALS = ["value", "k"]
POSITIVE = ["Brand#13"]
DISEASES = {"a": ["Brand#13"], "b": ["Brand#4", "Brand#21"]}


class Star:
    """Views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def analyses(self) -> DataFrame:
        """Irregular lab values; every seventh quantity counts as missing."""
        items = self.read("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity")
        orders = self.read("orders").select("o_orderkey", "o_custkey").hint("merge")
        return items.join(orders, items.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("patient_id"),
            F.col("l_linenumber").alias("analysis_id"),
            F.col("l_shipdate").alias("analysis_time"),
            F.when(F.col("l_quantity") % 7 != 0, F.col("l_quantity")).alias("analysis_value"),
        )

    def events(self) -> DataFrame:
        """User events as measurements with a time of day; some values are missing."""
        return self.read("events").select(
            F.col("user_id").alias("patient_id"),
            F.col("event_type").alias("analysis_id"),
            F.col("ts").alias("analysis_time"),
            F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("analysis_value"),
        )

    def signals(self) -> DataFrame:
        """User events as a second source with two numeric features."""
        return self.read("events").select(
            F.col("user_id").alias("patient_id"),
            F.col("ts").alias("signal_time"),
            "value",
            F.get_json_object("props", "$.k").cast("double").alias("k"),
        )

    def admissions(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("admission_id"),
            F.col("o_custkey").alias("patient_id"),
            F.col("o_orderdate").alias("discharge_time"),
        )

    def diagnoses(self) -> DataFrame:
        items = self.read("lineitem").select("l_orderkey", "l_partkey")
        # parts and orders grow with the line items; small files would have every task hold all of them
        parts = self.read("part").select("p_partkey", "p_brand").hint("merge")
        orders = self.read("orders").select("o_orderkey", "o_custkey").hint("merge")
        return (
            items.join(parts, items.l_partkey == parts.p_partkey)
            .join(orders, items.l_orderkey == orders.o_orderkey)
            .select(
                F.col("o_custkey").alias("patient_id"),
                F.col("l_orderkey").alias("admission_id"),
                F.col("p_brand").alias("diagnosis_code"),
            )
        )

    def diagnoses_lookup(self) -> DataFrame:
        """One title per brand, made of its first name and last type."""
        return self.read("part").groupBy(F.col("p_brand").alias("diagnosis_code")).agg(
            F.concat_ws(" ", F.min("p_name"), F.max("p_name"), F.max("p_type")).alias("long_title")
        )

    def patients(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.read("customer").select(
            key.alias("patient_id"),
            (20 + key % 60).cast("int").alias("age"),
            F.when(key % 2 == 0, "F").otherwise("M").alias("gender"),
            F.lit(1995).alias("anchor_year"),
        )

    def event_names(self) -> DataFrame:
        """Names of the event types but one, so the total also counts a type without name."""
        return (
            self.read("events").select(F.col("event_type").alias("analysis_id")).distinct()
            .where(F.col("analysis_id") != "signup")
            .withColumn("analysis_name", F.upper("analysis_id"))
        )

    def categorized(self) -> DataFrame:
        """Parts as analyses: category = type, count = number of line items."""
        items = self.read("lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("event_count"))
        parts = self.read("part")
        return items.join(parts, items.l_partkey == parts.p_partkey).select(
            F.col("p_partkey").alias("itemid"), F.col("p_type").alias("category"), "event_count"
        )

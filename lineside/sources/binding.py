"""The native panel tables, derived from the TPC-H-like test tables.

A supplier plays the route, a part the stop, a ship month the period. Everything is an ordinary
DataFrame over the parquet scan, so each query reads only the columns it needs.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lineside.functions.columns import MERCATOR_M
from lineside.operators.broadcasts import attach_row
from lineside.plans import weather as weather_plan

CENTRE_LAT, CENTRE_LON = 40.44, -79.99


def route_of(number: Column) -> Column:
    """Route identifier of a supplier number: plain, flyer, express or limited."""
    text = number.cast("string")
    base = (number - 1).cast("string")
    return (
        F.when(number % 2 == 0, text)
        .when(number % 10 == 5, F.concat(F.lit("P"), text))
        .when(number % 10 == 7, F.concat(base, F.lit("X")))
        .otherwise(F.concat(base, F.lit("L")))
    )


def mode_of(number: Column) -> Column:
    return (
        F.when(number % 50 == 20, "INCLINE").when(number % 10 == 0, "RAIL")
        .when(number % 33 == 32, "UNKNOWN").otherwise("BUS")
    )


def garage_of(number: Column) -> Column:
    return F.concat(F.lit("Garage "), (number % 5).cast("string"))


def day_type_of(day: Column, names=("WEEKDAY", "SAT.", "SUN.")) -> Column:
    dow = F.dayofweek(day)
    return F.when(dow == 7, names[1]).when(dow == 1, names[2]).otherwise(names[0])


class Tables:
    """Native tables over one test-data folder."""

    def __init__(self, spark: SparkSession, folder: str, spans: tuple[tuple[str, str], ...] = ()):
        self.spark, self.folder, self.spans = spark, folder, spans

    def during(self, *spans: tuple[str, str]) -> Tables:
        """The same tables with facts of these months only (first and last of each span).

        The months become ranges of the stored date, so the scan skips what lies outside.
        """
        return Tables(self.spark, self.folder, spans)

    def _in_spans(self) -> Column:
        def first_day(month: str, later: int = 0) -> date:
            number = int(month[:4]) * 12 + int(month[5:]) - 1 + later
            return date(number // 12, number % 12 + 1, 1)

        day = F.col("l_shipdate")
        return reduce(lambda a, b: a | b, [
            (day >= F.lit(first_day(first))) & (day < F.lit(first_day(last, 1))) for first, last in self.spans])

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        facts = self.raw("lineitem")
        return (facts.where(self._in_spans()) if self.spans else facts).withColumns({
            "route_id": route_of(F.col("l_suppkey")),
            "stop_id": F.col("l_partkey").cast("string"),
            "month": F.date_format("l_shipdate", "yyyy-MM"),
            "day_type": day_type_of(F.col("l_shipdate")),
        })

    @cached_property
    def routes(self) -> DataFrame:
        number = F.col("s_suppkey")
        return self.raw("supplier").select(
            route_of(number).alias("route_id"), F.col("s_name").alias("route_name"), mode_of(number).alias("mode"))

    @cached_property
    def otp(self) -> DataFrame:
        kept = F.count_if(F.col("l_returnflag") != "R")
        return self.lines.groupBy("route_id", "month").agg((kept / F.count(F.lit(1))).alias("otp"))

    @cached_property
    def ridership(self) -> DataFrame:
        number = F.col("l_suppkey")
        riders = F.when(number % 10 == 9, F.lit(0.0)).otherwise(F.sum("l_quantity"))
        return self.lines.groupBy(number, "route_id", "month", "day_type").agg(
            riders.alias("avg_riders"), F.count(F.lit(1)).alias("day_count")).select(
            "route_id", "month", "day_type", "avg_riders", "day_count",
            garage_of(number).alias("current_garage"), mode_of(number).alias("mode"))

    @cached_property
    def schedule(self) -> DataFrame:
        done = self.lines.where(F.col("l_linestatus") == "F")
        out = done.groupBy("route_id", "month", "day_type").agg(
            F.count(F.lit(1)).alias("daily_trips"), F.sum("l_extendedprice").alias("daily_trip_dist"))
        month = F.substring("month", 6, 2).cast("int")
        return out.withColumn("pick_id", F.concat(F.substring("month", 1, 4), F.lit("Q"), F.ceil(month / 3).cast("string")))

    @cached_property
    def route_stops(self) -> DataFrame:
        direction = (F.when(F.col("l_linenumber") == 7, "IB,OB").when(F.col("l_linestatus") == "F", "IB").otherwise("OB"))
        quantity = F.col("l_quantity").cast("bigint")

        def trips(kind: str | None) -> Column:
            part = quantity if kind is None else F.when(F.col("day_type") == kind, quantity).otherwise(F.lit(0))
            return F.sum(part)

        return self.lines.groupBy("route_id", "stop_id", direction.alias("direction")).agg(
            F.nullif(trips("WEEKDAY"), F.lit(1)).alias("trips_wd"), trips("SAT.").alias("trips_sa"),
            trips("SUN.").alias("trips_su"), F.nullif(trips(None), F.lit(1)).alias("trips_7d"))

    @cached_property
    def stops(self) -> DataFrame:
        vectors = self.raw("embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("_e0"),
                                                F.col("embedding")[1].cast("double").alias("_e1"))
        count = vectors.agg(F.count(F.lit(1)).alias("_count"))
        parts = attach_row(self.raw("part"), count).withColumn("vec_id", F.col("p_partkey") % F.col("_count"))
        size = F.col("p_size")
        return parts.join(vectors, "vec_id").select(
            F.col("p_partkey").cast("string").alias("stop_id"), F.col("p_partkey").alias("stop_code"),
            F.col("p_name").alias("stop_name"),
            (F.lit(CENTRE_LAT) + F.col("_e0") * F.lit(0.3) + size * F.lit(0.0005)).alias("lat"),
            (F.lit(CENTRE_LON) + F.col("_e1") * F.lit(0.3) + F.col("p_retailprice") * F.lit(0.00001)).alias("lon"),
            F.when(size <= 25, "County A").otherwise("County B").alias("county"),
            F.concat_ws(" ", "p_type", size.cast("string")).alias("muni"),
            F.when(size == 50, "0").when(size == 49, "").when(size == 48, F.lit(None)).otherwise(F.col("p_brand")).alias("hood"),
            size.alias("p_size"), "p_retailprice")

    @cached_property
    def stop_reference(self) -> DataFrame:
        served = self.lines.groupBy("stop_id").agg(F.min("month").alias("first_served"), F.max("month").alias("last_served"))
        mode = F.when(F.col("p_size") == 1, "INCLINE").otherwise("BUS")
        return self.stops.join(served, "stop_id", "left").select(
            "stop_id", "stop_code", "stop_name", F.lit("catalog").alias("stop_source"), F.lit("Y").alias("public_stop"),
            "lat", "lon", mode.alias("mode"), "first_served", "last_served", "county", "muni", "hood")

    @cached_property
    def weather_daily(self) -> DataFrame:
        price = F.col("o_totalprice")
        return self.raw("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("DATE")).agg(
            (F.count_if(F.col("o_orderstatus") == "F") * F.lit(8.0)).alias("PRCP"),
            (F.count_if(F.col("o_orderpriority") == "1-URGENT") * F.lit(10.0)).alias("SNOW"),
            (F.max(price) / 12000).alias("TMAX"), (F.min(price) / 10000 - 5).alias("TMIN"),
            F.when(F.count(F.lit(1)) > 1, F.max(price) / 100000).alias("AWND"))

    @cached_property
    def weather(self) -> DataFrame:
        return weather_plan.monthly_weather(self.weather_daily)

    @cached_property
    def usage(self) -> DataFrame:
        """Stop usage per stop, route, year and day kind; years before 1998 are the earlier period."""
        quantity, year = F.col("l_quantity"), F.date_format("l_shipdate", "yyyy")
        day = day_type_of(F.col("l_shipdate"), ("Weekday", "Saturday", "Sunday"))
        grouped = self.lines.groupBy("stop_id", F.col("route_id").alias("route_name"), year.alias("datekey"),
                                     day.alias("serviceday"), mode_of(F.col("l_suppkey")).alias("mode")).agg(
            F.sum(F.when(F.col("l_returnflag") == "A", quantity).otherwise(F.lit(0.0))).alias("avg_ons"),
            F.sum(F.when(F.col("l_returnflag") == "N", quantity).otherwise(F.lit(0.0))).alias("avg_offs"),
            F.when(F.min("l_linestatus") == "F", "Inbound").otherwise("Outbound").alias("direction"))
        size = F.col("p_size")
        shelter = F.when(size <= 5, "Agency shelter").when(size <= 10, "Vendor shelter").when(size > 11, "No Shelter")
        place = self.stops.select("stop_id", "stop_name", F.col("lat").alias("latitude"),
                                  F.col("lon").alias("longitude"), shelter.alias("shelter"))
        period = F.when(F.col("datekey") < "1998", "Pre-pandemic").otherwise("Pandemic")
        return grouped.withColumn("time_period", period).join(place, "stop_id")

    @cached_property
    def traffic_features(self) -> DataFrame:
        """Road features as read from a nested JSON source, one per stop, in web-mercator metres."""
        x = F.radians("lon") * F.lit(MERCATOR_M)
        y = F.log(F.tan(F.pi() / 4 + F.radians("lat") / 2)) * F.lit(MERCATOR_M)
        size = F.col("p_size")

        def point(dx: float, dy: float) -> Column:
            return F.array(x + F.lit(dx), y + F.lit(dy))

        return self.stops.select(F.struct(
            F.col("stop_code").alias("OBJECTID"),
            F.when(size == 10, F.lit(None)).when(size == 20, F.lit(0)).otherwise(
                F.floor(F.col("p_retailprice") * 10)).cast("bigint").alias("CUR_AADT"),
            F.when(size != 7, size.cast("double")).alias("TRK_PCT"),
            F.when(size != 13, F.col("p_retailprice")).alias("SEG_LNGTH_FEET")).alias("attributes"),
            F.struct(F.array(F.array(point(0.0, 0.0), point(80.0, 50.0)),
                             F.array(point(90.0, 0.0), point(130.0, 40.0))).alias("paths")).alias("geometry"))

    @cached_property
    def trips(self) -> DataFrame:
        return self.routes.select("route_id", F.concat(F.lit("S"), F.col("route_id")).alias("shape_id"))

    @cached_property
    def shapes(self) -> DataFrame:
        """Shape points: the stops of each route in the order of their codes."""
        pairs = self.lines.select("route_id", "stop_id").distinct()
        return pairs.join(self.stops.select("stop_id", "stop_code", "lat", "lon"), "stop_id").select(
            F.concat(F.lit("S"), F.col("route_id")).alias("shape_id"), F.col("lat").alias("shape_pt_lat"),
            F.col("lon").alias("shape_pt_lon"), F.col("stop_code").alias("shape_pt_sequence"))

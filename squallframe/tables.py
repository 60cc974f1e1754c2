"""Input tables: the driver's parquet files and the stand-in views built from them."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from squallframe.session import SETTINGS

# The stand-in views as portable SQL; oracle queries inline them as CTEs.
VIEW_SQL = {
    "v_station": "SELECT DISTINCT CAST(user_id % 35 AS INT) AS loc_id, CAST(-44.0 + (user_id % 35) AS DOUBLE) AS lat, CAST(112.0 + ((user_id % 35) * 13) % 44 AS DOUBLE) AS lon FROM events",
    "v_obs": "SELECT event_id, CAST(user_id % 35 AS INT) AS loc_id, ts AS gust_time, date_trunc('hour', ts) AS hour_floor, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value / 10.0 END AS wind_gust, CASE WHEN event_id % 41 = 0 THEN 'S' WHEN event_id % 43 = 0 THEN 'W' ELSE 'Y' END AS quality, CAST(event_id % 5 AS INT) AS lightning, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS tc_affected, CASE WHEN event_type = 'error' AND value > 200 THEN 1 ELSE 0 END AS is_sta, CAST((event_id * 37) % 360 AS DOUBLE) AS wind_dir FROM events",
    "v_points": "SELECT CAST(user_id % 35 AS INT) AS loc_id, date_trunc('hour', ts) AS time, CAST(30 + MAX(event_id) % 31 AS DOUBLE) AS t_totals, ROUND(MAX(value) * 3.0, 4) AS ml_cape, CAST(MIN(event_id) % 45 AS DOUBLE) AS s06, CAST(MAX(event_id * 7) % 1200 AS DOUBLE) AS dcape, ROUND(MIN(value) / 7.0, 4) AS umean06 FROM events GROUP BY 1, 2",
    "v_field": "SELECT CAST(l_linenumber AS INT) AS model, CASE WHEN l_shipdate < TIMESTAMP '1998-06-01 00:00:00' THEN 'historical' ELSE 'scenario' END AS experiment, CAST(l_partkey % 6 AS INT) AS i, CAST(l_suppkey % 5 AS INT) AS j, -40E0 + 1.5E0 * (l_partkey % 6) AS lat, 115E0 + 1.5E0 * (l_suppkey % 5) AS lon, l_shipdate AS time, l_quantity AS v FROM lineitem",
    "v_levels": "SELECT l_orderkey AS col_id, CAST(l_linenumber AS INT) AS lev, 1050E0 - 50E0 * l_linenumber AS p, 500E0 * l_linenumber - 450E0 AS hgt, 30E0 - 3.5E0 * l_linenumber - 10E0 * MIN(l_discount) AS ta, 24E0 - 4E0 * l_linenumber + 10E0 * MIN(l_tax) AS dp, MIN(l_quantity) / 2E0 AS ua, CAST(MIN(l_suppkey) % 20 AS DOUBLE) - 10E0 AS va FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "v_track": "SELECT o_orderkey AS fix_id, CAST(o_custkey % 20 AS INT) AS storm_id, o_orderdate AS time, CAST(-30 + (o_orderkey % 25) AS DOUBLE) AS lat, CAST(112 + (o_custkey % 44) AS DOUBLE) AS lon FROM orders",
    "v_index": "SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS year, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS month, AVG(o_totalprice) / 10000E0 AS idx FROM orders GROUP BY 1, 2",
}


class Tables:
    """Lazy access to one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}
        # only the session's time zone matters for results; the cluster's other settings stay
        spark.conf.set("spark.sql.session.timeZone", SETTINGS["spark.sql.session.timeZone"])

    def raw(self, name: str) -> DataFrame:
        if name not in self._raw:
            self._raw[name] = self._read(name)
        return self._raw[name]

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        ntz = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df

    @property
    def events(self) -> DataFrame:
        return self.raw("events")

    @property
    def station(self) -> DataFrame:
        # user_id % 35: at most 35 rows whatever the size of events
        site = F.col("user_id") % 35
        return self.events.select(site.cast("int").alias("loc_id")).distinct().select(
            "loc_id",
            (F.lit(-44.0) + F.col("loc_id")).alias("lat"),
            (F.lit(112.0) + (F.col("loc_id") * 13) % 44).alias("lon"),
        )

    @property
    def obs(self) -> DataFrame:
        e = F.col("event_id")
        return self.events.select(
            e,
            (F.col("user_id") % 35).cast("int").alias("loc_id"),
            F.col("ts").alias("gust_time"),
            F.date_trunc("hour", "ts").alias("hour_floor"),
            F.when(e % 50 != 0, F.col("value") / 10.0).alias("wind_gust"),
            F.when(e % 41 == 0, "S").when(e % 43 == 0, "W").otherwise("Y").alias("quality"),
            (e % 5).cast("int").alias("lightning"),
            (e % 97 == 0).cast("int").alias("tc_affected"),
            F.when((F.col("event_type") == "error") & (F.col("value") > 200), 1).otherwise(0).alias("is_sta"),
            ((e * 37) % 360).cast("double").alias("wind_dir"),
        )

    @property
    def points(self) -> DataFrame:
        keys = [(F.col("user_id") % 35).cast("int").alias("loc_id"), F.date_trunc("hour", "ts").alias("time")]
        return self.events.groupBy(*keys).agg(
            (30 + F.max("event_id") % 31).cast("double").alias("t_totals"),
            F.round(F.max("value") * 3.0, 4).alias("ml_cape"),
            (F.min("event_id") % 45).cast("double").alias("s06"),
            (F.max(F.col("event_id") * 7) % 1200).cast("double").alias("dcape"),
            F.round(F.min("value") / 7.0, 4).alias("umean06"),
        )

    @property
    def field(self) -> DataFrame:
        split = F.lit("1998-06-01 00:00:00").cast("timestamp")
        i, j = F.col("l_partkey") % 6, F.col("l_suppkey") % 5
        return self.raw("lineitem").select(
            F.col("l_linenumber").cast("int").alias("model"),
            F.when(F.col("l_shipdate") < split, "historical").otherwise("scenario").alias("experiment"),
            i.cast("int").alias("i"),
            j.cast("int").alias("j"),
            (F.lit(-40.0) + F.lit(1.5) * i).alias("lat"),
            (F.lit(115.0) + F.lit(1.5) * j).alias("lon"),
            F.col("l_shipdate").alias("time"),
            F.col("l_quantity").alias("v"),
        )

    @property
    def levels(self) -> DataFrame:
        k = F.col("l_linenumber")
        return (
            self.raw("lineitem")
            .groupBy("l_orderkey", "l_linenumber")
            .agg(
                F.min("l_discount").alias("d"),
                F.min("l_tax").alias("t"),
                F.min("l_quantity").alias("q"),
                F.min("l_suppkey").alias("s"),
            )
            .select(
                F.col("l_orderkey").alias("col_id"),
                k.cast("int").alias("lev"),
                (1050.0 - 50.0 * k).alias("p"),
                (500.0 * k - 450.0).alias("hgt"),
                (30.0 - 3.5 * k - 10.0 * F.col("d")).alias("ta"),
                (24.0 - 4.0 * k + 10.0 * F.col("t")).alias("dp"),
                (F.col("q") / 2.0).alias("ua"),
                ((F.col("s") % 20).cast("double") - 10.0).alias("va"),
            )
        )

    @property
    def track(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("fix_id"),
            (F.col("o_custkey") % 20).cast("int").alias("storm_id"),
            F.col("o_orderdate").alias("time"),
            (-30 + F.col("o_orderkey") % 25).cast("double").alias("lat"),
            (112 + F.col("o_custkey") % 44).cast("double").alias("lon"),
        )

    @property
    def index(self) -> DataFrame:
        return (
            self.raw("orders")
            .groupBy(F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
            .agg((F.avg("o_totalprice") / 10000.0).alias("idx"))
        )

"""The driver's tables as panel data: customers' nations are regions, order years are years, line items give the measures.

``SQL`` has the same tables as DuckDB common table expressions, so that a query and its SQL start from one definition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import ids
from ..operators import splits
from ..sources.tables import scratch_dir

STEPS = list(range(7))
FIRST_DAY, STEP_DAYS = 105, 28
MEASURES = ["evi", "lai", "fpar", "dayl", "prcp", "srad", "tmax", "tmin"]
INDEX, CLIMATE = MEASURES[:3], MEASURES[3:]
FOLDS = 5

SQL = {
    "regions": "SELECT c_custkey, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(1 + c_custkey % 2 AS VARCHAR), 3, '0') AS county_id, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state FROM customer",
    "labels": "SELECT county_id, CAST(year(o_orderdate) AS INT) AS year, county_id || '-' || CAST(year(o_orderdate) AS VARCHAR) AS key, avg(o_totalprice) / 1000 AS target FROM orders JOIN regions ON o_custkey = c_custkey GROUP BY ALL",
    "measures": """SELECT county_id, CAST(year(l_shipdate) AS INT) AS year, CAST(floor((dayofyear(l_shipdate) - 105) / 28.0) AS INT) AS timestep, avg(l_quantity) AS evi, avg(l_discount) AS lai, avg(l_tax) AS fpar,
      avg(l_extendedprice) AS dayl, CAST(count(*) AS DOUBLE) AS prcp, max(l_quantity) AS srad, min(l_discount) AS tmax, sum(l_tax) AS tmin
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN regions ON o_custkey = c_custkey WHERE dayofyear(l_shipdate) BETWEEN 105 AND 300 GROUP BY ALL""",
    "emb": """SELECT lpad(CAST((vec_id // 7) % 10 AS VARCHAR), 2, '0') || '001' AS county_id, CAST(1995 + (vec_id // 70) % 2 AS INT) AS year, 'p' || CAST(vec_id // 7 AS VARCHAR) AS patch_id,
      CAST(vec_id % 7 AS INT) AS timestep, 'frozen' AS backbone, embedding FROM embeddings""",
    "done": "SELECT county_id, year, patch_id FROM emb GROUP BY ALL HAVING list_sort(list(timestep)) = [0, 1, 2, 3, 4, 5, 6]",
    "cells": "SELECT county_id, year, patch_id, timestep, unnest(range(0, 64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM emb SEMI JOIN done USING (county_id, year, patch_id)",
    "panel": "SELECT * FROM (SELECT county_id, year, avg(evi) AS evi, avg(lai) AS lai, avg(fpar) AS fpar FROM measures GROUP BY ALL HAVING count(*) = 7) JOIN labels USING (county_id, year)",
    "counties": "SELECT county_id, CAST(size AS BIGINT) AS size, row_number() OVER (ORDER BY size DESC, county_id DESC) AS rn FROM (SELECT county_id, count(*) AS size FROM panel GROUP BY county_id)",
    "greedy": """SELECT CAST(0 AS BIGINT) AS rn, '' AS county_id, CAST(-1 AS BIGINT) AS fold, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads
      UNION ALL SELECT c.rn, c.county_id, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + c.size ELSE x END)
      FROM greedy JOIN counties c ON c.rn = greedy.rn + 1""",
    "folds": "SELECT county_id, CAST(fold AS INT) AS fold FROM greedy WHERE rn > 0",
    "manifest": """SELECT p.key, p.county_id, p.year, CAST(f.fold AS INT) AS county_outer_fold, CAST(k AS INT) AS fold, CAST((k + 1) % 5 AS INT) AS validation_fold,
      CASE WHEN f.fold = k THEN 'test' WHEN f.fold = (k + 1) % 5 THEN 'val' ELSE 'train' END AS split FROM panel p JOIN folds f USING (county_id), range(0, 5) r(k)""",
    "predictions": """SELECT rep AS representation, key, county_id, year, substr(county_id, 1, 2) AS state, fold, target AS observed, CASE rep WHEN 'year_mean' THEN ym ELSE cm END AS predicted
      FROM (SELECT *, (sum(target) OVER (PARTITION BY year) - target) / nullif(count(*) OVER (PARTITION BY year) - 1, 0) AS ym, (sum(target) OVER (PARTITION BY county_id) - target) / nullif(count(*) OVER (PARTITION BY county_id) - 1, 0) AS cm FROM panel)
      JOIN folds USING (county_id), (VALUES ('year_mean'), ('county_mean')) v(rep) WHERE CASE rep WHEN 'year_mean' THEN ym ELSE cm END IS NOT NULL""",
    "seeded": "SELECT representation, key, county_id, year, state, fold, CAST(s AS INT) AS seed, observed, (1 - 0.1 * s) * predicted + 0.1 * s * observed AS predicted FROM predictions, range(0, 3) r(s)",
}
USES = {
    "labels": ["regions"], "measures": ["regions"], "done": ["emb"], "cells": ["emb", "done"], "panel": ["measures", "labels"], "counties": ["panel"], "greedy": ["counties"], "folds": ["greedy"],
    "manifest": ["panel", "folds"], "predictions": ["panel", "folds"], "seeded": ["predictions"],
}


def with_tables(query: str, *tables: str) -> str:
    """``query`` after the common table expressions of the tables it uses."""
    order: list[str] = []

    def add(name: str) -> None:
        for other in USES.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for t in tables:
        add(t)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + query


class Domain:
    """The domain tables over one folder of driver tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def once(self, name: str, make) -> DataFrame:
        """A small table that a query uses more than once: written to the scratch folder and read back."""
        if name not in self.made:
            path, df = scratch_dir(self.spark), make()
            df.write.parquet(path)
            self.made[name] = self.spark.read.schema(df.schema).parquet(path)
        return self.made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def regions(self) -> DataFrame:
        return self.table("customer").select("c_custkey", ids.fips(F.col("c_nationkey"), 1 + F.col("c_custkey") % 2).alias("county_id"), ids.zfill(F.col("c_nationkey"), 2).alias("state"))

    def labels(self) -> DataFrame:
        """Mean prices per region and year, worked out once: sums of doubles depend on the order of the rows, which shuffles change."""
        return self.once("labels", self._labels)

    def _labels(self) -> DataFrame:
        rows = self.table("orders").join(self.regions(), F.col("o_custkey") == F.col("c_custkey"))
        out = rows.groupBy("county_id", F.year("o_orderdate").alias("year")).agg((F.avg("o_totalprice") / 1000).alias("target"))
        return out.withColumn("key", ids.panel_key(F.col("county_id"), F.col("year")))

    def measures(self) -> DataFrame:
        """Means of the line items per region, year and step."""
        return self.once("measures", self._measures)

    def _measures(self) -> DataFrame:
        day = F.dayofyear("l_shipdate")
        items = self.table("lineitem").where(day.between(FIRST_DAY, FIRST_DAY + 7 * STEP_DAYS - 1))
        rows = items.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(self.regions(), F.col("o_custkey") == F.col("c_custkey"))
        step = F.floor((day - FIRST_DAY) / STEP_DAYS).cast("int")
        return rows.groupBy("county_id", F.year("l_shipdate").alias("year"), step.alias("timestep")).agg(
            F.avg("l_quantity").alias("evi"), F.avg("l_discount").alias("lai"), F.avg("l_tax").alias("fpar"), F.avg("l_extendedprice").alias("dayl"), F.count("*").cast("double").alias("prcp"),
            F.max("l_quantity").alias("srad"), F.min("l_discount").alias("tmax"), F.sum("l_tax").alias("tmin"),
        )

    def wide(self, names: list[str]) -> DataFrame:
        """One row per region and year with columns <name>_4 .. <name>_10."""
        rows = self.measures().withColumn("step", F.col("timestep") + 4).groupBy("county_id", "year").pivot("step", [s + 4 for s in STEPS]).agg(*[F.first(n).alias(n) for n in names])
        columns = [F.col(f"{s + 4}_{n}" if len(names) > 1 else f"{s + 4}").alias(f"{n}_{s + 4}") for n in names for s in STEPS]
        return rows.select("county_id", "year", *columns)

    def embeddings(self) -> DataFrame:
        patch = F.floor(F.col("vec_id") / 7)
        return self.table("embeddings").select(
            F.concat(ids.zfill(patch % 10, 2), F.lit("001")).alias("county_id"), (1995 + F.floor(F.col("vec_id") / 70) % 2).cast("int").alias("year"), F.concat(F.lit("p"), patch.cast("string")).alias("patch_id"),
            (F.col("vec_id") % 7).cast("int").alias("timestep"), F.lit("frozen").alias("backbone"), "embedding",
        )

    def panel(self) -> DataFrame:
        """One row per region and year, with their label."""
        return self.once("panel", self._panel)

    def _panel(self) -> DataFrame:
        rows = self.measures().groupBy("county_id", "year").agg(*[F.avg(n).alias(n) for n in INDEX], F.count("*").alias("_n")).where("_n = 7").drop("_n")
        return rows.join(self.labels(), ["county_id", "year"])

    def folds(self) -> DataFrame:
        return self.once("folds", lambda: splits.grouped_folds(self.panel().select("county_id", "key"), "county_id", FOLDS))

    def manifest(self) -> DataFrame:
        keys = self.panel().select("key", "county_id", "year")
        return splits.manifest(keys, self.folds(), "county_id", FOLDS)

    def predictions(self) -> DataFrame:
        others = lambda c: F.try_divide(F.sum("target").over(W.Window.partitionBy(c)) - F.col("target"), F.count("*").over(W.Window.partitionBy(c)) - 1)
        rows = self.panel().withColumns({"year_mean": others("year"), "county_mean": others("county_id")}).join(self.folds(), "county_id")
        both = F.explode(F.array(*[F.struct(F.lit(n).alias("representation"), F.col(n).alias("predicted")) for n in ("year_mean", "county_mean")]))
        return rows.select("key", "county_id", "year", ids.state_of(F.col("county_id")).alias("state"), "fold", F.col("target").alias("observed"), both.alias("r")).select("*", "r.*").drop("r").where("predicted is not null")

    def seeded(self) -> DataFrame:
        rows = self.predictions().withColumn("seed", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
        return rows.withColumn("predicted", (1 - 0.1 * F.col("seed")) * F.col("predicted") + 0.1 * F.col("seed") * F.col("observed"))

"""Queries over the points where a user's own services come in; the providers here are tables of the driver's data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspark.operators import basket as B
from tallyspark.operators import providers as V
from tallyspark.plans.adapter import read, sql_round
from tallyspark.plans.q_basket import BASE, _named, _options
from tallyspark.plans.registry import query

R = sql_round


@query("translator_callback", "SELECT c_custkey, coalesce(r_name || ':' || n_name, n_name) AS translated FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey AND r_regionkey < 3")
def translator_callback(spark, d):
    """Nation names become region:name where the translator knows the region, else stay."""
    nations, regions = read(spark, d, "nation"), read(spark, d, "region").filter("r_regionkey < 3")
    known = nations.join(regions, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("text"), F.concat("r_name", F.lit(":"), "n_name").alias("answer"))
    rows = read(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    return V.translated(rows, "n_name", lambda asked: known.join(asked, "text", "left_semi")).select("c_custkey", "translated")


ENRICHED = """parts AS (SELECT p_partkey, p_name, p_size, p_retailprice FROM part), old AS (SELECT l_partkey AS p_partkey, max(l_quantity)::DOUBLE AS weight FROM lineitem GROUP BY 1 HAVING count(*) > 30),
  answers AS (SELECT p_partkey, CASE WHEN p_size > 5 THEN p_retailprice / p_size END AS weight FROM parts ANTI JOIN old USING (p_partkey))"""


def _enriched(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    old = read(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").cast("double").alias("weight"), F.count("*").alias("n")).filter("n > 30").drop("n")
    answer = lambda asked: asked.withColumn("weight", F.when(F.col("p_size") > 5, F.col("p_retailprice") / F.col("p_size")))
    return V.enriched(p, "p_partkey", old, answer, {"weight_known": F.col("weight").isNotNull(), "weight_in_range": F.col("weight") < 100})


@query("enrichment_client", f"WITH {ENRICHED} SELECT p_partkey, weight, 'kept' AS origin FROM old SEMI JOIN parts USING (p_partkey) UNION ALL SELECT p_partkey, weight, 'provider' FROM answers WHERE weight < 100")
def enrichment_client(spark, d):
    """Records of earlier runs, and the provider's sound answers for the other products."""
    return _enriched(spark, d)[0]


@query("enrichment_refused", f"WITH {ENRICHED} SELECT p_partkey, CASE WHEN weight IS NULL THEN 'weight_known,weight_in_range' ELSE 'weight_in_range' END AS errors FROM answers WHERE weight IS NULL OR weight >= 100")
def enrichment_refused(spark, d):
    return _enriched(spark, d)[1].select("p_partkey", F.array_join("errors", ",").alias("errors"))


@query("geocoding_provider", "SELECT c_custkey, CASE WHEN c_nationkey < 10 THEN 'cache' WHEN s.n > 0 THEN 'provider' ELSE 'none' END AS path, CASE WHEN c_nationkey < 10 THEN c_nationkey * 1.5 ELSE s.lat END::DOUBLE AS lat FROM customer LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey)::DOUBLE AS lat FROM supplier GROUP BY 1) s ON s_nationkey = c_nationkey")
def geocoding_provider(spark, d):
    """A cache of ten nations; the provider knows those that have suppliers."""
    places = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("place"))
    cache = read(spark, d, "nation").filter("n_nationkey < 10").select(F.col("n_nationkey").alias("place"), (F.col("n_nationkey") * F.lit(1.5)).cast("double").alias("lat"), F.lit(0.0).alias("lon"))
    known = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("place")).agg(F.min("s_suppkey").cast("double").alias("lat")).withColumn("lon", F.lit(0.0))
    return V.geocoded(places, "place", cache, lambda asked: known.join(asked, "place", "left_semi")).select("c_custkey", "path", "lat")


@query("optimizer_adapter", f"""WITH {BASE}, full_ AS (SELECT basket_id, min(chain_id) AS chain_id FROM options WHERE missing_item_count = 0 GROUP BY 1)
  SELECT basket_id, chain_id, 'solver' AS solved_by FROM full_ UNION ALL SELECT basket_id, chain_id, 'fallback' FROM single ANTI JOIN full_ USING (basket_id)""")
def optimizer_adapter(spark, d):
    """A solver that only takes chains with every item, and the best single chain for baskets that no chain has whole."""
    options, names = _options(spark, d)

    def solver(problems):
        g = problems.filter("missing_item_count = 0").groupBy("basket_id").agg(F.min("chain_id").alias("chain_id"))
        return g.withColumn("feasible", F.col("chain_id").isNotNull())

    return _named(V.optimised(options, "basket_id", solver, lambda rest: B.best_single(rest).select("basket_id", "chain_id")), names)

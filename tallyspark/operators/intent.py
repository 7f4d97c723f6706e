"""What a shopper's list means: families with their attributes, defaults from preferences, items matched to products by names and markers, and joins of ingredients to products by terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions.money import exact_sum, rate, rounded
from tallyspark.functions.text import tokens
from tallyspark.operators.basket import offer_lists, offers_of
from tallyspark.operators.pairs import ListBlock, pairs

#: How far the first family must be ahead, and the least confidence of a preference that becomes a default. Fixed values.
FAMILY_GAP, LEAST_PREFERENCE = 0.4, 0.7
#: Confidence of an ingredient's product by an equal name, an equal alias or a contained term, what an equal category and attribute add, and the most. Fixed values, in hundredths.
EXACT, ALIAS, CONTAINED, CATEGORY, ATTRIBUTE, MOST = 96, 88, 84, 6, 4, 99


def words(x: Column) -> Column:
    return F.array_distinct(tokens(F.lower(x)))


def resolve_intent(queries: DataFrame, terms: DataFrame, values: DataFrame, required: DataFrame, preferences: DataFrame, gap: float = FAMILY_GAP, least: float = LEAST_PREFERENCE) -> DataFrame:
    """Per query: status, family, resolved (attribute=value of the text), defaults (of preferences, for attributes that the text doesn't say) and missing (required, neither said nor defaulted), each sorted and joined by commas.

    queries: query_id, owner_id, text. terms: family, term, weight. values: family, attribute, word, value. required: family, attribute. preferences: owner_id, family, attribute, value, confidence.
    status: unresolved (no family), family_ambiguous (two families close), needs_clarification (something missing) or ready_for_product_selection. Of several values of one attribute the first in the text counts; of several
    preferences the most confident, then the least value. Queries without words are unresolved.
    """
    said = queries.select("query_id", "owner_id", F.posexplode_outer(tokens(F.lower(F.coalesce("text", F.lit(""))))).alias("pos", "word"))
    hits = said.select("query_id", F.col("word").alias("term")).distinct().join(terms, "term")
    g = hits.groupBy("query_id", "family").agg(exact_sum(F.col("weight")).alias("score"))
    best = g.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "family"))), 1, 2).alias("top"))  # a query's families are no more than its words' terms
    close = (F.size("top") > 1) & (F.get("top", F.lit(1))["minus"] - F.get("top", F.lit(0))["minus"] < gap)
    chosen = best.select("query_id", F.when(close, F.lit(None)).otherwise(F.get("top", F.lit(0))["family"]).alias("family"), close.alias("close"))
    rows = queries.select("query_id", "owner_id").join(chosen, "query_id", "left")
    found = said.join(chosen.filter("family is not null"), "query_id").join(values, ["family", "word"]).groupBy("query_id", "family", "attribute").agg(F.min(F.struct("pos", "value"))["value"].alias("value"))
    wanted = rows.filter("family is not null").join(required, "family").join(found.select("query_id", "attribute", F.col("value").alias("said")), ["query_id", "attribute"], "left")
    usual = preferences.filter(F.col("confidence") >= least).groupBy("owner_id", "family", "attribute").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "value"))["value"].alias("usual"))
    wanted = wanted.join(usual, ["owner_id", "family", "attribute"], "left")
    pair = lambda value: F.concat_ws("=", "attribute", value)
    listed = lambda test, value: F.array_join(F.array_sort(F.collect_list(F.when(test, value))), ",")
    no, yes = F.col("said").isNull(), F.col("said").isNotNull()
    per = wanted.groupBy("query_id").agg(listed(no & F.col("usual").isNotNull(), pair("usual")).alias("defaults"), listed(no & F.col("usual").isNull(), F.col("attribute")).alias("missing"))
    resolved = found.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(pair("value"))), ",").alias("resolved"))
    out = rows.join(per, "query_id", "left").join(resolved, "query_id", "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    status = F.when(F.coalesce("close", F.lit(False)), "family_ambiguous").when(F.col("family").isNull(), "unresolved").when(text("missing") != "", "needs_clarification").otherwise("ready_for_product_selection")
    return out.select("query_id", status.alias("status"), "family", text("resolved").alias("resolved"), text("defaults").alias("defaults"), text("missing").alias("missing"))


def match_list(items: DataFrame, products: DataFrame) -> DataFrame:
    """Scores of list items and the products that share a word with them: item_id, product_id, score above 0. Pairs come from an equi-join on words.

    items: item_id, name (normalised), base_hint, category_hint, volume, count (null where the item doesn't say). products: product_id, name, base_product, category, brand, volume, count, confidence.
    """
    found = pairs(*_list_sides(items, products), kind=ListBlock).filter("score > 0")
    return found.select(F.col("query_id").alias("item_id"), "product_id", "score")


def _list_sides(items: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items and products with their words, as pairs takes them."""
    asked = items.withColumn("q_tokens", words(F.col("name"))).withColumnsRenamed({"item_id": "query_id", "name": "q_name"})
    return asked, products.withColumn("tokens", words(F.concat_ws(" ", "name", "base_product", "brand")))


def list_policies(items: DataFrame, products: DataFrame, prices: DataFrame, gap: float = 0.15) -> DataFrame:
    """item_id, strict_status, strict_product, best_product, cheapest_product: what each policy of ambiguity_policy takes. The items' best scores come first, then only candidates close to them leave a task, and are counted there.

    prices: product_id, price; products without one are no candidates.
    """
    asked, own = _list_sides(items, products)
    own = own.join(prices.select("product_id", "price"), "product_id")
    first = pairs(asked, own.drop("price"), top=1, kind=ListBlock).filter("score > 0").groupBy("query_id").agg(F.max("score").alias("top"))
    rows = pairs(asked.join(first, "query_id"), own, carry=("top", "price"), kind=ListBlock, gap=gap).filter("score > 0")
    g = rows.groupBy(F.col("query_id").alias("item_id")).agg(F.count("*").alias("n"), F.min("product_id").alias("one"), F.min(F.struct((-F.col("score")).alias("s"), "product_id"))["product_id"].alias("best"), F.min(F.struct("price", "product_id"))["product_id"].alias("cheapest"))
    return g.select("item_id", F.when(F.col("n") > 1, "clarify").otherwise("ready").alias("strict_status"), F.when(F.col("n") == 1, F.col("one")).alias("strict_product"), F.col("best").alias("best_product"), F.col("cheapest").alias("cheapest_product"))


def ingredient_products(ingredients: DataFrame, products: DataFrame) -> DataFrame:
    """ingredient_id, product_id and confidence of products whose name is an ingredient's name or alias, or holds one of them as whole words. The first word of a term routes the pairs; a product's words are few.

    ingredients: ingredient_id, name, aliases, category, attribute. products: product_id, name, category, attributes. The best of several terms counts; nulls match nothing.
    """
    split = lambda x: F.filter(F.split(x, " "), lambda t: t != "")
    term = F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))
    terms = ingredients.select("ingredient_id", F.col("name").alias("i_name"), F.col("category").alias("i_category"), "attribute", term.alias("term")).withColumn("__w", F.get(split(F.col("term")), F.lit(0)))
    own = products.select("product_id", "name", "category", "attributes", F.explode(F.array_distinct(split(F.col("name")))).alias("__w"))
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    pairs = own.join(terms, "__w").filter(F.contains(pad("name"), pad("term")))
    base = F.when(F.col("name") == F.col("i_name"), EXACT).when(F.col("name") == F.col("term"), ALIAS).otherwise(CONTAINED)
    with_category = F.when(F.col("category") == F.col("i_category"), F.least(F.lit(MOST), base + CATEGORY)).otherwise(base)
    whole = F.when(F.array_contains("attributes", F.col("attribute")), F.least(F.lit(MOST), with_category + ATTRIBUTE)).otherwise(with_category)
    return pairs.groupBy("ingredient_id", "product_id").agg((F.max(whole).cast("double") / 100).alias("confidence"))


def coverage_rates(lines: DataFrame, mappings: DataFrame, nutrition: DataFrame, products: DataFrame) -> DataFrame:
    """How much of each recipe is mapped, weighed, has nutrition and has a product: the rates that promotion looks at, from the tables themselves.

    lines: recipe_id, line_id, text_key, grams. mappings: text_key, ingredient_id. nutrition, products: ingredient_id, in any number of rows. A key of several mappings takes the least ingredient.
    """
    one = mappings.groupBy("text_key").agg(F.min("ingredient_id").alias("ingredient_id"))
    has = lambda df, c: df.select("ingredient_id").distinct().withColumn(c, F.lit(True))
    rows = lines.join(one, "text_key", "left").join(has(nutrition, "__n"), "ingredient_id", "left").join(has(products, "__p"), "ingredient_id", "left")
    n, of = F.count("*"), lambda test: rate(F.count_if(test), F.count("*"))
    g = rows.groupBy("recipe_id").agg(n.alias("ingredient_count"), of(F.col("ingredient_id").isNotNull()).alias("match_rate"), of(F.col("grams") > 0).alias("grams_rate"), of(F.coalesce("__n", F.lit(False))).alias("nutrition_rate"), of(F.coalesce("__p", F.lit(False))).alias("product_rate"))
    usable = F.when(F.col("match_rate") < 0.4, "dormant").when(F.col("match_rate") < 0.7, "needs_ingredient_mapping").when(F.col("nutrition_rate") <= 0, "needs_nutrition").otherwise("usable")
    return g.withColumn("usability", usable)


def plan_shopping(required: DataFrame, packages: DataFrame, prices: DataFrame) -> DataFrame:
    """From net requirements to a basket's chain: each item's cheapest package at each chain that sells one, then the chain by missing items, total and name.

    required: plan_id, ingredient_key, net_grams. packages: ingredient_key, product_id, package_grams. prices: product_id, chain_id, price. Gives plan_id, chain_id, items, priced, missing, total. Requirements of
    nothing are met; a plan whose items no chain sells has no chain.
    """
    wanted = required.filter("net_grams > 0")
    units = F.ceil(F.col("net_grams") / F.col("package_grams"))
    # a product's offers move as lists, so that rows multiply only where a plan's lines already are
    lists = offer_lists(prices.withColumnRenamed("product_id", "canonical_product_id")).withColumnRenamed("canonical_product_id", "product_id")
    rows = wanted.join(packages, "ingredient_key").join(lists, "product_id").repartition("plan_id")
    lines = rows.select("plan_id", "ingredient_key", "product_id", units.alias("units"), F.explode(offers_of()).alias("o")).select("plan_id", "ingredient_key", "product_id", "o.chain_id", rounded(F.col("units") * F.col("o.price")).alias("line"))
    per = lines.groupBy("plan_id", "ingredient_key", "chain_id").agg(F.min(F.struct("line", "product_id"))["line"].alias("line"))
    chains = per.groupBy("plan_id", "chain_id").agg(F.count("*").alias("priced"), rounded(exact_sum(F.col("line"))).alias("total"))
    sizes = wanted.groupBy("plan_id").agg(F.count("*").alias("items"))
    best = chains.groupBy("plan_id").agg(F.min(F.struct((-F.col("priced")).alias("minus"), "total", "chain_id")).alias("b"))
    out = sizes.join(best, "plan_id", "left")
    return out.select("plan_id", F.col("b.chain_id").alias("chain_id"), "items", F.coalesce(-F.col("b.minus"), F.lit(0)).alias("priced"), (F.col("items") - F.coalesce(-F.col("b.minus"), F.lit(0))).alias("missing"), F.col("b.total").alias("total"))


def ambiguity_policy(candidates: DataFrame, policy: str, gap: float = 0.15) -> DataFrame:
    """What a basket takes for items with several candidates (item_id, product_id, score, price): strict leaves close ones open, best takes the best score, cheapest the least price among those within the gap of the best.

    Gives item_id, status (ready or clarify), product_id. Ties go to the smaller product.
    """
    if policy not in ("strict", "best", "cheapest"):
        raise ValueError(f"unknown policy {policy}")
    w = Window.partitionBy("item_id")
    rows = candidates.withColumn("__top", F.max("score").over(w)).filter(F.col("__top") - F.col("score") < gap)  # an item's candidates are few
    order = F.struct("price", "product_id") if policy == "cheapest" else F.struct((-F.col("score")).alias("s"), "product_id")
    g = rows.groupBy("item_id").agg(F.count("*").alias("n"), F.min(order)["product_id"].alias("product_id"))
    open_ = (F.col("n") > 1) & F.lit(policy == "strict")
    return g.select("item_id", F.when(open_, "clarify").otherwise("ready").alias("status"), F.when(~open_, F.col("product_id")).alias("product_id"))


def basket_notes(multi: DataFrame, single: DataFrame) -> DataFrame:
    """Explanations of a basket's choice: headline, notes (what speaks for it) and limitations (what it leaves open), each joined by '; '.

    multi: of best_multi. single: of best_single, with priced_item_count and missing_item_count.
    """
    rows = single.select("basket_id", "chain_id", "priced_item_count", "missing_item_count", F.col("actual_total").alias("single_total"), F.col("coverage_ratio").alias("single_coverage")).join(multi, "basket_id", "left")
    split = F.coalesce("recommended", F.lit(False))
    headline = F.when(split, F.format_string("Split over %d stores to save %.2f.", "store_count", "savings")).otherwise(F.format_string("Buy all at %s for %.2f.", "chain_id", "single_total"))
    notes = F.concat_ws("; ", F.when(split & (F.col("coverage_ratio") > F.col("single_coverage")), "more items are available"), F.when(split, F.format_string("%s costs %.2f", "chain_id", "single_total")), F.when(~split & F.col("combo").isNotNull() & (F.col("savings") > 0), F.format_string("a split would save %.2f only", "savings")))
    limits = F.concat_ws("; ", F.when(F.col("missing_item_count") > 0, F.format_string("%d items are not sold at %s", "missing_item_count", "chain_id")), F.when(F.col("combo").isNull(), "no second store sells any item"), F.when(split & (F.col("coverage_ratio") < 1), "some items are not sold at any of the stores"))
    return rows.select("basket_id", headline.alias("headline"), notes.alias("notes"), limits.alias("limitations"))

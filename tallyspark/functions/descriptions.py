"""Food descriptions ("Rice, white, long-grain, cooked (with salt)"): segments, qualifiers, the core food, and the key and score of a candidate for a cluster. Column expressions throughout.

Segments lie between commas outside parentheses: a fold over the text's pieces with the depth as state. Qualifiers are ordered lists of needles: the first value with a needle in the description counts.

Cases. A null description has no segments; its core food is `unknown`. Parentheses that don't match close at the end. Blanks are collapsed, letters lower-cased.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import collapse

# Needles of the qualifiers, in the order in which they count.
GRAIN = ("rice", "grain", "flour", "pasta", "noodles", "wheat", "oats", "barley")
STATE = (("dried", " dried", "freeze-dried"), ("cooked", " cooked", "pre-cooked"), ("raw", " raw"))
PRESERVATION = (("canned", " canned"), ("frozen", " frozen"), ("dried", " dried", "freeze-dried"))
FORM = (("juice", "juice"), ("sauce", "applesauce", " sauce"), ("pie_filling", "pie filling", "pie fillings"))
GRAIN_STATE = (("dry", " dry, raw", " dry ", "dried"), ("cooked", " cooked"), ("raw", "raw"))
COOKING = (("pan_fried", "pan-fried"), ("fried", "fried"), ("baked", "baked"), ("boiled", "boiled"), ("braised", "braised"), ("grilled", "grilled"), ("broiled", "broiled"), ("roasted", "roasted"), ("microwaved", "microwaved"))
SWEETENED = (("unsweetened", "unsweetened", "no sugar added", "without sugar"), ("sweetened", "sweetened", "sugar added", "with sugar"))
SALTED = (("unsalted", "without salt", "without added salt", "no salt added", "unsalted"), ("salted", "with salt", "salt added", "sodium added", "regular pack"))
DRAINED = (("solids_and_liquids", "solids and liquids"), ("drained_rinsed", "drained and rinsed"), ("drained", "drained solids", "drained,", " drained"))
SKIN = (("with_skin", "with skin", "skin eaten"), ("without_skin", "without skin", "skinless", "skin not eaten"))
BONE = (("bone_in", "bone-in", "bone in"), ("boneless", "boneless"))
BREADED = (("breaded", "breaded", "breading"),)
MILK_FAT = (("whole_3_25", "whole, 3.25% milkfat", "whole milk", "milk, whole"), ("reduced_fat_2", "reduced fat", "2% milkfat"), ("lowfat_1", "lowfat", "1% milkfat"), ("nonfat_skim", "nonfat", "fat free", "skim"))
FAT = (("lean_only", "lean only"), ("lean_and_fat", "lean and fat"), ("fat_free", "fat-free", "fat free"))
CUTS = ("breast", "thigh", "drumstick", "wing", "loin", "tenderloin", "round", "shoulder", "leg")
VARIETIES = ("red delicious", "honeycrisp", "granny smith", "gala", "fuji", "shiitake", "white button", "oyster", "portabella", "king oyster", "enoki", "crimini", "lion's mane")
UNCLEAR = (" nfs", " ns ", "not specified", "ns as to")
MADE = ("restaurant,", "fast food", "prepared", "entree")
#: The boundaries of a cluster, by the names that its key gives them.
BOUNDARIES = {
    "form": "form", "state": "state", "cook": "cooking_method", "preserve": "preservation_method", "grain_form": "grain_form", "grain_state": "grain_state", "milk_fat": "milk_fat_level", "fat": "fat_level",
    "skin": "skin_state", "bone": "bone_state", "breaded": "breading_state", "sweet": "sweetened_status", "salt": "salted_status", "drained": "drained_status", "cut": "cut_or_part", "species": "species_or_variety",
}


def segments(x: Column) -> Column:
    """Parts between commas outside parentheses, trimmed, none empty."""
    pieces = F.regexp_extract_all(x, F.lit(r"([^(),]+|[(),])"), 1)
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, piece: Column) -> Column:
        depth = F.when(piece == "(", acc["depth"] + 1).when(piece == ")", F.greatest(F.lit(0), acc["depth"] - 1)).otherwise(acc["depth"])
        ends = (piece == ",") & (acc["depth"] == 0)
        part = F.when(ends, "").otherwise(F.concat(acc["part"], piece))
        return F.struct(depth.alias("depth"), part.alias("part"), F.when(ends, F.array_append(acc["parts"], acc["part"])).otherwise(acc["parts"]).alias("parts"))

    parts = F.aggregate(pieces, start, step, lambda acc: F.array_append(acc["parts"], acc["part"]))
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def holds(x: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(x, F.lit(n)) for n in needles])


def first_value(x: Column, values: tuple[tuple[str, ...], ...]) -> Column:
    """The first value with a needle in x."""
    return F.coalesce(*[F.when(holds(x, needles), value) for value, *needles in values], F.lit(None).cast("string"))


def slug(x: Column) -> Column:
    spelled = F.replace(F.replace(x, F.lit("%"), F.lit(" percent ")), F.lit("&"), F.lit(" and "))
    return F.regexp_replace(F.regexp_replace(F.lower(spelled), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def with_description(df: DataFrame, text: str) -> DataFrame:
    """df with `food`: segments, all qualifiers, flags, core_food, signature of the hard boundaries and candidate_key."""
    out = df.withColumn("__d", collapse(F.lower(F.coalesce(text, F.lit("")))))
    out = out.withColumn("__s", segments(F.col("__d"))).withColumn("__grain", holds(F.col("__d"), GRAIN))
    d, s, grain = F.col("__d"), F.col("__s"), F.col("__grain")
    at = lambda i: F.coalesce(F.get("__s", F.lit(i)), F.lit(""))
    flour = F.contains(d, F.lit(" flour")) | (at(0) == "flour")
    made = {
        "state": first_value(d, STATE),
        "form": F.when(flour, "flour").otherwise(first_value(d, FORM)),
        "cooking_method": first_value(d, COOKING),
        "preservation_method": first_value(d, PRESERVATION),
        "grain_form": F.when(flour, "flour").when(grain & holds(d, (" kernel", "kernels", "grain")), "kernel"),
        "grain_state": F.when(grain, first_value(d, GRAIN_STATE)),
        "sweetened_status": first_value(d, SWEETENED),
        "salted_status": first_value(d, SALTED),
        "drained_status": first_value(d, DRAINED),
        "skin_state": first_value(d, SKIN),
        "bone_state": first_value(d, BONE),
        "breading_state": first_value(d, BREADED),
        "milk_fat_level": first_value(d, MILK_FAT),
        "fat_level": F.coalesce(first_value(d, MILK_FAT), first_value(d, FAT)),
        "cut_or_part": F.coalesce(*[F.when(F.array_contains(s, c) | F.contains(d, F.lit(f" {c}")), c) for c in CUTS]),
        "species_or_variety": first_value(d, tuple((v, v) for v in VARIETIES)),
        "unclear": holds(d, UNCLEAR),
        "made": holds(d, MADE),
    }
    out = out.withColumn("__q", F.struct(*[c.alias(k) for k, c in made.items()]))
    q = F.col("__q")
    level = F.when(q["form"].isin("juice", "sauce", "pie_filling"), "processed").when(q["breading_state"].isNotNull() | holds(d, ("nugget", "tenders", "restaurant")), "prepared").when(q["preservation_method"].isNotNull(), "preserved").otherwise("generic")
    marks = [F.when(q[name].isNotNull(), F.concat(F.lit(f"{label}:"), q[name])) for label, name in BOUNDARIES.items()]
    signature = F.coalesce(F.nullif(F.concat_ws("|", *marks), F.lit("")), F.lit("generic"))
    out = out.withColumns({"__core": _core(at, s, q), "__signature": signature, "__level": level})
    food = F.struct(s.alias("segments"), *[q[k].alias(k) for k in made], F.col("__level").alias("processing_level"), F.col("__core").alias("core_food"), F.col("__signature").alias("signature"), F.concat(slug(F.col("__core")), F.lit("__"), slug(F.col("__signature"))).alias("candidate_key"))
    return out.withColumn("food", food).drop("__d", "__s", "__grain", "__q", "__core", "__signature", "__level")


def _core(at, s: Column, q: Column) -> Column:
    """The core food: the first segment, with what the next ones say of it for some foods."""
    first, second, third = F.coalesce(F.nullif(at(0), F.lit("")), F.lit("unknown")), at(1), at(2)
    color = lambda colors, other: F.coalesce(*[F.when(F.array_contains(s, c) | F.contains(other, F.lit(c)), c) for c in colors], F.lit(None).cast("string"))
    colors = ("white", "brown", "black", "red")
    named = lambda name, more: F.concat_ws(" ", F.lit(name), more)
    grain = F.when(first == "wild rice", first).otherwise(F.concat_ws(" ", color(colors, second), F.lit("rice")))
    qualifies = lambda x: holds(x, ("raw", "cooked", "canned", "drained", "with salt", "without salt", "sodium added", "sugar added"))
    kinds = F.concat_ws(" ", *[F.when((x != "") & ~qualifies(x), x) for x in (second, third)])
    apple = F.when(q["form"] == "juice", "apple juice").when(q["form"] == "sauce", "applesauce").when(q["form"] == "pie_filling", "apple pie filling").otherwise(named("apple", q["species_or_variety"]))
    return (
        F.when(first.isin("apples", "apple"), apple)
        .when(first.isin("rice", "wild rice"), F.when(q["form"] == "flour", F.concat(grain, F.lit(" flour"))).otherwise(grain))
        .when((first == "flour") & F.contains(second, F.lit("rice")), F.concat_ws(" ", color((*colors, "glutinous"), third), F.lit("rice flour")))
        .when(first == "milk", named("milk", q["milk_fat_level"]))
        .when(first.isin("mushrooms", "mushroom"), named("mushroom", q["species_or_variety"]))
        .when(first == "chicken", named("chicken", q["cut_or_part"]))
        .when(first == "beans", named("beans", F.nullif(kinds, F.lit(""))))
        .otherwise(first)
    )


def candidate_score(food: Column, data_type: Column, has_macros: Column) -> Column:
    """struct of score, confidence and review_status of a food as the one that stands for its cluster."""
    score = F.when(data_type == "foundation_food", 50).when(data_type == "sr_legacy_food", 35).otherwise(0) + F.when(has_macros, 20).otherwise(0)
    score = score + F.when(food["state"] == "raw", 10).otherwise(0) + F.when(F.size(food["segments"]) <= 5, 8).otherwise(0)
    score = score - F.when(food["salted_status"] == "salted", 8).otherwise(0) - F.when(food["sweetened_status"] == "sweetened", 8).otherwise(0)
    score = score - F.when(food["breading_state"] == "breaded", 12).otherwise(0) - F.when(food["unclear"] | food["made"], 15).otherwise(0)
    confidence = F.when(score >= 75, "high").when(score >= 55, "medium").otherwise("low")
    return F.struct(score.alias("score"), confidence.alias("confidence"), F.when(score >= 75, "candidate").otherwise("needs_review").alias("review_status"))

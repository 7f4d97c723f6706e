"""Markers in product names: stages, counts, ages, reserves, years, volumes, flavours, colours, packs and ranges, by ordered rules with guards, and the key of a canonical product.

A rule is data: a pattern over one of two normalised forms of the name, what its groups become, and what must hold besides (a context that the name shows, a marker found before, or the lack of one).
Of a marker's rules the first that fits counts, wherever in the name it fits. Rules are compiled to one column expression a marker; the forms and contexts that
they share are computed once a row, and all markers of a name come from one pass.

Cases. A null name has no markers. Word ends are those of letters and digits of any script.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.text import collapse, nfkc

B, E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"

# Words of contexts, units and markers.
FORMULA_WORDS = ("аптамил", "aptamil", "nan", "хумана", "humana", "pronutra", "formula", "формула", "адаптирано", "бебешко", "follow on", "toddler", "adapted", "мляко сухо", "сухо мляко")
AGE_WORDS = "kid kids child children baby babies infant infants toddler toddlers junior детск деца дете беб бебеш ganchev ганчев"
MONTH_WORDS = "baby babies infant infants toddler toddlers ganchev ганчев беб бебеш"
DRINK_WORDS = "wine vino whiskey whisky rakia rakija vodka gin rum brandy cognac liqueur likyor beer bira champagne prosecco vermouth вино уиски ракия водка джин ром бренди коняк ликьор бира просеко вермут"
UNITS = {"ml": "ml мл милилитър милилитра", "cl": "cl", "l": "l л литър литра", "kg": "kg кг килограм килограма", "g": "g gr гр г грам грама"}
IN_BASE = {"ml": ("ml", 1.0), "cl": ("ml", 10.0), "l": ("ml", 1000.0), "kg": ("g", 1000.0), "g": ("g", 1.0)}
PIECES = "бр брой броя br pcs pc pieces piece count"
FLAVORS = "vanilla vanil chocolate choco cocoa strawberry banana apple orange peach berry fruit mint herbal lavender rose watermelon cola лимон ягода банан ванилия шоколад какао праскова портокал ябълка мента билк лаванд роза диня кола плод"
COLORS = "blue pink green red black white yellow orange purple violet turquoise gray grey silver gold син синя синьо розов розова розово зелен зелена зелено червен червена червено черен черна черно бял бяла бяло жълт жълта жълто оранжев оранжева лилав лилава лилаво тюркоаз сив сива сиво сребрист златист"
YEARS, MONTHS = "години|година|год|years?|yrs?|y", "месеца|месец|мес|months?|mos?|m"
OF_COUNT = rf"^(?:бр|брой|броя|br|pcs?|pieces?|count|pack|set)$|^x\d{{1,3}}$|^\d{{1,3}}[xх]\d"
OF_AGE = r"^(?:год|години|година|years?|yrs?|months?|mos?|мес|месеца|месец)$"
OF_RESERVE = r"^(?:reserve|reserv|reserva|aged|matured|yo|резерв|отлежала|отлежало|отлежал|отлежали)$"


def any_of(words: str) -> str:
    return "|".join(sorted(words.split(), key=len, reverse=True))


UNIT, NUMBER, TWO = any_of(" ".join(UNITS.values())), r"(\d+(?:[.,]\d+)?)", r"(\d{1,2})"
Group = Callable[[int], Column]


@dataclass(frozen=True)
class Rule:
    """value: a template of groups ({1}, or {1:int} without leading zeros), or a function of them. guard: names of contexts and markers that must hold, or with ! must not."""

    pattern: str
    value: str | Callable[[Group], Column] = "{1}"
    guard: str = ""
    text: str = "variant"


def compiled(rule: Rule, known: dict[str, Column]) -> Column:
    """The rule's value, or null. known: texts, contexts and markers by name."""
    text = known[rule.text]
    group = lambda i: F.regexp_extract(text, rule.pattern, i)
    if callable(rule.value):
        value = rule.value(group)
    else:
        parts = [p for p in re.split(r"(\{\d(?::int)?\})", rule.value) if p]
        cut = lambda p: group(int(p[1])).cast("int").cast("string") if ":int" in p else group(int(p[1]))
        value = F.concat(*[cut(p) if p.startswith("{") else F.lit(p) for p in parts])
    fits = F.rlike(text, F.lit(rule.pattern))
    for name in rule.guard.split():
        holds = known[name.lstrip("!")]
        fits = fits & (~holds if name.startswith("!") else holds)
    return F.when(fits, value)


def first_of(rules: tuple[Rule, ...], known: dict[str, Column]) -> Column:
    return F.coalesce(*[compiled(r, known) for r in rules], F.lit(None).cast("string"))


def thousandths(x: Column) -> Column:
    return F.floor(x * 1000 + 0.5).cast("double") / 1000


def plain_number(x: Column) -> Column:
    """To three places, without zeros at the end."""
    return F.regexp_replace(F.format_string("%.3f", x), r"\.?0+$", "")


def in_base(number: Column, unit: Column) -> tuple[Column, Column]:
    """A quantity as written, in grams or millilitres, and that unit; null if it isn't above 0."""
    value = F.regexp_replace(number, ",", ".").try_cast("double")
    quantity, base = F.lit(None).cast("double"), F.lit(None).cast("string")
    for name, (to, factor) in IN_BASE.items():
        is_it = unit.isin(*UNITS[name].split())
        quantity, base = F.when(is_it & (value > 0), thousandths(value * factor)).otherwise(quantity), F.when(is_it, to).otherwise(base)
    return quantity, base


def volume(number: int, unit: int | str) -> Callable[[Group], Column]:
    def value(group: Group) -> Column:
        quantity, base = in_base(group(number), F.lit(unit) if isinstance(unit, str) else group(unit))
        return F.when(quantity.isNotNull(), F.concat(plain_number(quantity), base))

    return value


def span(group: Group) -> Column:
    """Two numbers and the unit behind them, by its usual sign."""
    sign = F.when(group(3) == "", "").when(group(3).isin("кг", "kg"), "kg").when(group(3).isin("мл", "ml"), "ml").when(group(3).isin("л", "l"), "l").otherwise("g")
    return F.concat(group(1), F.lit("-"), group(2), sign)


#: What a name can show, as a pattern over one of its forms.
CONTEXTS = {
    "formula": ("canonical", "|".join(FORMULA_WORDS)),
    "age": ("variant", rf"{B}(?:{any_of(AGE_WORDS)}){E}"),
    "months": ("variant", rf"{B}(?:{any_of(MONTH_WORDS)}){E}"),
    "drink": ("variant", rf"{B}(?:{any_of(DRINK_WORDS)}){E}"),
}
OVER = rf"{B}(?:над|over|above|from)\s*{TWO}\s*"
IMPLICIT_SPAN, IMPLICIT_PLUS = rf"{B}{TWO}\s*-\s*{TWO}{E}", rf"{B}{TWO}\s*\+(?:\s|$)"
#: Markers in the order in which they are found, each with its rules in order.
MARKERS: dict[str, tuple[Rule, ...]] = {
    "stage": tuple(
        Rule(p, "stage_{1}", "formula", "canonical") for p in (rf"{B}(?:stage|етап|номер|no)\s*([1-4]){E}", rf"{B}([1-4])\s*(?:stage|етап){E}", rf"{B}адаптирано\s*([1-4]){E}", rf"{B}([1-4]){E}")
    ),
    "count": tuple(Rule(p, "{1:int}") for p in (rf"{B}x\s*(\d{{1,3}}){E}", rf"{B}(\d{{1,3}})\s*[xх]\s*\d", rf"{B}(\d{{1,3}})\s*(?:{any_of(PIECES)}){E}", rf"{B}pack\s*of\s*(\d{{1,3}}){E}", rf"{B}set\s*of\s*(\d{{1,3}}){E}")),
    "age_band": (
        Rule(rf"{OVER}(?:{MONTHS}){E}", "{1}+m"),
        Rule(rf"{OVER}(?:{YEARS}){E}", "{1}+y"),
        Rule(rf"{B}{TWO}\s*(?:{MONTHS}|м)\s*\+", "{1}+m"),
        Rule(rf"{B}{TWO}\s*(?:{YEARS})\s*\+", "{1}+y"),
        Rule(rf"{B}{TWO}\s*-\s*{TWO}\s*(?:{YEARS}){E}", "{1}-{2}y"),
        Rule(rf"{B}{TWO}\s*\+\s*(?:{YEARS}){E}", "{1}+y"),
        Rule(rf"{B}{TWO}\s*-\s*{TWO}\s*(?:{MONTHS}|м){E}", "{1}-{2}m"),
        Rule(rf"{B}{TWO}\s*\+\s*(?:{MONTHS}|м){E}", "{1}+m"),
        Rule(IMPLICIT_SPAN, "{1}-{2}m", "age months"),
        Rule(IMPLICIT_SPAN, "{1}-{2}y", "age !months"),
        Rule(IMPLICIT_PLUS, "{1}+m", "age months"),
        Rule(IMPLICIT_PLUS, "{1}+y", "age !months"),
    ),
    "age_statement": tuple(
        Rule(p, "{1}y", "!age_band") for p in (rf"{B}(?:над|over|above)\s*{TWO}\s*(?:{YEARS}){E}", rf"(?:^|[^0-9+\-/]){TWO}\s*(?:години|година|год|years?|yrs?|yo)(?!\s*[-+/]\s*\d)", rf"{B}{TWO}\s*[gy]\.o\.")
    ),
    "reserve": (
        Rule(rf"{B}(?:reserva|reserve|reserv|aged|matured|резерв\p{{L}}*|отлежал\p{{L}}*)\s*{TWO}{E}", "{1:int}"),
        Rule(rf"{B}{TWO}\s*(?:yo|y\.o\.){E}", "{1:int}"),
        Rule(rf"{B}{TWO}\s*(?:years?|yrs?){E}", "{1:int}", "drink"),
        Rule(rf"{B}{TWO}\s*годиш(?:ен|на|но|ни)?{E}", "{1:int}", "drink"),
    ),
    "year": (Rule(rf"{B}(19\d\d|20\d\d){E}"),),
    "volume": (Rule(rf"{B}{NUMBER}\s*({UNIT}){E}", volume(1, 2)), Rule(rf"{B}((?:0?\d|10)[.,]\d{{2,3}}){E}", volume(1, "l"), "drink")),
    "flavor": tuple(Rule(re.escape(w), lambda group, w=w: F.lit(w), "", "canonical") for w in FLAVORS.split()),
    "color": tuple(Rule(re.escape(w), lambda group, w=w: F.lit(w), "", "canonical") for w in COLORS.split()),
    "pack": (Rule("^", lambda group: F.concat(F.lit("count_"), F.col("__count")), "count"), *[Rule(p, "count_{1}", "", "canonical") for p in (rf"{B}(\d{{1,3}})\s*(?:{any_of(PIECES)}){E}", rf"{B}pack\s*of\s*(\d{{1,3}}){E}", rf"{B}set\s*of\s*(\d{{1,3}}){E}")]),
    "range": (Rule(rf"{B}(\d{{2,4}})\s*[-/–]\s*(\d{{2,4}})\s*(кг|kg|гр|г|gr|g|мл|ml|л|l)?{E}", span),),
}


def canonical_text(x: Column, compose: bool = False) -> Column:
    """Lower case; letters, digits and % stay, all else is a blank."""
    return collapse(F.regexp_replace(F.lower(nfkc(x) if compose else x), r"[^\p{L}\p{N}%]+", " "))


def variant_text(x: Column, compose: bool = False) -> Column:
    """Lower case with the signs that numbers are written with."""
    return collapse(F.regexp_replace(F.lower(nfkc(x) if compose else x), r"[^\p{L}\p{N}%+,./–-]+", " "))


def with_markers(df: DataFrame, name: str, compose: bool = False) -> DataFrame:
    """df with `markers`, a struct of all markers of the named column (null where a name doesn't have one). compose: NFKC first, by a pandas function."""
    out = df.withColumns({"__variant": variant_text(F.col(name), compose), "__canonical": canonical_text(F.col(name), compose)})
    out = out.withColumns({f"__in_{c}": F.rlike(f"__{text}", F.lit(p)) for c, (text, p) in CONTEXTS.items()})
    known = {"variant": F.col("__variant"), "canonical": F.col("__canonical")} | {c: F.col(f"__in_{c}") for c in CONTEXTS}
    for marker, rules in MARKERS.items():
        out = out.withColumn(f"__{marker}", first_of(rules, known))
        known[marker] = F.col(f"__{marker}").isNotNull()
    return out.withColumn("markers", F.struct(*[F.col(f"__{m}").alias(m) for m in MARKERS])).drop("__variant", "__canonical", *[f"__in_{c}" for c in CONTEXTS], *[f"__{m}" for m in MARKERS])


def size_marker(x: Column) -> Column:
    """struct of quantity, unit, total_quantity, pack_count and display of a package ("2 pcs x 500 g / total 1000 g") or a single size ("500 g"), else null; x: variant text."""
    single = rf"{B}{NUMBER}\s*({UNIT}){E}"
    packs = (rf"{B}(\d{{1,3}})\s*(?:{any_of(PIECES)})\.?\s*[xх]\s*{NUMBER}\s*({UNIT}){E}", rf"{B}(\d{{1,3}})\s*[xх]\s*{NUMBER}\s*({UNIT}){E}")
    group = lambda pattern, i, name: F.regexp_extract(x, pattern, i).alias(name)
    raw = [F.when(F.rlike(x, F.lit(p)), F.struct(group(p, 1, "count"), group(p, 2, "number"), group(p, 3, "unit"))) for p in packs]
    raw.append(F.when(F.rlike(x, F.lit(single)), F.struct(F.lit(None).cast("string").alias("count"), group(single, 1, "number"), group(single, 2, "unit"))))

    def measured(r: Column) -> Column:
        quantity, unit = in_base(r["number"], r["unit"])
        return F.struct(r["count"].cast("int").alias("count"), quantity.alias("quantity"), unit.alias("unit"))

    def shown(m: Column) -> Column:
        one = F.concat(plain_number(m["quantity"]), F.lit(" "), m["unit"])
        total = thousandths(m["quantity"] * F.coalesce(m["count"], F.lit(1)))
        display = F.when(m["count"].isNull(), one).otherwise(F.concat(m["count"].cast("string"), F.lit(" pcs x "), one, F.lit(" / total "), plain_number(total), F.lit(" "), m["unit"]))
        return F.struct(m["quantity"].alias("quantity"), m["unit"].alias("unit"), total.alias("total_quantity"), m["count"].alias("pack_count"), display.alias("display"))

    # the first that is a quantity; lists of one keep each step's value for the next
    found = F.transform(F.array_compact(F.array(*raw)), measured)
    found = F.filter(found, lambda m: m["quantity"].isNotNull() & (m["count"].isNull() | (m["count"] > 0)))
    return F.get(F.transform(F.slice(found, 1, 1), shown), F.lit(0))


def core_tokens(tokens: Column, brand: Column, markers: Column, size: Column | None = None, percent: Column | None = None) -> Column:
    """What a name is about: distinct tokens in order, without the brand's, numbers, ranges, sizes, units, and those that only state a marker that was found."""
    of_brand = F.split(canonical_text(F.coalesce(brand, F.lit(""))), " ")
    number = rf"^\d+(?:[.,]\d+)?%?$|^\d{{2,4}}\s*[-/–]\s*\d{{2,4}}\p{{L}}*$|^\d+(?:[.,]\d+)?(?:{UNIT})$|^(?:{UNIT})$"

    def stays(t: Column) -> Column:
        out = (t != "") & ~F.array_contains(of_brand, t) & ~F.rlike(t, F.lit(number))
        out = out & ~(markers["count"].isNotNull() & F.rlike(t, F.lit(OF_COUNT)))
        out = out & ~((markers["age_band"].isNotNull() | markers["age_statement"].isNotNull()) & F.rlike(t, F.lit(OF_AGE)))
        out = out & ~(markers["reserve"].isNotNull() & F.rlike(t, F.lit(OF_RESERVE)))
        for x in (size, percent):
            if x is not None:
                out = out & ~F.coalesce(t == plain_number(x), F.lit(False))
        return out

    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, lambda t: canonical_text(t)), stays)))


#: The parts of a canonical product's key: what each is called, and where it comes from; markers by their names.
KEY_PARTS = ("category", "type", "brand", "size", "fat", "stage", "count", "age_band", "reserve", "year", "age_statement", "volume", "flavor", "color", "pack", "range", "core")
KEY_NAMES = {"age_band": "age"}


def canonical_key(parts: dict[str, Column], markers: Column) -> Column:
    """The key of all seventeen parts, an unknown one as `unknown`. parts: category, type, brand, size, unit, fat, name (canonical text) and core (tokens)."""
    text = lambda x: F.when(x != "", x)
    known = lambda x: F.coalesce(x, F.lit("unknown"))
    number = lambda x: F.when(x.isNotNull(), plain_number(x))
    made = {"category": text(parts["category"]), "type": text(canonical_text(parts["type"])), "brand": text(canonical_text(parts["brand"])), "fat": number(parts["fat"]), "core": F.coalesce(text(F.array_join(parts["core"], "|")), text(parts["name"]))}
    made["size"] = F.concat(known(number(parts["size"])), F.lit(":"), known(parts["unit"]))
    return F.concat_ws("::", *[F.concat(F.lit(f"{KEY_NAMES.get(p, p)}:"), known(made[p] if p in made else markers[p])) for p in KEY_PARTS])

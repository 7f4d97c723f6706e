"""Product text: normalising, tokens, sizes and other markers, similarity of names. Column expressions but where noted."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Units as written, and the unit and factor they become; fixed values.
UNITS = {"g": ("g", 1.0), "kg": ("g", 1000.0), "ml": ("ml", 1.0), "cl": ("ml", 10.0), "l": ("ml", 1000.0)}
NUMBER = r"(\d+(?:[.,]\d+)?)"


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which Spark has no function for."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def collapse(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalise_name(x: Column, compose: bool = False) -> Column:
    """Lower case, full stops, commas and parentheses to blanks, blanks collapsed. compose: NFKC first, by a pandas function."""
    return collapse(F.regexp_replace(F.lower(nfkc(x) if compose else x), r"[.,()]+", " "))


def normalise_search(x: Column, compose: bool = False) -> Column:
    """Lower case; punctuation, brackets, quotes, colons and slashes to blanks, blanks collapsed."""
    return collapse(F.regexp_replace(F.lower(nfkc(x) if compose else x), r"""[.,!?()\[\]{}:/"'`]+""", " "))


def tokens(x: Column, stop: tuple[str, ...] = ()) -> Column:
    """Runs of letters, digits and %."""
    out = F.filter(F.split(x, r"[^\p{L}\p{N}%]+"), lambda t: t != "")
    return F.filter(out, lambda t: ~t.isin(*stop)) if stop else out


def split_items(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, r"[\n,;]"), lambda t: F.trim(t)), lambda t: t != "")


def _number(x: Column) -> Column:
    return F.regexp_replace(x, ",", ".").try_cast("double")


def size_of(x: Column) -> Column:
    """struct of value and unit of the first number with a unit, as written."""
    pattern = rf"(?i){NUMBER}\s*(kg|ml|cl|g|l)(?=\s|$|[.,)])"
    value, unit = F.regexp_extract(x, pattern, 1), F.lower(F.regexp_extract(x, pattern, 2))
    return F.when(value != "", F.struct(_number(value).alias("value"), unit.alias("unit")))


def base_quantity(size: Column) -> Column:
    """A size in grams or millilitres, to three places."""
    factor = F.create_map(*[F.lit(v) for u, (_, f) in UNITS.items() for v in (u, f)])
    return F.floor(size["value"] * factor[size["unit"]] * 1000 + 0.5).cast("double") / 1000


def multipack(x: Column) -> Column:
    """Packs and size in "6 x 330 ml", else null."""
    pattern = rf"(?i)(\d+)\s*[x*]\s*{NUMBER}\s*(kg|ml|cl|g|l)\b"
    n = F.regexp_extract(x, pattern, 1)
    return F.when(n != "", n.cast("long"))


def percent_of(x: Column) -> Column:
    found = F.regexp_extract(x, rf"{NUMBER}\s*%", 1)
    return F.when(found != "", _number(found))


def year_of(x: Column) -> Column:
    found = F.regexp_extract(x, r"(?:^|\D)((?:19|20)\d\d)(?:\D|$)", 1)
    return F.when(found != "", found.cast("int"))


def count_of(x: Column) -> Column:
    found = F.regexp_extract(x, r"(?i)(\d+)\s*(?:pcs|pieces|pack|count|ct)\b", 1)
    return F.when(found != "", found.cast("int"))


def range_of(x: Column) -> Column:
    """struct of low and high in "2-3"."""
    lo, hi = (F.regexp_extract(x, r"(\d+)\s*-\s*(\d+)", i) for i in (1, 2))
    return F.when((lo != "") & (lo.cast("int") < hi.cast("int")), F.struct(lo.cast("int").alias("low"), hi.cast("int").alias("high")))


def first_word_of(x: Column, words: tuple[str, ...]) -> Column:
    """The first of the listed words, in their order, that x holds (flavours, colours, packs)."""
    return F.coalesce(*[F.when(F.contains(x, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def product_type(x: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The type of the first pattern that fits."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(rules):
        out = F.when(F.rlike(x, F.lit(pattern)), kind).otherwise(out)
    return out


def aliases(name: Column, brand: Column, size_text: Column, percent_text: Column) -> Column:
    """The name, and the name without brand, size and percentage one after the other; distinct, none empty."""
    drop = lambda x, part: collapse(F.when(part.isNull() | (part == ""), x).otherwise(F.replace(x, part, F.lit(" "))))
    a = drop(name, brand)
    b = drop(a, size_text)
    c = drop(b, percent_text)
    return F.filter(F.array_distinct(F.array(name, a, b, c)), lambda t: t != "")


def brand_guess(raw: Column, name_tokens: Column, skip: Column) -> Column:
    """The first word of a raw name that can be a brand: one of the name's tokens, no number, no percentage and none of the words to skip, in Cyrillic letters, or in three
    or more capitals and digits. Full stops, commas and outer plus signs are left off.
    """
    word = F.transform(F.split(collapse(raw), r"\s+"), lambda t: F.regexp_replace(F.regexp_replace(t, r"[.,]", ""), r"^\++|\++$", ""))

    def fits(t):
        low = F.lower(t)
        plain = (t != "") & ~F.rlike(low, F.lit(r"^\d")) & ~F.contains(low, F.lit("%")) & ~F.array_contains(skip, low)
        return plain & F.array_contains(name_tokens, low) & (F.rlike(low, F.lit(r"\p{IsCyrillic}")) | F.rlike(t, F.lit(r"^[A-Z][A-Z0-9+-]{2,}$")))

    return F.get(F.filter(word, fits), F.lit(0))


#: Words that only state a unit; fixed values.
UNIT_WORDS = ("g", "kg", "ml", "cl", "l", "pcs", "pack", "count", "ct")


def core_tokens(name_tokens: Column, brand: Column) -> Column:
    """What a name is about: its distinct tokens in order, without the brand's, numbers, percentages, ranges, sizes and units."""
    of_brand = tokens(F.lower(F.coalesce(brand, F.lit(""))))
    number = r"^\d+(?:[.,]\d+)?%?$|^\d+(?:[.,]\d+)?(?:kg|ml|cl|g|l)$|^\d+-\d+$"
    kept = F.filter(name_tokens, lambda t: ~F.array_contains(of_brand, t) & ~F.rlike(t, F.lit(number)) & ~t.isin(*UNIT_WORDS))
    return F.array_sort(F.array_distinct(kept))


def all_words_of(x: Column, words: tuple[str, ...]) -> Column:
    """Every listed word that x holds, with where it starts (from 1), in the order of the list."""
    found = F.array(*[F.struct(F.lit(w).alias("word"), F.instr(x, w).alias("at")) for w in words])
    return F.filter(found, lambda f: f["at"] > 0)


def parse_confidence(kind: Column, size: Column, percent: Column, brand: Column) -> Column:
    """0.2, and 0.3, 0.2, 0.1, 0.2 for each that is known."""
    cents = F.lit(20) + F.when(kind.isNotNull(), 30).otherwise(0) + F.when(size.isNotNull(), 20).otherwise(0) + F.when(percent.isNotNull(), 10).otherwise(0) + F.when(brand.isNotNull(), 20).otherwise(0)
    return F.least(F.lit(100), cents).cast("double") / 100


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens by the larger set."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)), F.lit(1))


def not_shared(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def bare_name(x: Column) -> Column:
    """A name, normalised, without percentages and sizes."""
    return normalise_name(F.regexp_replace(F.regexp_replace(F.lower(x), rf"{NUMBER}\s*%", " "), rf"{NUMBER}\s*(?:kg|ml|g|l)(?=\s|$|[.,])", " "))


def name_drift(before: Column, after: Column) -> Column:
    """none, minor (equal without numbers and units, or four fifths of the tokens shared) or major."""
    a, b = bare_name(before), bare_name(after)
    return F.when(before.isNull() | (before == after), "none").when(a == b, "minor").when(overlap(tokens(a), tokens(b)) >= 0.8, "minor").otherwise("major")


#: When names differ much: more characters apart, or less of their tokens shared, or more tokens that one side lacks. Fixed values.
LENGTH_DELTA, LEAST_OVERLAP, MOST_APART = 8, 0.6, 1


def audit_name(x: Column) -> Column:
    """Lower case; letters, digits and % stay, all else is a blank."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^\p{L}\p{N}%]+", " "))


def differ_much(a: Column, b: Column) -> Column:
    """Whether two names are too far apart for one product: by their lengths, their shared tokens, or the tokens that one of them lacks. An empty or null name differs from none."""
    left, right = audit_name(a), audit_name(b)
    x, y = F.split(left, " "), F.split(right, " ")
    far = (F.abs(F.length(left) - F.length(right)) > LENGTH_DELTA) | (overlap(x, y) < LEAST_OVERLAP) | (not_shared(F.array_distinct(x), F.array_distinct(y)) > MOST_APART)
    return (left != "") & (right != "") & (left != right) & far


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(x, F.lit("")))), r"[^a-z0-9À-ɏЀ-ӿ]+", "-"), r"^-+|-+$", "")


def hash_of(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, where a null is empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)

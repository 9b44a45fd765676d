"""String expressions over food and product names; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import STOP_WORDS
from .numbers import col

NUMBER = r"(\d+(?:\.\d+)?)"
SIZES = r"\b(\d+(?:\.\d+)?\s*(?:g|kg|ml|l|oz|lb|pc|pack|kcal|kj))\b"
#: The ways a size is written, the first that is found counts.
SIZE_FORMS = [r"\d+\s*x\s*\d+\s*g\b", r"\d+(?:\.\d+)?\s*kg\b", r"\d+(?:\.\d+)?\s*g\b", r"\d+(?:\.\d+)?\s*ml\b", r"\d+(?:\.\d+)?\s*litre", r"\d+(?:\.\d+)?\s*l\b", r"\d+\s*pack\b", r"\d+\s*pint"]
#: Words that tell how a food is prepared.
COOKING = "fried|roasted|boiled|cooked|steamed|poached|microwaved|baked|canned|flesh|skin|raw|fresh|dry|dried"
#: Words that tell that a food is raw, and that it is cooked.
RAW_STATE = r"raw|dried|dry|uncooked|fresh$"
COOKED_STATE = "boiled|cooked|baked|fried|roasted|grilled|steamed|stewed"
#: Phrases that say nothing about a product.
STOP_PHRASES = ["by", "taste the difference", "finest", "extra special", "the", "fs"]


def _number(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).cast("double")


def weight_grams(c: Column | str) -> Column:
    """Grams (or millilitres) in a quantity: a multipack's product, else the first amount; null if there is none."""
    text = F.lower(col(c))
    many = r"(\d+)\s*[x*]\s*(\d+(?:\.\d+)?)\s*(g|kg|ml|l)"
    one = NUMBER + r"\s*(g|kg|ml|l)"
    scale = lambda unit: F.when(unit.isin("kg", "l"), 1000.0).otherwise(1.0)
    packs = _number(text, many, 1) * _number(text, many, 2) * scale(F.regexp_extract(text, many, 3))
    return F.coalesce(packs, _number(text, one, 1) * scale(F.regexp_extract(text, one, 2)))


def sizes_in(c: Column | str) -> Column:
    """All sizes in a lower-cased name, joined."""
    return F.array_join(F.regexp_extract_all(F.lower(col(c)), F.lit(SIZES), 1), " | ")


def plain_name(c: Column | str) -> Column:
    """Lower-cased name without sizes and signs; ``unknown`` if nothing is left."""
    text = F.regexp_replace(F.lower(col(c)), SIZES, " ")
    text = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9% ]", " "), r"\s+", " "))
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(text)


def first_size(c: Column | str) -> Column:
    """The text of the first size form that a name holds, in the forms' order."""
    text = F.lower(col(c))
    return F.coalesce(*(F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in SIZE_FORMS))


def size_grams(c: Column | str) -> Column:
    """A size's grams: kg, g, ml, l in this order; null for other units."""
    text = F.lower(col(c))
    found = lambda unit: _number(text, NUMBER + r"\s*" + unit)
    return F.coalesce(found("kg") * 1000, found("g"), found("ml"), found("l") * 1000)


def brand_of(c: Column | str, fallback: Column | str) -> Column:
    """What stands before the first " - ", else the fallback, else nothing."""
    at = F.instr(col(c), " - ")
    own = F.when(at > 0, F.nullif(F.trim(F.substr(col(c), F.lit(1), at - 1)), F.lit("")))
    return F.coalesce(own, col(fallback), F.lit(""))


def product_of(c: Column | str) -> Column:
    at = F.instr(col(c), " - ")
    return F.when(at > 0, F.trim(F.substr(col(c), at + 3))).otherwise(col(c))


def group_key(brand: Column | str, product: Column | str) -> Column:
    """brand::product without sizes, lower-cased."""
    bare = F.regexp_replace(F.lower(col(product)), r"\d+(?:\.\d+)?\s*(?:kg|g|ml|l|pint)\b", "")
    return F.concat_ws("::", F.lower(F.trim(F.coalesce(col(brand), F.lit("")))), F.trim(F.regexp_replace(bare, r"\s+", " ")))


def keywords(c: Column | str, stop: list[str] = STOP_WORDS) -> Column:
    """Words of three letters or more that mean something; none for a null."""
    text = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"\d+(?:\.\d+)?\s*(?:kg|g|ml|l|pint|pack)\b", "")
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9_\s]", " "), r"\s+", " ")), " ")
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(stop))


def without_brands(name: Column | str, brands: Column | str, phrases: list[str] = STOP_PHRASES) -> Column:
    """A name without its brands (split at "|", longer than 2) and stop phrases; as it was if its brands are blank or nothing is left."""
    name, brands = col(name), col(brands)
    parts = F.filter(F.transform(F.split(F.lower(brands), r"\|"), F.trim), lambda b: F.length(b) > 2)
    cut = F.aggregate(parts, F.lower(name), lambda acc, b: F.regexp_replace(acc, F.concat(F.lit(r"\b\Q"), b, F.lit(r"\E\b")), F.lit("")))
    for p in phrases:
        cut = F.regexp_replace(cut, rf"\b{p}\b", "")
    cut = F.trim(F.regexp_replace(F.regexp_replace(cut, "[-,]", " "), r"\s+", " "))
    return F.when(F.coalesce(F.trim(brands), F.lit("")) == "", name).when(cut == "", name).otherwise(cut)


def without_cooking(c: Column | str) -> Column:
    """A name up to its first part about preparation; whole if that leaves nothing."""
    base = F.trim(F.regexp_extract(col(c), rf"(?i)^(.*?),?\s*[^,]*?(?:{COOKING}).*$", 1))
    # A name without such a word is whole; the long pattern would try all its places.
    return F.when(~col(c).rlike(f"(?i){COOKING}"), col(c)).when(base == "", col(c)).otherwise(base)


def spelling_block(category: Column | str, name: Column | str) -> Column:
    """Category, or the first word of the name."""
    first = F.nullif(F.split(F.trim(F.coalesce(col(name), F.lit(""))), r"\s+")[0], F.lit(""))
    return F.coalesce(F.nullif(F.trim(col(category)), F.lit("")), F.concat(F.lit("__NOCAT_"), first), F.lit("__EMPTY__"))


def taxonomy_block(category: Column | str, kcal: Column | str, protein: Column | str) -> Column:
    """Category, or energy in hundreds and protein in tens, rounded half to even."""
    near = lambda c, by: (F.rint(F.coalesce(col(c), F.lit(0.0)) / by) * by).cast("int").cast("string")
    return F.coalesce(F.nullif(F.trim(col(category)), F.lit("")), F.concat(F.lit("__NOCAT_K"), near(kcal, 100), F.lit("_P"), near(protein, 10)))


def nutrition_bucket(kcal: Column | str, *macros: Column | str) -> Column:
    """Energy in twenties and macros in twos, cut off, joined."""
    step = lambda c, by: ((F.coalesce(col(c), F.lit(0.0)) / by).cast("int") * by).cast("string")
    return F.concat_ws("|", step(kcal, 20), *(step(m, 2) for m in macros))


def is_raw(c: Column | str) -> Column:
    return F.lower(col(c)).rlike(RAW_STATE)


def is_cooked(c: Column | str) -> Column:
    return F.lower(col(c)).rlike(COOKED_STATE)


def letters(c: Column | str) -> Column:
    """Runs of letters in a lower-cased name."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-zA-Z]+"), 0)


def with_size_mark(c: Column | str) -> Column:
    """A lower-cased name with [SIZE] for its sizes."""
    return F.regexp_replace(F.lower(col(c)), SIZES, "[SIZE]")


def unit_of(c: Column | str) -> Column:
    """A nutrient's unit, from its name."""
    c = col(c)
    # Nutrients in grams.
    grams = ["protein", "fat", "carbohydrate", "Sugar (g)", "Saturated Fat (g)", "Monounsaturated Fat (g)", "Polyunsaturated Fat (g)"]
    return F.when(c.isin(grams), "g").when(c.contains("(mg)"), "mg").when(c.contains("(mcg)"), "mcg").when(c.contains("(g)"), "g").otherwise("")


def serving_grams(size: Column | str, unit: Column | str) -> Column:
    """A serving's grams: g and ml as they are, ounces by 28.35; null for other units."""
    unit, size = F.lower(F.trim(col(unit))), col(size).try_cast("double")
    return F.when(unit.isin("g", "ml"), size).when(unit.isin("oz", "fl oz"), size * 28.35)

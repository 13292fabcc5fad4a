"""Text and number expressions: Column -> Column, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricewatch_spark.constants import MOVES, SOLD_OUT

MONEY = "decimal(12,2)"


def _empty_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def clean_text(c: Column) -> Column:
    """Whitespace collapsed and trimmed; null becomes ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def strip_html(c: Column) -> Column:
    """Tags become spaces, whitespace collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"(?U)\s+", " "))


def parse_price(c: Column) -> Column:
    """All digits read as one whole number (separators are dropped, decimals with them); else 0."""
    return F.coalesce(F.regexp_replace(c, "[^0-9]", "").try_cast(MONEY), F.lit(0).cast(MONEY))


def detect_out_of_stock(c: Column) -> Column:
    lowered = F.lower(c)
    found = F.lit(False)
    for marker in SOLD_OUT:
        found = found | lowered.contains(marker)
    return F.coalesce(found, F.lit(False))


def validate_ean(c: Column) -> Column:
    """12 or 13 digits, no check digit; integers are taken as their text."""
    trimmed = F.trim(c.cast("string"))
    return F.when(trimmed.rlike("^[0-9]{12,13}$"), trimmed)


def split_ean_sku(c: Column) -> Column:
    """struct(barcode, sku): a 13-digit prefix with something behind it is the barcode."""
    hit = c.rlike(r"^\d{13}.+$")
    return F.struct(
        F.when(hit, F.regexp_extract(c, r"^(\d{13})(.+)$", 1)).alias("barcode"),
        F.when(hit, F.regexp_extract(c, r"^(\d{13})(.+)$", 2)).otherwise(c).alias("sku"),
    )


def strip_box_note(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\d+\s*por\s*caja\s*$", ""))


def compose_title(brand: Column, name: Column) -> Column:
    return F.trim(F.concat_ws(" ", _empty_to_null(brand), _empty_to_null(name)))


def variant_title(title: Column, variant: Column) -> Column:
    plain = F.coalesce(F.lower(variant), F.lit("")).isin("", "default title")
    return F.when(plain, title).otherwise(F.concat(title, F.lit(" - "), variant))


def net_or_gross_price(net: Column, gross: Column) -> Column:
    return F.when(net > 0, net).otherwise(gross)


def tags_from_classes(c: Column) -> Column:
    """'product_cat-a-b' classes become 'a b'."""
    own = F.filter(F.split(c, r"\s+"), lambda x: x.startswith("product_cat-"))
    return F.transform(own, lambda x: F.replace(F.replace(x, F.lit("product_cat-"), F.lit("")), F.lit("-"), F.lit(" ")))


def absolute_url(base: Column, href: Column) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.regexp_replace(base, "/+$", ""), F.coalesce(href, F.lit(""))))


def first_attr(*columns: Column) -> Column:
    return F.coalesce(*(_empty_to_null(c) for c in columns), F.lit(""))


def stock_from_text(c: Column) -> Column:
    """struct(stock, available): sold out -> 0 and false; else all digits as one number."""
    gone = detect_out_of_stock(c)
    digits = F.regexp_replace(c, "[^0-9]", "").try_cast("int")
    return F.struct(F.when(gone, F.lit(0)).otherwise(digits).alias("stock"), (~gone).alias("available"))


def stock_with_unit(c: Column) -> Column:
    """The older reading: 'N en stock' or 'N in stock', both languages."""
    n = F.regexp_extract(F.lower(c), r"(\d+)\s+(?:en|in)\s+stock", 1).try_cast("int")
    return F.when(detect_out_of_stock(c), F.lit(0)).otherwise(n)


def title_id(title: Column, url: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.coalesce(title, F.lit("")), F.lit("-"), F.coalesce(url, F.lit(""))), 256), 1, 32)


def external_id(sku: Column, title: Column, url: Column) -> Column:
    return F.coalesce(_empty_to_null(sku), title_id(title, url))


def state_hash(price: Column, stock: Column, availability: Column) -> Column:
    """sha256 of price|stock|availability; nulls count as the word None, the title doesn't count."""
    part = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.sha2(F.concat_ws("|", part(price.cast(MONEY)), part(stock), part(availability)), 256)


def variant_signature(volume_ml: Column, fragrance_type: Column) -> Column:
    ml = F.when(volume_ml != 0, F.concat(volume_ml.cast("string"), F.lit("ml")))
    return _empty_to_null(F.concat_ws("-", ml, _empty_to_null(F.upper(fragrance_type))))


def to_enum(c: Column, allowed: tuple[str, ...], default: str | None = None) -> Column:
    return F.when(F.upper(c).isin(*allowed), F.upper(c)).otherwise(F.lit(default))


def recode_availability(c: Column) -> Column:
    return F.when(c == "AVAILABLE_NO_STOCK", F.lit("OUT_OF_STOCK")).otherwise(c)


def display_name(brand: Column, name: Column, variant: Column, volume_ml: Column) -> Column:
    """'brand name variant NNml ', with its trailing space."""
    after = lambda c: F.coalesce(F.concat(c, F.lit(" ")), F.lit(""))
    return F.concat(brand, F.lit(" "), name, F.lit(" "), after(variant), after(F.concat(volume_ml.cast("string"), F.lit("ml"))))


def transition_ok(before: Column, after: Column) -> Column:
    """Whether a state may follow another; staying is always allowed."""
    allowed = before == after
    for state, nexts in MOVES.items():
        if nexts:
            allowed = allowed | ((before == state) & after.isin(*nexts))
    return allowed

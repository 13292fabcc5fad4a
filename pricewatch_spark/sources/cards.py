"""Shop cards from HTML pages: the one place where Python reads pages, a batch at a time.

Built on the standard library's parser: a page becomes a small tree, and a layout says by tags and
classes which element of a card holds which field.  The first choice that is found wins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch_spark.functions.text import detect_out_of_stock, parse_price, stock_from_text, tags_from_classes, validate_ean
from pricewatch_spark.sources.markup import TolerantParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

#: By layout, what to look for, in order.  "a b": b within a; ".x": class x; "t.x": tag t of class x.
LAYOUTS = {
    "woocommerce": {
        "card": ["li.product", ".product-grid-item", ".product", "article.product"],
        "title": [".woocommerce-loop-product__title", ".product-title", "h2", "h3"],
        "link": ["a.woocommerce-loop-product__link", "a.product-image-link", "h2 a", "h3 a"],
        "image": ["img"],
        "image_attrs": ["data-src", "data-lazy-src", "src"],
        "price": ["ins .amount", ".price .amount", ".price bdi", ".price"],
        "vendor": [".woodmart-product-cats a", ".product-categories a"],
        "description": [".woocommerce-product-details__short-description", ".short-description", ".excerpt"],
        "stock": [".stock", ".quantity", ".in-stock", ".out-of-stock"],
    },
    "jumpseller": {
        "card": [".product-item", ".item-product", ".product-grid .item", "article.product", ".product-block"],
        "title": [".product-title", ".item-name", "h3.title", "h2.title", ".name", "h4 a", "h4"],
        "link": ["a.product-image-wrapper", "a.product-title-link", "a"],
        "image": ["img.product-image", "img.item-image", "img"],
        "image_attrs": ["data-src", "src"],
        "price": [".price .money", ".price", ".product-price", "span.money", ".product-block-normal"],
        "vendor": [".brand", ".vendor", ".product-brand"],
        "description": [".description", ".short-description", ".product-description", ".caption"],
        "stock": [".stock", ".quantity", ".inventory"],
        "sku_attrs": ["data-sku", "data-product-sku"],
    },
    "generic": {
        "card": [".product-card", ".product-item", ".product", ".card"],
        "title": [".product-title", ".product-name", "td.name", "h3", "h4", "a.name"],
        "link": ["a"],
        "image": ["img"],
        "image_attrs": ["data-src", "src"],
        "price": [".price", ".price-value", "td.price", ".product-price", "span.monto"],
        "vendor": [],
        "description": [".description", ".short-description", ".details", "td.desc"],
        "stock": [".stock", ".quantity", "td.stock", ".availability"],
        "own_sku_attrs": ["data-sku", "data-code"],
        "own_barcode_attrs": ["data-barcode", "data-ean"],
        "whole_text_title": 200,
    },
}
_FIELDS = ("title", "price", "vendor", "description", "stock")
SCHEMA = "page_id long, source_id string, base_url string, pos int, title string, price string, vendor string, description string, stock string, href string, image_url string, classes string, sku string, barcode string"


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node | str]:
        """All that lies below, in the page's order; pages may nest deeper than calls can."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                continue
            yield child
            if isinstance(child, Node):
                stack.append(iter(child.children))

    def descendants(self) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node))

    def text(self) -> str:
        return "".join(x for x in self.walk() if isinstance(x, str))

    def fits(self, simple: str) -> bool:
        tag, _, name = simple.partition(".")
        return (not tag or tag == self.tag) and (not name or name in self.attrs.get("class", "").split())

    def select(self, path: str) -> Iterator[Node]:
        *outer, last = path.split()
        for node in self.descendants():
            if node.fits(last):
                above, wanted = node.parent, list(outer)
                while wanted and above is not None:
                    if above.fits(wanted[-1]):
                        wanted.pop()
                    above = above.parent
                if not wanted:
                    yield node

    def first(self, paths: list[str]) -> Node | None:
        return next((n for p in paths for n in self.select(p)), None)


class _Tree(TolerantParser):
    def __init__(self):
        super().__init__()
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.open.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.open))

    def handle_endtag(self, tag):
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def cards_of(html: str | None, layout: str) -> list[dict]:
    """The raw fields of each card of a page; cards without title are left out."""
    rules = LAYOUTS[layout]
    tree = _Tree()
    tree.read(html if isinstance(html, str) else "")
    found = next((c for c in ([*tree.root.select(p)] for p in rules["card"]) if c), [])
    out = []
    for card in found:
        row: dict = {}
        for field in _FIELDS:
            node = card.first(rules[field])
            row[field] = None if node is None else re.sub(r"\s+", " ", node.text()).strip()
        if not row["title"] and (most := rules.get("whole_text_title")):
            whole = re.sub(r"\s+", " ", card.text()).strip()
            row["title"] = whole if len(whole) <= most else ""
        if not row["title"]:
            continue
        link, image = card.first(rules["link"]), card.first(rules["image"])
        row["href"] = link.attrs.get("href", "") if link is not None else ""
        row["image_url"] = next((image.attrs[a] for a in rules["image_attrs"] if image.attrs.get(a)), "") if image is not None else ""
        row["classes"] = card.attrs.get("class", "")
        inner = next((n.attrs[a] for n in card.descendants() for a in rules.get("sku_attrs", ()) if n.attrs.get(a)), None)
        row["sku"] = next((card.attrs[a] for a in rules.get("own_sku_attrs", ()) if card.attrs.get(a)), inner)
        row["barcode"] = next((card.attrs[a] for a in rules.get("own_barcode_attrs", ()) if card.attrs.get(a)), None)
        out.append(row)
    return out


def extract_cards(pages: DataFrame, layout: str) -> DataFrame:
    """pages (page_id, source_id, base_url, html) -> raw listings."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                {"page_id": p, "source_id": s, "base_url": b, "pos": k, **card}
                for p, s, b, html in zip(batch["page_id"], batch["source_id"], batch["base_url"], batch["html"], strict=True)
                for k, card in enumerate(cards_of(html, layout))
            ]
            yield pd.DataFrame(rows, columns=names)

    raw = pages.select("page_id", "source_id", "base_url", "html").mapInPandas(run, SCHEMA)
    seen = F.col("stock").isNotNull()
    base = F.regexp_replace("base_url", "/+$", "")
    url = F.when(F.lit(layout == "woocommerce") | F.col("href").startswith("http") | (F.col("href") == ""), F.col("href")).otherwise(F.concat(base, F.col("href")))
    tags = tags_from_classes(F.col("classes")) if layout == "woocommerce" else F.array().cast("array<string>")
    return raw.select(
        "page_id",
        "source_id",
        "pos",
        F.col("title").alias("raw_title"),
        F.when(F.col("price").isNull(), F.lit(0)).otherwise(parse_price(F.col("price"))).cast("decimal(12,2)").alias("price"),
        url.alias("url"),
        F.nullif("vendor", F.lit("")).alias("vendor"),
        "sku",
        validate_ean(F.col("barcode")).alias("barcode"),
        F.coalesce("description", F.lit("")).alias("description"),
        "image_url",
        tags.alias("tags"),
        F.when(seen, stock_from_text(F.col("stock"))["stock"]).alias("stock"),
        (~F.coalesce(detect_out_of_stock(F.col("stock")), F.lit(False))).alias("available"),
    )

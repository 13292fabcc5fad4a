"""The whole run of raw listings against a model that takes one row after the other."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricewatch_spark.functions import titles
from pricewatch_spark.operators import delta, ingest, products
from pricewatch_spark.streaming.changes import SNAPSHOT

RAW = "run_id string, source_id string, pos long, scraped_at timestamp, raw_title string, price string, stock string, sku string, url string, image_url string, vendor string, tags array<string>, barcode string, inventory_quantity string, stock_text string, available boolean"
LISTINGS = SNAPSHOT + ", product_code string, variant_signature string"
T0 = dt.datetime(2026, 3, 1)


@pytest.fixture(scope="module")
def shops(spark):
    return spark.createDataFrame([(s, "other", "B2B_WHOLESALE", "CLP") for s in "abc"], "source_id string, engine_type string, business_type string, currency string")


def raw_rows(seed, n=160, start=0):
    r = random.Random(seed)
    brands, eans = ["Dior", "Creed", "Zzyzx"], [None, None, "1111111111111", "2222222222222", "3333333333333", "x"]
    out = []
    for k in range(start, start + n):
        name, ml, kind = r.choice(["Alba", "Bruma", "Cielo"]), r.choice(["50 ml", "100ML", ""]), r.choice(["EDP", "EDT", "EDP", ""])
        title = r.choice(["", f"{r.choice(brands)} {name} {kind} {ml}"] + [f"{r.choice(brands)} {name} {kind} {ml} {r.choice(['men', ''])}"] * 6)
        price, stock = r.choice(["10", "10", "20.5", None, "bad"]), r.choice(["0", "3", "3", None, "-2"])
        out.append(("run", r.choice("abc"), k, T0 + dt.timedelta(minutes=k // 3), title, price, stock, r.choice(["s1", "s2", "s3", "s4", "", f"n{r.randrange(30)}"]), f"u{r.randrange(3)}", None, None, [], r.choice(eans), None, None, True))
    return out


def model(rows, normal, book, listings):
    """rows in their order; normal: pos -> normalised title; book: products in order; listings by key."""
    history, failed, codes, alias = [], 0, len(book), {}

    def write(key, row, price, stock, state):
        old = listings[key]
        if price is not None and (old["price"] != price or old["availability"] != state):
            history.append((*key, price, stock, state))
        old.update(price=price, stock=stock, availability=state)

    for row in rows:
        pos, source, title = row[2], row[1], row[4]
        n = normal[pos]
        price, stock, state = n["price"], n["stock"], n["availability"]
        if not title.strip() or (stock is not None and stock < 0):
            failed += 1
            continue
        key = alias.get((source, n["external_id"]), (source, n["external_id"]))
        if key in listings:
            old = listings[key]
            if (old["price"], old["stock"], old["availability"]) != (price, stock, state):
                write(key, row, price, stock, state)
            continue
        if n["volume_ml"] is None or n["fragrance_type"] is None:
            failed += 1
            continue
        identity = tuple(x.lower() if isinstance(x, str) else x for x in (n["brand"], n["product_name"], n["volume_ml"], n["variant"]))
        ean = n["ean_13"]
        product = next((p for p in book if ean and p["ean"] == ean), None) or next((p for p in book if p["identity"] == identity), None)
        if product is None:
            codes += 1
            product = {"code": f"a{codes:08d}", "identity": identity, "ean": ean, "gender": n["gender"], "type": n["fragrance_type"]}
            book.append(product)
        product["ean"] = product["ean"] or ean
        product["gender"] = product["gender"] or n["gender"]
        signature = f"{n['volume_ml']}ml-{n['fragrance_type']}"
        same = next((k for k, x in listings.items() if k[0] == source and (x["code"], x["signature"]) == (product["code"], signature)), None)
        if same:
            alias[key] = same
            write(same, row, price, stock, state)
            continue
        listings[key] = {"price": price, "stock": stock, "availability": state, "code": product["code"], "signature": signature}
        if price is not None:
            history.append((*key, price, stock, state))
    return sorted(history, key=repr), failed


def normalised(spark, rows, shops):
    seen = delta.observe(spark.createDataFrame(rows, RAW), shops)
    out = titles.normalize_titles(seen).collect()
    return {r["pos"]: {"price": r["price"], "stock": r["observed_stock"], "availability": r["availability"], "external_id": r["source_external_id"], **{c: r[c] for c in ("brand", "product_name", "variant", "volume_ml", "fragrance_type", "gender", "ean_13")}} for r in out}


def state_of(done):
    listings = {(r["source_id"], r["source_external_id"]): {"price": r["current_price"], "stock": r["current_stock"], "availability": r["availability"], "code": r["product_code"], "signature": r["variant_signature"]} for r in done.listings.collect()}
    book = sorted((r["product_code"], (r["brand"].lower(), r["product_name"].lower(), r["volume_ml"], r["variant"] and r["variant"].lower()), r["ean_13"] or "", r["gender"] or "") for r in done.products.collect())
    return listings, book


def test_two_runs_equal_the_model(spark, shops):
    book, listings = [], {}
    known, snapshot = spark.createDataFrame([], ingest.PRODUCTS), spark.createDataFrame([], LISTINGS)
    for seed in (1, 2):
        rows = raw_rows(seed, start=1000 * seed)
        history, failed = model(rows, normalised(spark, rows, shops), book, listings)
        done = ingest.ingest(spark.createDataFrame(rows, RAW).repartition(5), shops, known, snapshot)
        got, products_ = state_of(done)
        assert got == listings
        assert products_ == sorted((p["code"], p["identity"], p["ean"] or "", p["gender"] or "") for p in book)
        assert sorted(((r["source_id"], r["source_external_id"], r["price"], r["stock"], r["availability"]) for r in done.history.collect()), key=repr) == history
        counters = done.counters.first()
        assert counters["extracted"] == len(rows) and counters["failed"] == failed == done.rejects.count() and counters["status"] == "PARTIAL"
        known, snapshot = spark.createDataFrame(done.products.collect(), ingest.PRODUCTS), spark.createDataFrame(done.listings.collect(), done.listings.schema)
    assert len(book) > 12 and len(listings) > 20
    # the same rows again create nothing, and a listing that is silent is delisted
    again = ingest.ingest(spark.createDataFrame(rows, RAW), shops, known, snapshot, F.lit(T0 + dt.timedelta(days=9)))
    assert again.products.count() == len(book) and again.listings.count() == len(listings)
    assert {r["availability"] for r in again.listings.collect()} == {"DELISTED"}


def test_three_shops_one_product_and_no_duplicate(spark, shops):
    rows = [("run", s, k, T0, "Dior Sauvage EDP 100 ml", "10", "1", "s1", "u", None, None, [], "1234567890123", None, None, True) for k, s in enumerate("abc")]
    known, snapshot = spark.createDataFrame([], ingest.PRODUCTS), spark.createDataFrame([], LISTINGS)
    done = ingest.ingest(spark.createDataFrame(rows, RAW), shops, known, snapshot)
    assert (done.products.count(), done.listings.count(), done.history.count()) == (1, 3, 3)
    assert done.counters.first()["status"] == "SUCCESS"
    none = ingest.ingest(spark.createDataFrame([], RAW), shops, known, snapshot)
    assert none.products.count() == none.listings.count() == none.history.count() == none.rejects.count() == 0


def test_products_in_the_order_of_rows(spark):
    """Against one row after the other, with known products and a barcode that very many identities share."""
    r = random.Random(8)
    known = [(f"a{k:08d}", r.choice([None, f"e{k}", "e1"]), f"n{r.randrange(12)}") for k in range(1, 9)]
    rows = [(k, r.choice([None, "e1", "bad", "bad", f"e{r.randrange(14)}", f"f{r.randrange(5)}"]), f"n{r.randrange(25)}" if k % 3 else f"once{k}") for k in range(400)]
    shape = lambda df: df.selectExpr("*", "'x' AS brand", "10 AS volume_ml", "CAST(NULL AS STRING) AS variant")
    frame = shape(spark.createDataFrame(rows, "pos long, ean_13 string, product_name string"))
    table = shape(spark.createDataFrame(known, "product_code string, ean_13 string, product_name string"))
    book = [{"id": c, "ean": e, "name": n} for c, e, n in known]
    expected = {}
    for pos, ean, name in rows:
        p = next((p for p in book if ean and p["ean"] == ean), None) or next((p for p in book if p["name"] == name), None)
        if p is None:
            p = {"id": f"new-{name}", "ean": None, "name": name}
            book.append(p)
        p["ean"] = p["ean"] or ean
        expected[pos] = p["id"]
    names = {r["identity"]: r["product_name"] for r in frame.select("product_name", products.identity_key().alias("identity")).collect()}
    got = {r["pos"]: r["product_code"] or "new-" + names[r["group_key"]] for r in products.resolve_products(frame, table, "pos").collect()}
    assert got == expected

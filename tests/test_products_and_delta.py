import datetime as dt
import random
import decimal

import pytest
from pyspark.sql import functions as F

from pricewatch_spark.operators import compare, delta, history, products, rules, scoring
from pricewatch_spark.sources import cards, listings, tables
from pricewatch_spark.streaming import changes as stream

RAW = "run_id string, source_id string, pos long, scraped_at timestamp, raw_title string, price string, stock string, inventory_quantity string, stock_text string, available boolean, sku string, url string, image_url string"
T0 = dt.datetime(2026, 1, 1)


def raw_rows(spark, rows):
    return spark.createDataFrame([("r", s, k, T0 + dt.timedelta(hours=h), t, p, st, None, None, True, sku, u, "") for k, (s, h, t, p, st, sku, u) in enumerate(rows)], RAW)


@pytest.fixture()
def sources(spark):
    return spark.createDataFrame([("a", "shopify", None, "CLP"), ("b", "bs4_woocommerce", "B2B_WHOLESALE", "USD")], "source_id string, engine_type string, business_type string, currency string")


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], stream.SNAPSHOT)


def test_delta_life(spark, sources, empty):
    first = raw_rows(spark, [("a", 0, "X", "10", "5", "k1", "u"), ("a", 1, "X", "10", "5", "k1", ""), ("b", 0, "Y", "7", None, "k2", ""), ("b", 0, " ", "7", None, "k3", ""), ("b", 0, "Z", "7", "-1", "k4", "")])
    changes = delta.classify_changes(delta.observe(first, sources), empty)
    kinds = sorted((r["source_external_id"], r["change"]) for r in changes.collect())
    assert kinds == [("k1", "created"), ("k1", "unchanged"), ("k2", "created"), ("k3", "failed"), ("k4", "failed")]
    counters = delta.run_counters(changes).first()
    assert (counters["extracted"], counters["updated"], counters["skipped"], counters["failed"], counters["status"]) == (5, 2, 1, 2, "PARTIAL")
    snapshot = delta.next_snapshot(changes, empty)
    one = {r["source_external_id"]: r for r in snapshot.collect()}
    assert one["k1"]["url"] == "u" and one["k1"]["currency"] == "CLP" and one["k2"]["currency"] == "USD" and one["k2"]["availability"] == "UNKNOWN"
    again = delta.classify_changes(delta.observe(raw_rows(spark, [("a", 2, "other title", "10", "5", "k1", "")]), sources), snapshot)
    assert [r["change"] for r in again.collect()] == ["unchanged"] and delta.history_rows(again).count() == 0
    stock_only = delta.classify_changes(delta.observe(raw_rows(spark, [("a", 2, "X", "10", "4", "k1", "")]), sources), snapshot)
    assert [r["change"] for r in stock_only.collect()] == ["changed"] and delta.history_rows(stock_only).count() == 0
    priced = delta.classify_changes(delta.observe(raw_rows(spark, [("a", 2, "X", "11", "5", "k1", "")]), sources), snapshot)
    assert delta.history_rows(priced).count() == 1
    gone = delta.delist_stale(snapshot, F.lit(T0 + dt.timedelta(days=3)))
    assert {r["availability"] for r in gone.collect()} == {"DELISTED"}
    quiet = delta.next_snapshot(delta.classify_changes(delta.observe(raw_rows(spark, [("a", 80, "X", "10", "5", "k1", "")]), sources), gone), gone)
    assert {r["source_external_id"]: r["availability"] for r in quiet.collect()}["k1"] == "DELISTED"
    revived = delta.next_snapshot(delta.classify_changes(delta.observe(raw_rows(spark, [("a", 80, "X", "12", "5", "k1", "")]), sources), gone), gone)
    assert {r["source_external_id"]: r["availability"] for r in revived.collect()}["k1"] == "AVAILABLE_IN_STOCK"


def test_quantities_through_the_snapshot(spark, sources, empty):
    tiers = [[(10, 9.0), (50, 7.0)], [], None, [(20, 8.0)], []]
    moq = ["12", "0", None, "x", None]
    schema = RAW + ", moq string, bulk_tiers array<struct<qty int, price decimal(12,2)>>"

    def batch(ks, hour):
        rows = [("r", "a", k, T0 + dt.timedelta(hours=hour + k), "X", str(10 + k), "5", None, None, True, "k1", "u", "", moq[k], [(q, decimal.Decimal(p)) for q, p in tiers[k]] if tiers[k] is not None else None) for k in ks]
        return delta.observe(spark.createDataFrame(rows, schema), sources)

    state = lambda s: [(r["moq"], [(t["qty"], float(t["price"])) for t in r["bulk_tiers"]]) for r in s.collect()]
    first = delta.next_snapshot(delta.classify_changes(batch([0, 1, 2], 0), empty), empty)
    assert state(first) == [(12, [(10, 9.0), (50, 7.0)])]
    second = delta.next_snapshot(delta.classify_changes(batch([3, 4], 9), first), first)
    assert state(second) == [(12, [(20, 8.0)])] and set(second.columns) == set(empty.columns)
    plain = delta.observe(raw_rows(spark, [("a", 40, "X", "10", "5", "k1", "")]), sources)
    assert state(delta.next_snapshot(delta.classify_changes(plain, second), second)) == [(12, [(20, 8.0)])]
    prices = [history.bulk_price(second, q).first()["unit_price"] for q in (11, 12, 25)]
    assert [None if p is None else float(p) for p in prices] == [None, 14.0, 8.0]


def test_a_known_state_moves_times_and_confidence_alone(spark, sources, empty):
    schema = RAW + ", moq string"
    row = lambda h, title, text, url, moq: spark.createDataFrame([("r", "a", 0, T0 + dt.timedelta(hours=h), title, "10", "5", None, text, True, "k1", url, "i", moq)], schema)
    first = delta.next_snapshot(delta.classify_changes(delta.observe(row(0, "X", None, "u", "3"), sources), empty), empty)
    again = delta.classify_changes(delta.observe(row(5, "other", "in stock", "v", "4"), sources), first)
    old, new = first.first(), delta.next_snapshot(again, first).first()
    assert again.first()["change"] == "unchanged"
    assert (new["title"], new["url"], new["moq"], new["last_confirmed_stock_at"]) == ("X", "u", 3, old["last_confirmed_stock_at"])
    assert new["last_seen_at"] == new["last_scraped_at"] == T0 + dt.timedelta(hours=5) and new["stock_confidence"] == "MEDIUM"
    gone = first.withColumn("availability", F.lit("DELISTED"))
    assert [delta.next_snapshot(again, gone, mode).first()["availability"] for mode in (True, False)] == ["DELISTED", "AVAILABLE_IN_STOCK"]


def test_a_million_codes_without_gaps(spark, tmp_path):
    """Written out whole: every ordinal once, in the order asked for."""
    new = spark.range(1_200_000).selectExpr("id", "md5(CAST(id AS STRING)) AS name", "repeat('x', CAST(id % 50 AS INT)) AS more")
    known = spark.createDataFrame([("a00000041",)], "product_code string")
    products.assign_codes(new, known, "name").write.parquet(f"{tmp_path}/codes")
    got = spark.read.parquet(f"{tmp_path}/codes").withColumn("n", products.parse_code(F.col("product_code"))["ordinal"])
    r = got.agg(F.count_distinct("n").alias("distinct"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    assert (r["distinct"], r["low"], r["high"]) == (1_200_000, 42, 1_200_041)
    assert got.orderBy("n").limit(1).first()["name"] == got.agg(F.min("name")).first()[0]


def test_deeply_nested_page():
    page = "<div>" * 5000 + '<div class="product"><h3>Deep</h3></div>' + "</div>" * 5000
    assert [c["title"] for c in cards.cards_of(page, "generic")] == ["Deep"]


def test_measures_of_runs_prices_and_feeds(spark):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    logs = spark.createDataFrame([(1, at(0), at(2), 10, "SUCCESS"), (1, at(5), at(6), 20, "EMPTY"), (1, at(9), None, 0, "RUNNING")], "source_id int, started_at timestamp, ended_at timestamp, records int, status string")
    r = scoring.run_stats(logs, ("SUCCESS", "EMPTY", "RUNNING")).first()
    assert (r["n_empty"], r["n_running"], r["mean_records"], r["mean_seconds"]) == (1, 1, 10.0, 90.0)
    points = spark.createDataFrame([(1, at(k), p) for k, p in enumerate([8.0, 10.0, 0.0, 5.0])], "source_id int, seen_at timestamp, price double")
    assert [x["change_pct"] for x in history.price_series(points, ["source_id"], ["seen_at"]).orderBy("seen_at").collect()] == [None, 25.0, -100.0, None]
    feed = spark.createDataFrame([("s", "https://x", '{"products":[{"title":"T","variants":[{"title":"50ml","inventory_quantity":3}]}]}')], "source_id string, base_url string, body string")
    r = listings.read_feed_json(feed).first()
    assert (r["moq"], r["bulk_tiers"], r["stock"], r["inventory_quantity"]) == (None, [], 3, 3)


def test_stock_and_confidence(spark):
    rows = [
        ("shopify", None, "12", None, None, True, 12, "HIGH"),
        ("shopify", None, None, None, "3", None, 3, "MEDIUM"),
        ("bs4_woocommerce", "B2C_RETAIL", None, "12 in stock", None, None, 12, "MEDIUM"),
        ("bs4_woocommerce", "B2C_RETAIL", None, "in stock", None, None, 1, "MEDIUM"),
        ("bs4_woocommerce", "B2C_RETAIL", None, "Out of stock", None, None, 0, "UNKNOWN"),
        ("other", "B2B_WHOLESALE", None, None, "4", None, 4, "HIGH"),
        ("other", "B2C_RETAIL", None, None, None, True, None, "LOW"),
        ("other", "B2C_RETAIL", "x", None, None, False, None, "UNKNOWN"),
    ]
    df = spark.createDataFrame(rows, "t string, b string, q string, x string, s string, a boolean, stock int, confidence string")
    c = F.col
    got = df.select("stock", "confidence", delta.extract_stock(c("t"), c("q"), c("x"), c("s")).alias("gs"), delta.stock_confidence(c("b"), c("q"), c("x"), c("s"), c("a")).alias("gc")).collect()
    assert all((r["stock"], r["confidence"]) == (r["gs"], r["gc"]) for r in got)


def test_codes(spark):
    codes = spark.createDataFrame([("a00000001", "a00000002"), ("a99999999", "b00000001"), ("z99999999", "aa00000001"), ("az00000007", "az00000008")], "code string, following string")
    got = codes.select("following", products.code_of(products.parse_code(F.col("code"))["ordinal"] + 1).alias("next")).collect()
    assert all(r["following"] == r["next"] for r in got)
    bad = spark.createDataFrame([("A00000001",), ("a1",), ("00000001",)], "code string")
    assert bad.where(products.parse_code(F.col("code")).isNull()).count() == 3
    emrg = spark.range(1).select(products.fallback_code(F.lit("k")).alias("c")).first()["c"]
    assert emrg.startswith("emrg") and len(emrg) == 12
    new = spark.range(100).withColumn("name", F.concat(F.lit("n"), F.lpad("id", 3, "0")))
    known = spark.createDataFrame([("a00000041",), ("emrg99999990",)], "product_code string")
    assert [r["product_code"] for r in products.assign_codes(new, known, "name").orderBy("name").collect()] == [f"a{41 + k:08d}" for k in range(1, 101)]


def test_grouping_modes(spark):
    rows = [(1, "e1", "A"), (2, "e1", "B"), (3, None, "B"), (4, "e2", "A"), (5, "e2", "C"), (6, None, "C")]
    df = spark.createDataFrame(rows, "pos int, ean_13 string, product_name string").selectExpr("*", "'x' AS brand", "10 AS volume_ml", "CAST(NULL AS STRING) AS variant")
    exact = {r["pos"]: r["group_key"] for r in products.group_new_products(df, "exact").collect()}
    # 4 matches A, which keeps its first barcode, so 5 makes a product of its own
    assert exact[1] == exact[2] == exact[4] != exact[5] and exact[5] == exact[6] and exact[3] not in (exact[1], exact[5])
    leader = {r["pos"]: r["group_key"] for r in products.group_new_products(df).collect()}
    assert leader[1] == leader[2] == leader[4] == leader[5]


def test_three_shops_one_product(spark):
    raw = spark.createDataFrame([(k, s) for k, s in enumerate("abc")], "pos int, source_id string").selectExpr("*", "'Dior' AS brand", "'Sauvage' AS product_name", "100 AS volume_ml", "CAST(NULL AS STRING) AS variant", "'1234567890123' AS ean_13")
    assert products.group_new_products(raw).select("group_key").distinct().count() == 1
    known = spark.createDataFrame([("a00000001", "dior", "SAUVAGE", 100, None, None)], "product_code string, brand string, product_name string, volume_ml int, variant string, ean_13 string")
    assert {r["matched_by"] for r in products.match_products(raw, known).collect()} == {"IDENTITY"}


def test_cards_layouts(spark):
    html = '<li class="product product_cat-agua-fresca"><a class="woocommerce-loop-product__link" href="/p"><h2>Uno &amp; dos</h2></a><img data-lazy-src="l.jpg" src="s.jpg"><span class="price"><del>9</del><ins><bdi class="amount">$ 1.990</bdi></ins></span><p class="stock out-of-stock">Agotado</p></li>'
    generic = '<div class="product" data-code="c1" data-ean="1234567890123">Solo texto</div>'
    pages = spark.createDataFrame([(1, "s", "https://x/", html), (2, "s", "https://x/", None)], "page_id long, source_id string, base_url string, html string")
    r = cards.extract_cards(pages, "woocommerce").collect()
    assert [(x["raw_title"], int(x["price"]), x["image_url"], x["tags"], x["stock"], x["available"]) for x in r] == [("Uno & dos", 1990, "l.jpg", ["agua fresca"], 0, False)]
    pages = spark.createDataFrame([(1, "s", "https://x/", generic)], "page_id long, source_id string, base_url string, html string")
    g = cards.extract_cards(pages, "generic").first()
    assert (g["raw_title"], g["sku"], g["barcode"], g["stock"]) == ("Solo texto", "c1", "1234567890123", None)


def test_odd_pages(spark):
    good = '<div class="product-card"><h3>Uno</h3><span class="price-value">$5</span></div>'
    odd = ["<![foo bar]>", "<![", "<!", "<!doctype", "<![CDATA[ x", "<![CDATA[ x ]]>", "<!->", "<a href=", "</", "<![if gte mso 9]>x<![endif]>", "<noscript>", "&#xFFFFFFFFF;", "\x00<"]
    pages = [(k, "s", "https://x/", f"{good}{o}") for k, o in enumerate(odd)] + [(99, "s", "https://x/", good), (98, "s", "https://x/", "<![foo bar]>" + good)]
    r = cards.extract_cards(spark.createDataFrame(pages, "page_id long, source_id string, base_url string, html string"), "generic").collect()
    assert sorted(x["page_id"] for x in r) == sorted(p[0] for p in pages) and {(x["raw_title"], int(x["price"])) for x in r} == {("Uno", 5)}
    rng = random.Random(0)
    for _ in range(3000):  # nothing that is fed ends in an error
        cards.cards_of("".join(rng.choices(["<", ">", "!", "[", "]", "-", "/", "a", " ", "=", '"', "&", "#", "x", "<![", "<!--", "]]>", "CDATA"], k=12)), "generic")


def test_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    from pricewatch_spark.plans.testmap import Model

    m = Model(spark, sf)
    nothing = m.listings.limit(0)
    assert compare.price_comparison(m.products, nothing, m.sources).count() == 0
    assert compare.best_in_stock(nothing, m.sources).count() == 0
    assert history.price_series(m.history.limit(0), ["source_id"], ["seen_at"]).count() == 0
    assert scoring.source_reliability(m.sources, nothing).count() == m.sources.count()
    assert rules.violation_counts(m.products.limit(0), rules.PRODUCT_RULES).count() == 0
    assert delta.run_counters(spark.createDataFrame([], "run_id string, change string, observed_stock int")).count() == 0


def test_archive_export_history(spark, tmp_path):
    raw = spark.createDataFrame([("t", "v", 1.5, "s", None, "u", "i", ["a", "b"], 1, True, "d", "src", T0)], "raw_title string, vendor string, price double, sku string, barcode string, url string, image_url string, tags array<string>, stock int, available boolean, description string, source_id string, scraped_at timestamp")
    tables.archive_raw(raw, f"{tmp_path}/archive")
    assert tables.replay_raw(spark, f"{tmp_path}/archive", "src", "2026-01-01").count() == 1
    tables.export_catalog(raw, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").first()["tags"] == "a, b"
    tables.export_catalog(raw, f"{tmp_path}/json", "json")
    tables.append_history(raw.select(F.col("scraped_at").alias("recorded_at"), "price"), f"{tmp_path}/history")
    assert spark.read.parquet(f"{tmp_path}/history").count() == 1


def test_stream_equals_batch(spark, sources, empty, tmp_path):
    rows = [("a", h, "X", str(10 + h % 3), "5", f"k{h % 4}", "") for h in range(24)]
    for k in range(3):
        raw_rows(spark, rows[8 * k : 8 * k + 8]).withColumn("pos", F.col("pos") + 8 * k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    files = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream.run_delta_stream(files, sources, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    batch = delta.classify_changes(delta.observe(raw_rows(spark, rows), sources), empty)
    expected = sorted((r["source_external_id"], r["current_hash"]) for r in delta.next_snapshot(batch, empty).collect())
    last = stream.read_snapshot(spark, f"{tmp_path}/out", 2)
    assert sorted((r["source_external_id"], r["current_hash"]) for r in last.collect()) == expected
    assert spark.read.parquet(f"{tmp_path}/out/history").count() == delta.history_rows(batch).count()

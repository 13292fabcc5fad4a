from pyspark.sql import functions as F

from pricewatch_spark.functions import text, titles

# (title, vendor, tags, brand, type, ml, gender)
TITLES = [
    ("Carolina Herrera Good Girl EDP 80ml", None, [], "Carolina Herrera", "EDP", 80, None),
    ("DOLCE & GABBANA Light Blue Eau de Toilette 100 ML Mujer", None, [], "Dolce & Gabbana", "EDT", 100, "F"),
    ("Perfume Lancôme La Vie Est Belle 50ml", None, ["EDP"], "Lancôme", "EDP", 50, None),
    ("Lancome Idole 50 ml eau de parfum", None, [], "Lancôme", "EDP", 50, None),
    ("Hermès Terre EDT 100ml", None, [], "Hermès", "EDT", 100, None),
    ("Terre de HERMES EDT 100ml", None, [], "Hermes", "EDT", 100, None),
    ("Paco Rabanne 1 Million Parfum 100ml", None, [], "Paco Rabanne", None, 100, None),
    ("Chloé Nomade 75ml edp mujer", None, [], "Chloé", "EDP", 75, "F"),
    ("Body Splash Vainilla 250 ml", None, [], "Unknown", "BODY_MIST", 250, None),
    ("4711 Cologne 99999ml", None, [], "Unknown", "COLOGNE", None, None),
    ("Sauvage 100ml", "dior parfums", [], "Dior", None, 100, None),
    ("Sauvage 100ml", "Casa Nueva", [], "Casa Nueva", None, 100, None),
    ("Armaniseduction edtx 30mlx", None, [], "Unknown", None, None, None),
    ("", None, [], "Unknown", None, None, None),
    (None, None, None, "Unknown", None, None, None),
]


def test_titles(spark):
    rows = [(k, t, v, g, None) for k, (t, v, g, *_) in enumerate(TITLES)]
    raw = spark.createDataFrame(rows, "row_id int, raw_title string, vendor string, tags array<string>, barcode string")
    got = {r["row_id"]: r for r in titles.normalize_titles(raw).collect()}
    for k, (title, _, _, brand, kind, ml, gender) in enumerate(TITLES):
        r = got[k]
        assert (r["brand"], r["fragrance_type"], r["volume_ml"], r["gender"]) == (brand, kind, ml, gender), title


def test_names_variants_confidence(spark):
    cases = [("Dior Sauvage Intense EDP 100ml Hombre", "Sauvage Intense", "Intense", 1.0), ("Chanel - Bleu (Noir) 50 ml", "Bleu Noir", "Noir", 0.75), ("Gucci EDT", "Gucci EDT", None, 0.5), ("algo raro", "algo raro", None, 0.25)]
    raw = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "row_id int, raw_title string").selectExpr("*", "CAST(NULL AS STRING) AS vendor", "array() AS tags", "CAST(NULL AS STRING) AS barcode")
    got = {r["row_id"]: r for r in titles.normalize_titles(raw.withColumn("tags", F.col("tags").cast("array<string>"))).collect()}
    for k, (_, name, variant, confidence) in enumerate(cases):
        assert (got[k]["product_name"], got[k]["variant"], float(got[k]["confidence_score"])) == (name, variant, confidence)


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_text(spark):
    assert one(spark, text.parse_price(F.lit("$34.990")).cast("int"), text.parse_price(F.lit("1.234,50")).cast("int"), text.parse_price(F.lit("x")).cast("int")) == [34990, 123450, 0]
    codes = ["1234567890123", "123456789012", None, "", "abc", "123456", " 1234567890123 "]
    assert one(spark, *(text.validate_ean(F.lit(c)) for c in codes)) == [codes[0], codes[1], None, None, None, None, codes[0]]
    assert one(spark, text.validate_ean(F.lit(123456789012))) == ["123456789012"]
    assert one(spark, text.clean_text(F.lit(" a \n b ")), text.clean_text(F.lit(None).cast("string")), text.strip_html(F.lit("<p>a</p><p>b</p>"))) == ["a b", "", "a b"]
    assert one(spark, text.stock_from_text(F.lit("Agotado")), text.stock_from_text(F.lit("quedan 1 2"))) == [(0, False), (12, True)]
    assert one(spark, text.stock_with_unit(F.lit("12 in stock")), text.stock_with_unit(F.lit("3 en stock"))) == [12, 3]
    assert one(spark, text.tags_from_classes(F.lit("product product_cat-agua-fresca x"))) == [["agua fresca"]]
    assert one(spark, text.variant_title(F.lit("A"), F.lit("Default Title")), text.variant_title(F.lit("A"), F.lit("50ml")), text.variant_title(F.lit("A"), F.lit(None).cast("string"))) == ["A", "A - 50ml", "A"]
    assert one(spark, text.display_name(F.lit("A"), F.lit("B"), F.lit(None).cast("string"), F.lit(50))) == ["A B 50ml "]
    assert one(spark, text.to_enum(F.lit("edp"), ("EDP",)), text.to_enum(F.lit("x"), ("REGEX",), "HYBRID"), text.recode_availability(F.lit("AVAILABLE_NO_STOCK"))) == ["EDP", "HYBRID", "OUT_OF_STOCK"]
    assert one(spark, text.variant_signature(F.lit(100), F.lit("edp")), text.variant_signature(F.lit(None).cast("int"), F.lit(None).cast("string"))) == ["100ml-EDP", None]
    assert one(spark, text.compose_title(F.lit("A"), F.lit("")), text.first_attr(F.lit(None).cast("string"), F.lit(""), F.lit("s")), text.external_id(F.lit("k"), F.lit("t"), F.lit("u"))) == ["A", "s", "k"]


def test_state_hash(spark):
    h = lambda p, s, a: text.state_hash(F.lit(p).cast("decimal(12,2)"), F.lit(s).cast("int"), F.lit(a))
    got = one(spark, h("10", 5, "X"), h("10.00", 5, "X"), h("11", 5, "X"), h("10", 6, "X"), h("10", 5, "Y"), h(None, None, "X"))
    assert got[0] == got[1] and len(set(got[1:])) == 5 and all(len(x) == 64 for x in got)


def test_moves(spark):
    states = ["AVAILABLE_IN_STOCK", "OUT_OF_STOCK", "UNKNOWN", "DELISTED"]
    rows = spark.createDataFrame([(a, b) for a in states for b in states], "a string, b string").withColumn("ok", text.transition_ok(F.col("a"), F.col("b"))).collect()
    assert all(r["ok"] == (r["a"] != "DELISTED" or r["b"] == "DELISTED") for r in rows) and len(rows) == 16


def test_llm_answers(spark):
    got = one(spark, titles.parse_llm_response(F.lit('```json\nSure {"brand": "X", "ml": 5}\n```')), titles.parse_llm_response(F.lit("none")))
    assert got[0]["brand"] == "X" and got[0]["ml"] == 5 and got[1] is None
    asked = spark.createDataFrame([(1, True, "p"), (2, False, "q")], "row_id int, needs_llm boolean, prompt string")

    def broken(_):
        raise RuntimeError

    assert [tuple(r) for r in titles.enrich(asked, [broken, lambda p: p.upper()]).collect()] == [(1, "P")]

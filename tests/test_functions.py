import pytest
from pyspark.sql import functions as F

from lantern.functions import numbers, similarity, text


def each(spark, values, made):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", made(F.col("x")).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


def test_pharmacy_names(spark):
    names = {
        "şeker": "SEKER", "İstanbul": "ISTANBUL", "AKSU ECZANESI": "AKSU", "MERKEZ ECZ": "MERKEZ", "çelik ecz.": "CELIK", "ECZANECI": "ECZANECI", "ÇELIK (YENİ)": "CELIK",
        "1. KONAK ECZANE": "1 KONAK", "NÖBETÇİ AKSU ECZANESI": "AKSU", "DR. AHMET ECZANESI": "DOKTOR AHMET", "ÇELIK NO: 3 ECZANESI": "CELIK 3", "ÇELIK/ÖZKAN ECZANE": "CELIK OZKAN",
        "A.B.C ECZANE": "A B C", None: "", "": "", "  ": "",
    }
    assert each(spark, names, text.pharmacy_name) == list(names.values())


def test_district_names(spark):
    names = {"İZMİR": "izmir", "Merkez İlçesi": "merkez", "KONAK ILCESI": "konak", "Bakırköy Merkezi": "bakirkoy", "Karacabey Beldesi": "karacabey", "  BUCA   ": "buca", None: ""}
    assert each(spark, names, text.district_name) == list(names.values())


def test_dotted_capital_keeps_its_dot(spark):
    assert each(spark, ["İLÇE", "ILÇE"], text.normalize_text) == ["i̇lce", "ilce"]


def test_entities(spark):
    assert each(spark, ["a&amp;lt;b", "&#65;&#231;", "x&foo;y", "&nbsp;z"], text.decode_entities) == ["a<b", "Aç", "x y", " z"]


@pytest.mark.parametrize(
    ("a", "b", "lev", "jw", "tokens", "best"),
    [
        ("BORNOVA", "BORNOVAA", 0.875, 0.975, 0.975, 0.975),
        ("AB", "AXYZ", 0.25, 0.625, 0.625, 0.625),
        ("MARTHA", "MARHTA", 0.666667, 0.961111, 0.961111, 0.961111),
        ("ADFBDFAEBDD", "BCBFBDCADEF", 0.272727, 0.686147, 0.686147, 0.686147),
        ("AKSU", "AKSU MERKEZ", 0.363636, 0.872727, 1.0, 1.0),
        ("MERKEZ AKSU", "AKSU MERKEZ", 0.090909, 0.492424, 1.0, 1.0),
        ("KARADENIZ BORNOVA", "AKDENIZ BUCA", 0.529412, 0.773856, 0.436928, 0.773856),
        ("AKSU", "GUNES", 0.0, 0.0, 0.0, 0.0),
    ],
)
def test_similarity(spark, a, b, lev, jw, tokens, best):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = F.col("a"), F.col("b")
    row = df.select(similarity.levenshtein_similarity(x, y), similarity.jaro_winkler(x, y), similarity.token_set(x, y), similarity.best_similarity(x, y)).first()
    assert list(row) == pytest.approx([lev, jw, tokens, best], abs=1e-6)


def test_confidence_by_level_and_sources(spark):
    levels = ["exact", "normalized", "alias", "fuzzy", "fallback"]
    assert each(spark, levels, lambda c: numbers.confidence(F.lit(1.0), F.lit(90), c, F.lit(1))) == [85, 82, 80, 76, 72]
    assert each(spark, "12349", lambda c: numbers.confidence(F.lit(0.0), F.lit(1), F.lit("none"), c.cast("int"))) == [2, 7, 12, 17, 17]


def test_freshness_limits(spark):
    assert each(spark, [None, "130", "131", "370", "371"], lambda c: numbers.freshness(c.cast("double"))) == ["never", "ok", "warning", "warning", "critical"]


def test_active_date_turns_at_midnight_in_istanbul(spark):
    days = each(spark, ["2026-01-01 20:59:00", "2026-01-01 21:00:00"], lambda c: numbers.active_date(c.cast("timestamp")).cast("string"))
    assert days == ["2026-01-01", "2026-01-02"]


def test_distance_to_itself_is_never_nan(spark):
    assert each(spark, ["41.0"], lambda c: numbers.distance_km(c.cast("double"), F.lit(29.0), 41.0, 29.0))[0] < 0.01


def test_url_faults(spark):
    urls = ["http://10.0.0.1", "ftp://a", "http://x.local", "https://ok.tr"]
    assert each(spark, urls, text.url_fault) == ["private_ip", "protocol", "tld", "ok"]


def test_severities(spark):
    assert each(spark, ["high", "medium", "low", "critical", "", "x"], text.severity) == ["critical", "warning", "info", "critical", "warning", "warning"]

import pytest
from pyspark.sql import functions as F

from lantern.sources import pages

TEL = '<a href="tel:0232 111 22 33">ara</a>'
CASES = {
    "antalya_nobetci_div_v1": (f'<div class="nobetciDiv"><h4>AKSU ECZANESI</h4>{TEL}{TEL}<i class="fa-home"></i> Sokak 1<br></div>', ("AKSU ECZANESI", "", "Sokak 1", "0232 111 22 33")),
    "osmaniye_eo_v1": (f'<div class="x nobet-kart"><h4>01.01.2026 / <strong>AKSU</strong> - KADİRLİ</h4><i class="fa-home"></i> Sokak 1<br>{TEL}<hr>', ("AKSU", "KADİRLİ", "Sokak 1", "0232 111 22 33")),
    "teknoecza_v1": ('<a title="Nöbetçi Eczane" href="x">AKSU</a> <span>(Bor)</span>', ("AKSU", "Bor", "", "")),
    "teknoecza_v2": ('<a href="nobetci-eczaneler" title="Bugün nöbetçi">AKSU / <strong><small>Efeler</small></strong></a>', ("AKSU", "Efeler", "", "")),
    "yandex_placemark_v1": ("ymaps.Placemark([36.5, 36.25], {balloonContent: '<strong>AKSU</strong><br>x'})", ("AKSU", "", "", "")),
    "icon_user_md_v1": (f'<i class="icon-user-md"></i> AKSU ECZ<br><i class="icon-home"></i> Sokak 1<br>{TEL}', ("AKSU ECZ", "", "Sokak 1", "0232 111 22 33")),
    "trend_item_v1": (f'<div class="trend-item"><h3>AKSU ECZ</h3><h5>Merkez</h5><i class="icon-home"></i><i class="fa-map-marker"></i> Sokak 1<br>{TEL}', ("AKSU ECZ", "Merkez", "Sokak 1", "0232 111 22 33")),
    "karaman_vatan_hl_v1": (f'<h2 class="vatan_hl">Ermenek Nöbetçi Eczaneler 01.01.2026</h2><h4>AKSU</h4><i class="icon-home"></i> Sokak 1<br> {TEL}', ("AKSU", "Ermenek", "Sokak 1", "0232 111 22 33")),
    "konya_v1": ('<table class="baslik_eczane"><tr><td>Bölge</td><td>x</td><td>Eczane</td></tr><tr><td>Meram</td><td>1</td><td>AKSU</td></tr></table>', ("AKSU", "Meram", "", "")),
    "inline_box_v1": ('<div data-name="AKSU" data-district="Bornova"><h4>Aksu Ecz</h4><p>Sokak 1 <a href="tel:0232">0232</a></p></div>', ("Aksu Ecz", "Bornova", "Sokak 1", "0232")),
}


@pytest.mark.parametrize("key", list(CASES))
def test_layout(spark, key):
    html, wanted = CASES[key]
    got = pages.dispatch(spark.createDataFrame([(html,)], "html string")).first()
    assert got["parser"] == key
    assert [(r["name"], r["district"], r["address"], r["phone"]) for r in got["rows"]] == [wanted]


def test_sections_and_json(spark):
    html = '<li data-name="AKSU" data-district="Bala"><h4>AKSU ECZ</h4><p>Sokak 1 <span>0312 111 22 33</span></p>'
    data = '{"data": [{"name": "KONAK", "pharmacy": {"name": "", "gsm": "0276"}}, {"pharmacy": {"name": "AKSU ECZ", "district": "Esme"}}]}'
    df = spark.createDataFrame([(html, data)], "html string, data string")
    a, b = df.select(pages.named_sections(F.col("html")), pages.nested_json_rows(F.col("data"))).first()
    assert a[0][:4] == ("AKSU ECZ", "Bala", "Sokak 1", "0312 111 22 33")
    assert [r[:4] for r in b] == [("KONAK ECZANESİ", "", "", "0276"), ("AKSU ECZ", "Esme", "", "")]


def test_placemarks_have_coordinates(spark):
    r = pages.dispatch(spark.createDataFrame([(CASES["yandex_placemark_v1"][0],)], "html string")).first()["rows"][0]
    assert (r["lat"], r["lng"]) == (36.5, 36.25)


def test_pages_without_rows(spark):
    df = spark.createDataFrame([(None,), ("",), (" ",), ("<p>x</p>",)], "html string")
    got = pages.dispatch(df, F.lit("antalya_nobetci_div_v1")).collect()
    assert [(r["strategy"], r["parser"]) for r in got] == [(s, "antalya_nobetci_div_v1") for s in ("empty_html", "empty_html", "no_match", "no_match")]


def rows(spark, parser, html):
    return [tuple(r)[:4] for r in spark.createDataFrame([(html,)], "html string").select(parser(F.col("html"))).first()[0]]


def test_cards_under_headings(spark):
    card = "<h3>{}</h3><i class='fa fa-phone'></i> 0232 1112233<br>"
    html = "<h2>KONAK NÖBETÇİ ECZANELER</h2>" + card.format("AKSU ECZANESI - Buca") + "<h2>Duyurular</h2>" + card.format("ÇINAR ECZANESI") + "x" * 2600 + card.format("ECZ") + "<h4>UZAK ECZANESI</h4>" + "x" * 2600 + TEL
    assert rows(spark, pages.headings, html) == [("AKSU ECZANESI", "Buca", "", "0232 1112233"), ("ÇINAR ECZANESI", "KONAK", "", "0232 1112233")]


def test_links_in_bold_to_a_map(spark):
    link = '<a href="https://maps.google.com/?q=1,2" style="font-weight:bold">{}</a>'
    assert rows(spark, pages.map_links, link.format("GECE : AKSU") + link.format("ab") + "<b>x</b>" + link.format("Konak")) == [("AKSU", "", "", ""), ("Konak", "", "", "")]


def test_a_parser_that_is_asked_for_needs_no_mark(spark):
    html = [("table_auto_v1", "<table><tr><th>İsim Eczane</th></tr><tr><td>AKSU</td></tr></table>"), ("amasya_v1", CASES["konya_v1"][0]), ("x", "<h3>AKSU ECZ</h3>" + TEL)]
    got = pages.dispatch(spark.createDataFrame(html, "k string, html string"), F.col("k")).orderBy("k").collect()
    assert [(r["strategy"], r["parser"], len(r["rows"])) for r in got] == [("auto", "konya_v1", 1), ("keyed", "table_auto_v1", 1), ("no_match", "x", 0)]

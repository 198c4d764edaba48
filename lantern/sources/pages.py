"""Raw pages and JSON to rows of name, district, address, phone, lat and lng. A page is a row; each parser gives an array of
rows for it, and the first parser in the order that finds any wins, as dispatch does."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lantern.functions import text

FIELDS = ("name", "district", "address", "phone", "lat", "lng")
KIND = "array<struct<name:string,district:string,address:string,phone:string,lat:double,lng:double>>"


def row(name: Column, district=None, address=None, phone=None, lat=None, lng=None) -> Column:
    made = [F.coalesce(c, F.lit("")) if c is not None else F.lit("") for c in (name, district, address, phone)]
    made += [c.cast("double") if c is not None else F.lit(None).cast("double") for c in (lat, lng)]
    return F.struct(*[c.alias(n) for c, n in zip(made, FIELDS, strict=True)])


def _clean(s: Column) -> Column:
    return text.squeezed(text.decode_entities(text.strip_tags(s)))


def _valid(rows: Column, least: int = 3) -> Column:
    return F.filter(rows, lambda r: F.length(r["name"]) >= least)


def _none() -> Column:
    return F.array().cast(KIND)


def _first_found(*found: Column) -> Column:
    """The first array that isn't empty, else the last; those behind it aren't computed."""
    return F.coalesce(*[F.get(F.filter(F.array(rows), lambda a: F.size(a) > 0), 0) for rows in found[:-1]], found[-1])


# Cards. A pattern finds the cards of a page in one pass each for the groups that are asked for: the card itself, fields, and,
# by a group that looks ahead, a stretch of so many characters behind it. Fields are then looked for in the card alone.
def _cards(html: Column, pattern: str, *groups: int) -> Column:
    """For each match the named groups as g0, g1, ..."""
    found = [F.regexp_extract_all(html, F.lit(f"(?is){pattern}"), F.lit(g)).alias(f"g{g}") for g in groups]
    return F.arrays_zip(*found)


def _in(part: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(part, f"(?is){pattern}", group)


def _tag(part: Column, tag: str) -> Column:
    return text.strip_tags(_in(part, rf"<{tag}[^>]*>(.*?)</{tag}>"))


def _blank(least: int) -> str:
    """A pattern like \\s*, before something of so many characters that ends at a tag. It gives back no more of the white space
    than those, as more can't help."""
    return rf"(?>\s*(?=\s{{{least}}}(?!\s))|)\s{{0,{least}}}"


def _after(part: Column, icon: str, what: str, end: str, least: int = 3) -> Column:
    """What follows an icon, as html, of so many characters at least."""
    return _in(part, rf"{icon}[^>]*(?:></i>|>){_blank(least)}({what})(?:{end})")


def _coordinates(part: Column) -> tuple[Column, Column]:
    """Latitude and longitude of the first link to a map that has them; null if there is none."""
    return tuple(F.regexp_extract(part, MAP_LINK, k).try_cast("double") for k in (1, 2))


#: A number beside an icon.
DIGITS, DIGITS_END = r"[\d\s()+\-]{7,20}?", "<br|</|<i|<a"


def _phone(part: Column, icon: str | None = None) -> Column:
    """The number of the first link that dials, else the one beside an icon."""
    other = _after(part, icon, DIGITS, DIGITS_END, 7) if icon else F.lit("")
    return text.clean_phone(text.held(lambda dialled: F.when(dialled != "", dialled).otherwise(other), _in(part, 'href="tel:([^"]+)"')))


def _without(s: Column, part: Column) -> Column:
    """s without the first occurrence of part."""
    cut = lambda s, part, at: F.when((part != "") & (at > 0), F.concat(s.substr(F.lit(1), at - 1), s.substr(at + F.length(part), F.length(s)))).otherwise(s)
    return text.held(lambda s, part: text.held(cut, s, part, F.instr(s, part)), s, part)


def _places(html: Column, mark: str) -> Column:
    """Where a mark stands: its offsets from 1."""
    add = lambda ends: F.aggregate(F.slice(ends, 1, F.size(ends) - 1), F.array(F.lit(1)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    cut = text.held(add, F.transform(F.split(html, rf"(?i)(?={mark})"), F.length))
    return F.filter(cut, lambda at: F.lower(html.substr(at, F.lit(len(mark)))) == mark.lower())


# Patterns of normalised headers by the column that they name, and links to maps with coordinates.
HEADERS = {"name": r"eczane|adi|name\b|isim", "address": "adres|address", "phone": r"telefon|tel\b|phone|gsm", "district": "ilce|bolge|semt|district|mahalle"}
MAP_LINK = r'(?i)href="https?://(?:maps\.google\.com|www\.google\.com/maps)[^"]*[?&]q=(-?\d+\.\d+),(-?\d+\.\d+)'


def tables(html: Column) -> Column:
    """The largest table of two rows or more, blank ones not counted, with a header in its first four rows that has a column
    of names; the first of equally large ones. A row's link to a map gives its coordinates."""
    all_rows = F.transform(
        F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1)),
        lambda t: F.filter(
            F.transform(
                F.regexp_extract_all(t, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)),
                lambda r: F.struct(F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), _clean).alias("cells"), r.alias("raw")),
            ),
            lambda r: F.exists(r["cells"], lambda c: c != ""),
        ),
    )
    kind = "array<struct<cells:array<string>,raw:string>>"
    largest = F.aggregate(all_rows, F.array().cast(kind), lambda best, t: F.when(F.size(t) > F.size(best), t).otherwise(best))

    def column(cells: Column, pattern: str) -> Column:
        return F.array_position(F.transform(cells, lambda c: c.rlike(pattern)), True).cast("int")

    def headed(largest: Column, head: Column) -> Column:
        cells = F.transform(F.coalesce(F.try_element_at(largest, head)["cells"], F.array().cast("array<string>")), text.normalize_text)
        rows = lambda *at: below(F.slice(largest, head + 1, F.size(largest)), dict(zip(HEADERS, at, strict=True)))
        return text.held(lambda cells: text.held(rows, *[column(cells, p) for p in HEADERS.values()]), cells)

    def below(rest: Column, at: dict[str, Column]) -> Column:
        get = lambda r, k: F.when(at[k] > 0, F.try_element_at(r["cells"], at[k]))
        return _valid(F.transform(rest, lambda r: row(get(r, "name"), get(r, "district"), get(r, "address"), text.clean_phone(get(r, "phone")), *_coordinates(r["raw"]))))

    named = lambda r: F.exists(r["cells"], lambda c: text.normalize_text(c).rlike(HEADERS["name"]))
    head = lambda largest: F.array_position(F.transform(F.slice(largest, 1, 4), named), True).cast("int")
    made = lambda largest, head: F.when((F.size(largest) >= 2) & (head > 0), headed(largest, head)).otherwise(_none())
    return text.held(lambda largest: text.held(made, largest, head(largest)), largest)


# Fixed values in the parsers below: class names, attributes, titles, distances and ends of fields of those pages.
def inline_boxes(html: Column) -> Column:
    """Boxes with data-name and, near it, data-district. A box goes up to the next data-name, the last for 3000 characters; a
    heading h4 in it is the fuller name, its first paragraph has the address and a phone, which is taken out."""
    found = F.arrays_zip(*[F.regexp_extract_all(html, F.lit(r'(?s)data-name="([^"]+)".{0,200}?data-district="([^"]+)"(?=(.*?)(data-name=|\z))'), F.lit(g)).alias(f"g{g}") for g in range(5)])

    def one(m: Column) -> Column:
        inner = F.instr(m["g0"].substr(F.lit(11), F.length(m["g0"])), "data-name=")
        whole = F.concat(m["g0"], m["g3"])
        box = F.when(inner > 0, m["g0"].substr(F.lit(1), inner + 9)).when(m["g4"] == "", whole.substr(1, 3000)).otherwise(whole)
        body = lambda box: F.regexp_replace(F.regexp_replace(_in(box, "<p[^>]*>(.*?)</p>"), "(?is)<svg.*?</svg>", ""), "(?is)<h[1-6][^>]*>.*?</h[1-6]>", "")
        phone = lambda body: text.clean_phone(text.held(lambda linked: F.when(linked != "", linked).otherwise(_in(body, "<span[^>]*>([0-9 ()-]{7,})</span>")), _in(body, 'href="tel:([^"]+)"')))

        def fields(box: Column, body: Column, phone: Column) -> Column:
            name = F.when(box.rlike("(?is)<h4[^>]*>.*?</h4>"), _tag(box, "h4")).otherwise(F.trim(m["g1"]))
            return row(name, F.trim(m["g2"]), text.squeezed(_without(text.strip_tags(body), phone)), phone, *_coordinates(box))

        return text.held(lambda box: text.held(lambda body: text.held(lambda phone: fields(box, body, phone), phone(body)), body(box)), box)

    return _valid(F.transform(found, one))


HEADING = r"<h[1-5][^>]*>(.*?)</h[1-5]>"


def headings(html: Column) -> Column:
    """Cards under headings that name a pharmacy, each up to the next such heading or for 2500 characters. A heading of a list
    (ECZANELER) gives the district of the cards behind it that have none in the name, beside an arrow or in an h5. Cards
    without phone and address are left out."""
    title = lambda p: F.when(p.rlike(f"(?is)^{HEADING}"), text.strip_tags(_in(p, HEADING))).otherwise("")
    pieces = F.transform(F.split(html, "(?i)(?=<h[1-5][^>]*>)"), lambda p: F.struct(p.alias("p"), title(p).alias("title")))

    def cards(pieces: Column) -> Column:
        named = lambda i: (F.length(F.get(pieces, i)["title"]) >= 5) & F.get(pieces, i)["title"].rlike("(?i)ecz")
        return text.held(lambda at: F.transform(at, lambda i, k: card(pieces, at, i, k)), F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), named))

    def card(pieces: Column, at: Column, i: Column, k: Column) -> Column:
        end = F.coalesce(F.get(at, k + 1), F.size(pieces))
        part = F.array_join(F.transform(F.slice(pieces, i + 1, end - i), lambda x: x["p"]), "")
        return F.struct(F.get(pieces, i)["title"].alias("title"), part.substr(1, 2500).alias("part"))

    def section(title: Column) -> Column:
        """The district that the heading of a list names, or nothing."""
        s = F.regexp_replace(title, r"(?i)\s*BUG[Üü]N\s+", " ")
        for rest in (r"\s*N[Öö]BET[Çç]İ\s+ECZANELER.*", r"\s*ECZANELER.*", r"\s*HAFTALIK\s+.*", r"\s*\d{2}[-./]\d{2}[-./]\d{4}.*"):
            s = F.regexp_replace(s, f"(?i){rest}", "")
        return text.held(lambda s: F.when(F.length(s).between(3, 40) & ~F.lower(s).contains("eczac"), s), F.trim(s))

    def one(c: Column, last: Column) -> Column:
        part = c["part"]
        arrow = text.strip_tags(_after(part, "fa-arrow-right", ".{1,60}?", r"<br|</span|<i\s", 1))
        home = _in(part, rf"fa-(?:home|address-card)[^>]*(?:></i>|>){_blank(3)}(.{{3,600}}?)(?=<i\s[^>]*fa-(?:phone|map-marker|whatsapp|envelope|fax))")
        behind = _after(part, "icon-home", ".{3,400}?", r"<br\s*/?> |<a\s|</p|<i\s")
        near = text.strip_tags(_after(part, "fa-map-marker", "(?:(?!<a)[^<]|<[^a/]){3,300}?", r"<br\s*/?> |</p|</div|<i\s"))
        near = text.held(lambda near: F.when((F.length(near) >= 5) & ~near.rlike("(?i)harita|konum|map"), near).otherwise(""), near)
        small = text.held(lambda small: F.when(F.length(small).between(2, 40) & ~small.rlike("(?i)ecz"), small), _tag(part, "h5"))
        place = text.held(lambda home: F.when(home != "", text.strip_tags(home)), text.held(lambda home: F.when(home != "", home).otherwise(behind), home))

        def fields(split: Column, dashed: Column) -> Column:
            district = F.when(dashed, F.trim(split)).otherwise(F.coalesce(text.held(lambda arrow: F.when(arrow != "", arrow), arrow), small, last))
            name = F.when(dashed, F.trim(_in(c["title"], r"^(.+?)\s+-\s+.+$"))).otherwise(c["title"])
            return row(name, district, F.coalesce(place, near), _phone(part, "(?:fa-phone|icon-phone)"), *_coordinates(part))

        return text.held(lambda split: text.held(fields, split, (split != "") & ~F.lower(split).contains("eczane")), _in(c["title"], r"^.+?\s+-\s+(.+)$"))

    start = F.struct(F.lit("").alias("last"), _none().alias("rows"))

    def step(acc: Column, c: Column) -> Column:
        of_list = F.struct(F.coalesce(section(c["title"]), acc["last"]).alias("last"), acc["rows"].alias("rows"))
        return F.when(c["title"].rlike("(?i)eczaneler"), of_list).otherwise(F.struct(acc["last"].alias("last"), F.concat(acc["rows"], F.array(one(c, acc["last"]))).alias("rows")))

    found = F.aggregate(text.held(cards, pieces), start, step, lambda acc: acc["rows"])
    return F.filter(_valid(found), lambda r: (r["phone"] != "") | (r["address"] != ""))


def map_links(html: Column) -> Column:
    """Names in bold links to a map; a shift before the name goes."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a href="https://maps\.google\.com[^"]*"[^>]*style="[^"]*font-weight:bold[^"]*"[^>]*>([^<]+)</a>'), F.lit(1))
    return _valid(F.transform(found, lambda n: row(text.trimmed(F.regexp_replace(text.trimmed(n), r"(?i)^(?:G[Üü]ND[Üü]Z-GECE|GECE|G[Üü]ND[Üü]Z)\s*[:\s]+", "")))))


def definition_pairs(html: Column) -> Column:
    """Elements of class eczaneismi, each with the next one of class eczaneadres within 400 characters."""
    found = _cards(html, r"eczaneismi[^>]*>(.*?)</[^>]+>.{0,400}?eczaneadres[^>]*>(.*?)</[^>]+>", 1, 2)
    return _valid(F.transform(found, lambda m: row(text.strip_tags(m["g1"]), None, text.strip_tags(m["g2"]))))


def duty_boxes(html: Column) -> Column:
    """nobetciDiv with two links that dial: a name as heading or as text of the first of them, an address as map link or
    beside an icon, also in the 800 characters behind."""

    def one(m: Column) -> Column:
        linked = text.squeezed(_in(m["g0"], '<a href="tel:[^"]*">([^<]+)</a>'))
        mapped = r'maps\.google\.com[^"]*"[^>]*class="nadres"[^>]*>(.{0,300}?)</a>'

        def fields(block: Column, named: Column) -> Column:
            place = F.when(block.rlike(f"(?is){mapped}"), _in(block, mapped)).otherwise(_after(block, "fa-home", ".{3,400}?", r"<br|</p|<i\s"))
            return row(F.when(named != "", named).otherwise(linked), None, text.strip_tags(place), text.clean_phone(m["g1"]), *_coordinates(block))

        return text.held(fields, F.concat(m["g0"], m["g2"]), _tag(m["g0"], "h4"))

    return _valid(F.transform(_cards(html, 'nobetciDiv.{0,800}?href="tel:([^"]+)".{0,200}?href="tel:[^"]+"(?=(.{0,800}))', 0, 1, 2), one))


def duty_cards(html: Column) -> Column:
    """nobet-kart, each up to a rule: a heading `date / city DISTRICT <strong>name</strong>` or `... - DISTRICT`."""
    letters = "a-zÇĞİÖŞÜçğöşü"

    def one(m: Column) -> Column:
        block = m["g1"]
        near = _in(block, rf"fa-home[^>]*(?:></i>|>){_blank(3)}(.{{3,700}}?)(?=<br\s*/?>\s*<i[^>]*fa-phone|<i[^>]*fa-phone|</p>)")
        other = _in(block, rf'fa-home[^>]*(?:></i>|>){_blank(3)}(.{{3,700}}?)(?=<a[^>]+href="tel:)')
        near = text.held(lambda near: F.when(near != "", near).otherwise(other), near)

        def fields(head: Column, strong: Column) -> Column:
            bare = F.regexp_replace(F.regexp_replace(head, r"^\d{2}\.\d{2}\.\d{4}\s*/\s*", ""), rf"(?i)^OSMAN[Iİ]YE\s+[{letters}]+\s+", "")
            dashed, slashed = text.squeezed(_in(head, rf"-\s*([{letters} ]{{2,40}})$")), _in(head, rf"/\s*OSMAN[Iİ]YE\s+([{letters}]{{2,40}})")
            district = text.held(lambda dashed: F.when(dashed != "", dashed).otherwise(slashed), dashed)
            return row(F.when(strong != "", strong).otherwise(F.trim(bare)), district, text.strip_tags(near), _phone(block), *_coordinates(block))

        return text.held(fields, _tag(block, "h4"), _tag(_in(block, "<h4[^>]*>(.*?)</h4>"), "strong"))

    return _valid(F.transform(_cards(html, r'<div[^>]*class="[^"]*nobet-kart[^"]*"[^>]*>(.*?)<hr>', 1), one), 2)


def titled_links(html: Column) -> Column:
    """Links titled Nöbetçi Eczane: those with a district in brackets within 120 characters; if there are none, all of them;
    then cards in columns."""
    link = r'title="N[Öö]bet[Çç]i Eczane"[^>]*>([^<]+)</a>'
    placed = _valid(F.transform(_cards(html, link + r".{0,120}<span[^>]*>\(([^)]+)\)", 1, 2), lambda m: row(text.squeezed(m["g1"]), text.trimmed(m["g2"]))))
    plain = _valid(F.transform(_cards(html, link, 1), lambda m: row(text.squeezed(m["g1"]))))

    def one(m: Column) -> Column:
        c = m["g1"]
        name = text.squeezed(_in(c, r"<strong>\s*([^<]*?ECZANES[İI]?)\s*</strong>"))
        return row(name, text.strip_tags(_after(c, "icon-hand-right", ".{1,80}?", r"<br|<i\s", 1)), text.strip_tags(_after(c, "icon-home", ".{3,450}?", r"<br|<i\s")), _phone(c, "icon-phone"), *_coordinates(c))

    columns = _valid(F.transform(_cards(html, r'<div class="eight columns bottom-1">(.{0,1800}?)(?:<p><hr></p>|</div>\s*</div>)', 1), one))
    return _first_found(placed, plain, columns)


def marquees(html: Column) -> Column:
    """Links to nobetci-eczaneler titled Bugün..., their text `name / <strong><small>district`."""
    link = r'href="nobetci-eczaneler"[^>]*title="Bug[Üü]n[^"]*"[^>]*>([^/<]+)\s*/\s*<strong><small>([^<]+)</small>'
    return _valid(F.transform(_cards(html, link, 1, 2), lambda m: row(text.squeezed(m["g1"]), text.trimmed(m["g2"]))), 2)


def placemarks(html: Column) -> Column:
    """Marks of a script's map, with coordinates and a name in bold; a mark's text gives no district or phone."""
    mark = r"ymaps\.Placemark\(\s*\[\s*(-?\d+(?:\.\d+)?)\s*,\s*(-?\d+(?:\.\d+)?)\s*\]\s*,\s*\{\s*balloonContent:\s*'(.*?)'\s*\}"
    return _valid(F.transform(_cards(html, mark, 1, 2, 3), lambda m: row(_tag(F.replace(m["g3"], F.lit("\\'"), F.lit("'")), "strong"), None, None, None, m["g1"], m["g2"])))


def icon_blocks(html: Column) -> Column:
    """A name beside icon-user-md, with icon-home within 1200 characters, an address beside it; fields within 1200 too."""

    def one(m: Column) -> Column:
        c = m["g1"]
        place = text.strip_tags(_after(c, "icon-home", ".{3,300}?", r"<br|</p|</div|<i\s"))
        return row(text.strip_tags(_after(c, "icon-user-md", ".{1,200}?", "<br|</", 1)), None, place, _phone(c, "icon-phone"), *_coordinates(c))

    return _valid(F.transform(_cards(html, "(?=icon-user-md)(?=(.{1,1200}))icon-user-md.{0,1200}?icon-home", 1), one))


def trend_items(html: Column) -> Column:
    """trend-item cards with icon-home within 1200 characters: name in h3, district in h5; a phone or an address is needed."""

    def one(m: Column) -> Column:
        c = m["g1"]
        place = text.strip_tags(_after(c, "fa-map-marker", ".{3,300}?", r"<br|</p|</div|<i\s|<a\s"))
        place = text.held(lambda place: F.when(place.rlike("(?i)harita|konum|map"), "").otherwise(place), place)
        return row(_tag(c, "h3"), _tag(c, "h5"), place, _phone(c, "fa-phone"), *_coordinates(c))

    rows = F.transform(_cards(html, '(?=class="[^"]*trend-item)(?=(.{1,1200}))class="[^"]*trend-item[^"]*".{0,1200}?icon-home', 1), one)
    return F.filter(_valid(rows), lambda r: r["name"].rlike("(?i)ecz") & ((r["phone"] != "") | (r["address"] != "")))


def district_sections(html: Column) -> Column:
    """Addresses beside icon-home. The last h4 within 800 characters before one is its name, the last heading h2 of class
    vatan_hl before it gives the district, 500 characters behind it have the phone."""
    heads = F.transform(_places(html, "<h2"), lambda at: F.struct(at.alias("at"), _section(html.substr(at, F.lit(2000))).alias("district")))
    heads = F.filter(heads, lambda h: F.length(h["district"]).between(2, 50))
    match = rf"^icon-home[^>]*(?:></i>|>){_blank(3)}(.{{3,300}}?)(?:<br\s*/?> |</p|<i\s)"

    def one(at: Column, heads: Column) -> Column:
        before = html.substr(F.greatest(at - 800, F.lit(1)), F.least(at - 1, F.lit(800)))
        name = F.element_at(F.concat(F.array(F.lit("")), F.transform(F.regexp_extract_all(before, F.lit("(?is)<h4[^>]*>(.*?)</h4>"), F.lit(1)), text.strip_tags)), -1)
        district = F.coalesce(F.try_element_at(F.filter(heads, lambda h: h["at"] < at), F.lit(-1))["district"], F.lit(""))
        fields = lambda behind, card: row(name, district, text.strip_tags(_in(card, match)), _phone(behind, "icon-phone"), *_coordinates(behind))
        return text.held(lambda card: text.held(fields, card.substr(F.length(_in(card, match, 0)) + 1, F.lit(500)), card), html.substr(at, F.lit(2000)))

    rows = text.held(lambda heads: F.transform(_places(html, "icon-home"), lambda at: one(at, heads)), heads)
    good = F.filter(rows, lambda r: (F.length(r["name"]) >= 2) & ~r["name"].rlike("(?i)eczaneler|n[Öö]bet[Çç]i") & (F.length(r["address"]) >= 5))
    return F.when(html.contains("vatan_hl") & html.contains("icon-home"), good).otherwise(_none())


def _section(part: Column) -> Column:
    """The district in a heading of class vatan_hl at the start of part."""
    s = F.regexp_replace(text.strip_tags(_in(part, '^<h2[^>]*class="[^"]*vatan_hl[^"]*"[^>]*>(.*?)</h2>')), r"(?i)\s*n[Öö]bet[Çç]i\s+eczaneler?", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"(?i)\s*nobetci\s+eczaneler?", ""), r"\s*\d{1,2}[-./]\d{1,2}[-./]\d{2,4}.*", ""))


def nested_tables(html: Column) -> Column:
    """Rows of cells whose column of names is set by the last row with a cell `eczane`; the first cell is the district."""
    lines = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1)), _clean))
    start = F.struct(F.lit(2).cast("long").alias("at"), _none().alias("rows"))

    def step(acc: Column, cells: Column) -> Column:
        def taken(at: Column, name: Column) -> Column:
            good = (F.size(cells) >= 2) & (F.length(name) >= 2) & ~name.rlike("(?i)bug[Üü]n|n[Öö]bet[Çç]i|eczaneler|hastalar|^adres$|^telefon$|^b[Öö]lge$|b[Öö]lge eczane")
            more = F.concat(acc["rows"], F.array(row(name, F.try_element_at(cells, F.lit(1)))))
            return F.when((F.size(cells) >= 2) & (at > 0), F.struct(at.alias("at"), acc["rows"].alias("rows"))).when(good, F.struct(acc["at"].alias("at"), more.alias("rows"))).otherwise(acc)

        return text.held(taken, F.array_position(F.transform(cells, F.lower), "eczane"), F.coalesce(F.try_element_at(cells, acc["at"].cast("int")), F.lit("")))

    return F.when(html.rlike("baslik_eczane|konyanobetci"), F.aggregate(lines, start, step, lambda acc: acc["rows"])).otherwise(_none())


def named_sections(html: Column) -> Column:
    """data-name with data-district beside it, up to the next data-name, the last for 3000 characters: behind it a fuller name
    in h4 and a paragraph of address and phone."""
    found = _cards(html, r'data-name="([^"]+)"\s+data-district="([^"]+)"(?=(.*?)(data-name=|\z))', 0, 1, 2, 3, 4)

    def one(m: Column) -> Column:
        whole = F.concat(m["g0"], m["g3"])
        box = F.when(m["g4"] == "", whole.substr(1, 3000)).otherwise(whole)

        def fields(box: Column, body: Column, phone: Column) -> Column:
            fuller = text.trimmed(F.regexp_replace(_in(box, "<h4[^>]*>(.*?)</h4>"), "<[^>]+>", ""))
            name = text.held(lambda fuller, given: F.when(fuller != "", fuller).otherwise(given), fuller, text.trimmed(m["g1"]))
            return F.struct((F.length(text.trimmed(m["g1"])) >= 3).alias("long"), row(name, text.trimmed(m["g2"]), F.trim(_without(text.strip_tags(body), phone)), phone).alias("row"))

        phone = lambda body: text.held(lambda span: F.when(span != "", text.clean_phone(span)).otherwise(_phone(body)), _in(body, "<span[^>]*>([0-9 ()+-]{7,})</span>"))
        body = lambda box: F.regexp_replace(_in(box, "<p[^>]*>(.*?)</p>"), "(?is)<svg.*?</svg>", "")
        return text.held(lambda box: text.held(lambda body: text.held(lambda phone: fields(box, body, phone), phone(body)), body(box)), box)

    return F.transform(F.filter(F.transform(found, one), lambda x: x["long"]), lambda x: x["row"])


# Parsers by the keys under which sources ask for them, those tried on any page first, in their order.
PARSERS: dict[str, Callable[[Column], Column]] = {
    "osmaniye_eo_v1": duty_cards,
    "antalya_nobetci_div_v1": duty_boxes,
    "konya_v1": nested_tables,
    "karaman_vatan_hl_v1": district_sections,
    "yandex_placemark_v1": placemarks,
    "inline_box_v1": inline_boxes,
    "teknoecza_v2": marquees,
    "teknoecza_v1": titled_links,
    "eczaneismi_v1": definition_pairs,
    "trend_item_v1": trend_items,
    "icon_user_md_v1": icon_blocks,
    "table_auto_v1": tables,
}
# Other keys of these parsers. generic_auto_v1 asks for none.
KEY_ALIASES = {
    "adana_secondary_v1": "table_auto_v1",
    "hatay_v1": "yandex_placemark_v1",
    "isparta_v1": "trend_item_v1",
    "amasya_v1": "eczaneismi_v1",
    "nigde_v1": "teknoecza_v1",
    "aydin_v1": "teknoecza_v2",
}
# What a page must have for a parser to be tried on it unasked, all of them.
PROBES = {
    "osmaniye_eo_v1": ["nobet-kart"],
    "antalya_nobetci_div_v1": ["nobetciDiv"],
    "konya_v1": ["baslik_eczane|konyanobetci"],
    "karaman_vatan_hl_v1": ["vatan_hl", "icon-home"],
    "yandex_placemark_v1": [r"(?i)ymaps\.Placemark", "(?i)balloonContent"],
    "inline_box_v1": ['data-name="', 'data-district="'],
    "teknoecza_v2": ['href="nobetci-eczaneler"'],
    "teknoecza_v1": ["Nöbetçi Eczane"],
    "eczaneismi_v1": ["eczaneismi"],
    "trend_item_v1": ["trend-item"],
    "icon_user_md_v1": ["icon-user"],
    "table_auto_v1": [r"(?is)<table.*?</table>"],
}
#: Parsers that are no dispatch's: cards under headings, and the pages of two services.
OTHERS: dict[str, Callable[[Column], Column]] = {"card_auto_v1": headings, "map_link": map_links, "ankara": named_sections}


def register(key: str, parser: Callable[[Column], Column], probes: list[str] | None = None) -> None:
    """Adds a parser, a function of the html column that gives an array of rows, behind the others. Without probes it is tried
    on every page."""
    PARSERS[key] = parser
    PROBES[key] = probes or []


def dispatch(pages: DataFrame, key: Column | None = None, html: str = "html") -> DataFrame:
    """Adds strategy (empty_html, keyed, auto, no_match), parser and rows. The parser that key names, maybe by an alias, runs
    first, whatever the page has. If it finds no row, the parsers run in their order on a page that has what they look for,
    up to the first that finds rows. `parser` is the key that found them, else the key that was asked for."""
    h = F.coalesce(F.col(html), F.lit(""))
    asked = F.lit(None).cast("string") if key is None else key
    kind = "struct<parser:string,rows:" + KIND + ">"

    def attempt(k: str, parser: Callable[[Column], Column], ok: Column) -> Column:
        made = F.struct(F.lit(k).alias("parser"), F.coalesce(parser(h), _none()).alias("rows"))
        return F.when(ok, F.get(F.filter(F.array(made), lambda a: F.size(a["rows"]) > 0), 0))

    def probed(k: str) -> Column:
        ok = F.lit(True)
        for probe in PROBES[k]:
            ok = ok & h.rlike(probe)
        return ok

    out = pages.withColumn("_asked", asked)
    own = F.coalesce(text.lookup(F.col("_asked"), KEY_ALIASES, None), F.col("_asked"))
    keyed = [] if key is None else [attempt(k, parser, own == k) for k, parser in PARSERS.items()]
    out = out.withColumn("_keyed", F.coalesce(*keyed, F.lit(None).cast(kind)))
    out = out.withColumn("_auto", F.when(F.col("_keyed").isNull(), F.coalesce(*[attempt(k, parser, probed(k)) for k, parser in PARSERS.items()], F.lit(None).cast(kind))))
    out = out.withColumn("strategy", F.when(h == "", "empty_html").when(F.col("_keyed").isNotNull(), "keyed").when(F.col("_auto").isNotNull(), "auto").otherwise("no_match"))
    out = out.withColumn("parser", F.coalesce(F.when(F.col("_keyed").isNotNull(), F.col("_asked")), "_auto.parser", "_asked"))
    return out.withColumn("rows", F.coalesce("_keyed.rows", "_auto.rows", _none())).drop("_keyed", "_auto", "_asked")


def exploded(pages: DataFrame) -> DataFrame:
    return pages.select(*[c for c in pages.columns if c != "rows"], F.explode("rows").alias("r")).select("*", "r.*").drop("r")


# Keys under which sources give a field.
ALIASES = {
    "name": ["name", "pharmacy_name", "eczane", "ad"],
    "district": ["district", "ilce", "district_name"],
    "address": ["address", "adres", "addr"],
    "phone": ["phone", "telefon", "tel"],
}
ROOTS = ["data", "pharmacies", "result", "items"]


def safe_json(payload: Column) -> Column:
    """The fields of a JSON object as texts; none if it is broken, null or no object."""
    return F.coalesce(F.from_json(payload, "map<string,string>"), F.create_map().cast("map<string,string>"))


def json_rows(payload: Column) -> Column:
    """Rows of a JSON list, at the root or under a known key. The first key that is there wins, even if it is empty."""
    maps = "array<map<string,string>>"
    lists = [F.from_json(payload, maps), *[F.from_json(F.get_json_object(payload, f"$.{k}"), maps) for k in ROOTS]]
    items = F.coalesce(*[F.when(F.exists(x, lambda m: m.isNotNull()), x) for x in lists], F.array().cast(maps))
    pick = lambda m, f: F.trim(F.coalesce(*[F.try_element_at(m, F.lit(a)) for a in ALIASES[f]]))
    return _valid(F.transform(items, lambda m: row(pick(m, "name"), pick(m, "district"), pick(m, "address"), text.clean_phone(pick(m, "phone")))))


def nested_json_rows(payload: Column) -> Column:
    """Rows of a JSON list under data, eczaneler or rows, each with its fields under pharmacy or at the top. An empty value
    falls through to the next key; a name without the suffix gets it."""
    item = "array<struct<name:string,district:string,description:string,phone:string,pharmacy:struct<name:string,district:string,adres:string,gsm:string,phone:string>>>"
    items = F.coalesce(*[F.from_json(F.get_json_object(payload, f"$.{k}"), item) for k in ("data", "eczaneler", "rows")], F.array().cast(item))
    first = lambda *c: F.trim(F.coalesce(*[F.when(x != "", x) for x in c], F.lit("")))

    def one(m: Column) -> Column:
        p = m["pharmacy"]
        name = first(p["name"], m["name"])
        full = F.when(name.rlike(r"(?i)\becz"), name).otherwise(F.concat(name, F.lit(" ECZANESİ")))
        return row(full, first(p["district"], m["district"]), first(p["adres"], m["description"]), text.clean_phone(first(p["gsm"], p["phone"], m["phone"])))

    return _valid(F.transform(items, one))

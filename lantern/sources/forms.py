"""Forms of pages: which form asks for a duty list, and what to send with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lantern.functions import numbers, text
from lantern.sources.catalog import attribute

# Points of a form for patterns in its visible text, its folded html, its html, and its action.
TEXT_POINTS = [(r"NOBETLERI\s+GOSTER", None, 8), ("NOBETCI", "GOSTER", 3)]
HTML_POINTS = [(r"""TYPE=["']SUBMIT["'][^>]{0,140}VALUE=["'][^"']*GOSTER""", 8), (r"""VALUE=["'][^"']*GOSTER[^"']*["'][^>]{0,140}TYPE=["']SUBMIT""", 8)]
NAME_POINTS = [(r"""(?i)name=["'][^"']*(tarih|date)[^"']*["']""", 2), (r"""(?i)name=["'][^"']*(ilce|district|bolge)[^"']*["']""", 1)]
PRINT, PRINT_POINTS, PRINT_BUTTON, PRINT_BUTTON_POINTS = r"NOBET\s+KARTI\s+YAZDIR", -5, r"""TYPE=["']SUBMIT["'][^>]{0,140}VALUE=["'][^"']*YAZDIR""", -8
HERE, HERE_POINTS, CARD, CARD_POINTS = ["", "#", "./"], 1, "nobetkarti", -12
ALL = ["TUMU", "HEPSI", "ALL"]


def _upper(s: Column) -> Column:
    return F.upper(text.fold_turkish(s))


def form_score(form: Column) -> Column:
    """How much a form looks like the one that shows a duty list."""
    shown, html = _upper(F.regexp_replace(form, "<[^>]+>", " ")), _upper(form)
    action = F.lower(text.fold_turkish(F.coalesce(attribute(F.regexp_extract(form, r"(?i)<form\b[^>]*>", 0), "action"), F.lit(""))))
    points = lambda ok, n: F.when(ok, n).otherwise(0)
    score = F.lit(0)
    for first, second, n in TEXT_POINTS:
        score = score + points(shown.rlike(first) & (shown.rlike(second) if second else F.lit(True)), n)
    for pattern, n in HTML_POINTS:
        score = score + points(html.rlike(pattern), n)
    for pattern, n in NAME_POINTS:
        score = score + points(form.rlike(pattern), n)
    score = score + points(shown.rlike(PRINT) & ~shown.rlike(TEXT_POINTS[0][0]), PRINT_POINTS) + points(html.rlike(PRINT_BUTTON) & ~html.contains("GOSTER"), PRINT_BUTTON_POINTS)
    return score + points(action.isin(HERE), HERE_POINTS) + points(action.contains(CARD), CARD_POINTS)


def duty_form(html: Column) -> Column:
    """The form of the highest score above 0, the first of equal ones; null if there is none."""
    forms = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<form\b[^>]*>.*?</form>"), F.lit(0)), lambda f: F.struct(form_score(f).alias("score"), f.alias("form")))
    none = F.struct(F.lit(0).alias("score"), F.lit(None).cast("string").alias("form"))
    return F.aggregate(forms, none, lambda best, f: F.when(f["score"] > best["score"], f).otherwise(best), lambda best: best["form"])


def option(select: Column) -> Column:
    """The value to send for a select: that of the first option for all, else the selected one, else the first; empty if it
    has none."""
    tags = F.regexp_extract_all(select, F.lit(r"(?is)<option\b[^>]*>.*?</option>"), F.lit(0))

    def one(tag: Column) -> Column:
        shown = text.squeezed(F.regexp_replace(F.regexp_replace(F.regexp_extract(tag, r"(?is)<option\b[^>]*>(.*?)</option>", 1), "<[^>]+>", " "), "(?i)&nbsp;", " "))

        def fields(value: Column, both: Column) -> Column:
            every = both.isin("", "0")
            for word in ALL:
                every = every | both.contains(word)
            return F.struct(value.alias("value"), every.alias("all"), tag.rlike(r"(?i)\bselected\b").alias("selected"))

        upper = lambda value, shown: text.held(fields, value, F.trim(_upper(F.concat_ws(" ", value, shown))))
        return text.held(lambda shown: text.held(lambda value: upper(value, shown), F.trim(F.coalesce(attribute(tag, "value"), shown))), shown)

    first = lambda made, keep: F.get(F.filter(made, keep), 0)["value"]
    chosen = lambda made: F.coalesce(first(made, lambda o: o["all"]), first(made, lambda o: o["selected"]), first(made, lambda o: F.lit(True)), F.lit(""))
    return text.held(chosen, F.transform(tags, one))


# Inputs that are never sent, and names of inputs that hold a date.
UNSENT, DATES = ["button", "reset", "file", "image"], "(?i)(tarih|date|gun|day)"


def payload(form: Column, today: Column) -> Column:
    """A map of what to send with a form. Boxes that aren't checked, and a button behind the one that shows the list, are left
    out; dates become today's in the pattern that they have. A name that comes again takes the place of the earlier one."""
    tags = F.regexp_extract_all(form, F.lit(r"(?i)<input\b[^>]*>"), F.lit(0))

    def one(tag: Column) -> Column:
        def fields(name: Column, kind: Column, value: Column) -> Column:
            sent = (name != "") & ~kind.isin(UNSENT) & (~kind.isin("checkbox", "radio") | tag.rlike(r"(?i)\bchecked\b"))
            shows = (kind == "submit") & _upper(value).rlike(TEXT_POINTS[0][0])
            dated = F.when(name.rlike(DATES), numbers.coerced_date(F.trim(value), today)).otherwise(value)
            return F.struct(name.alias("name"), dated.alias("value"), (kind == "submit").alias("submit"), shows.alias("shows"), sent.alias("sent"))

        return text.held(fields, F.coalesce(attribute(tag, "name"), F.lit("")), F.lower(F.coalesce(attribute(tag, "type"), F.lit("text"))), F.coalesce(attribute(tag, "value"), F.lit("")))

    def pressed(inputs: Column, shows: Column) -> Column:
        """shows: the place of the first button that shows the list, 0 without one."""
        kept = lambda i, k: ~i["submit"] | i["shows"] | (shows == 0) | (shows > k)
        return F.transform(inputs, lambda i, k: F.struct(i["name"].alias("name"), i["value"].alias("value"), kept(i, k).alias("kept")))

    place = lambda inputs: text.held(pressed, inputs, F.array_position(F.transform(inputs, lambda i: i["shows"]), True))
    chosen = text.held(place, F.filter(F.transform(tags, one), lambda i: i["sent"]))
    selects = F.transform(
        F.regexp_extract_all(form, F.lit(r"(?is)<select\b[^>]*>.*?</select>"), F.lit(0)),
        lambda s: F.struct(F.coalesce(attribute(F.regexp_extract(s, r"(?i)^<select\b[^>]*>", 0), "name"), F.lit("")).alias("name"), option(s).alias("value"), F.lit(True).alias("kept")),
    )
    every = F.filter(F.concat(chosen, selects), lambda e: e["kept"] & (e["name"] != ""))
    empty = F.create_map().cast("map<string,string>")
    return F.aggregate(every, empty, lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["name"]), F.map_from_arrays(F.array(e["name"]), F.array(e["value"]))))

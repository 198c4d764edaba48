import random
import re

import pytest
from pyspark.sql import functions as F

from lantern import listing_queries, queries
from lantern.sources import forms, pages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", list(pages.PARSERS | pages.OTHERS))
def test_a_parser_names_its_patterns_a_few_times(spark, key):
    df = spark.createDataFrame([("x",)], "html string").select((pages.PARSERS | pages.OTHERS)[key](F.col("html")).alias("rows"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp") < 40


@pytest.mark.parametrize("name", ["prs0_dispatch", "js8_payload", *listing_queries._LAYOUTS])
def test_pages_of_a_small_file_are_no_single_tasks(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 4\n" in plan


def test_white_space_is_given_back_as_far_as_it_helps():
    rnd, end = random.Random(1), "(?:<br|</)"
    for _ in range(20_000):
        s = ">" + " " * rnd.randrange(9) + "".join(rnd.choices(["a", " ", "<br", "</", "<"], k=rnd.randrange(7)))
        for what, least in ((".{3,8}?", 3), (".{1,8}?", 1), (r"[a\s]{7,9}?", 7)):
            plain, short = (re.search(rf">{blank}({what}){end}", s) for blank in (r"\s*", pages._blank(least)))
            assert (plain and plain[1]) == (short and short[1]), s


def test_a_form_names_its_patterns_a_few_times(spark):
    df = spark.createDataFrame([("x",)], "form string").select(forms.payload(F.col("form"), F.lit("2024-01-31").cast("date")).alias("sent"))
    assert df._jdf.queryExecution().analyzed().toString().count("regexp") < 40


def test_buttons_behind_the_one_that_shows_the_list(spark):
    form = "<input type=submit name=a value=x><input type=submit name=b value='Nöbetleri Göster'><input type=submit name=c value=y><input type=submit name=d value='Nöbetleri Göster'><input name=e value=z>"
    sent = spark.createDataFrame([(form,)], "form string").select(forms.payload(F.col("form"), F.lit("2024-01-31").cast("date"))).first()[0]
    assert sent == {"a": "x", "b": "Nöbetleri Göster", "d": "Nöbetleri Göster", "e": "z"}

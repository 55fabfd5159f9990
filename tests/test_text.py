import html
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from needwell.functions import text


def test_clean_text_order_and_nulls(apply):
    given = [
        None,
        "",
        "  Tea\t&amp;\n\n cake   ",
        "\U0001d413\U0001d41e\U0001d41a ① ﬁne",
        "a\x00b\x07c\x7f",
        "&lt;b&gt; &#8212; &nbsp;x",
        "keep \U0001f680 here",
        "one two\x1cthree",
    ]
    # \x1c is a control character and goes before white space is collapsed
    assert apply(text.clean_text, given) == [
        "", "", "Tea & cake", "Tea 1 fine", "abc", "<b> — x", "keep \U0001f680 here", "one twothree",
    ]


def test_clean_text_is_idempotent_without_entities(apply):
    once = apply(text.clean_text, ["  ½  café ‍ x ", "Å ring"])
    assert apply(text.clean_text, once) == once


def test_stable_class_never_changes_under_nfkc():
    stable = re.compile(f"[{text.NFKC_STABLE}]")
    wrong = [c for c in map(chr, range(0x30000)) if stable.fullmatch(c) and unicodedata.normalize("NFKC", c) != c]
    assert wrong == []


def test_fold_equals_standard_library(apply):
    given = ["R&eacute;sum&eacute; ＡＢ", "&notit; &#x1F600;", "plain", "İstanbul", "é"]
    expected = [unicodedata.normalize("NFKC", html.unescape(v)) for v in given]
    assert apply(text.fold_text, given) == expected


@pytest.mark.parametrize(
    ("raw", "value", "doubtful"),
    [
        ("Nora Weiss 12ab", "Nora Weiss", False),
        ("Nora 7 Weiss 1 2", "Nora 7 Weiss", True),
        ("12345", "12345", True),
        ("Maximilianowski", "Maximilianowski", True),
        ("Max", "Max", False),
        ("\U0001f31f Ines ⭐ Duarte", "Ines Duarte", False),
        ("\U0001f680", "", True),
        (None, "", True),
        ("Kim ٣٤", "Kim", False),
    ],
)
def test_author_names(apply, raw, value, doubtful):
    got = apply(text.clean_author_name, [raw])[0]
    assert (got.value, got.low_confidence) == (value, doubtful)


def test_headline_company(apply):
    given = ["Baker at Oak & Sons ", "Lead @ Fern", "Attic cleaner", "cook AT  home at last", "mail me@x.org", None, "chief at"]
    assert apply(text.company_from_headline, given) == ["Oak & Sons", "Fern", None, "home at last", None, None, None]


def test_content_tokens(apply):
    given = ["the art of tea", "of the", "", "UX-UI designer", "café owner"]
    assert apply(text.content_tokens, given) == [
        ["art", "tea"], ["of", "the"], [], ["ux", "ui", "designer"], ["caf", "owner"],
    ]


def test_split_named_body(apply):
    def split(c):
        return text.split_named_body(c, "LinkedIn")

    got = apply(split, ["Eva Lund on LinkedIn: Hello\nyou", "plain", "x on LinkedIner", " on LinkedIn - ", "A on linkedin B on LinkedIn: c"])
    assert [(g.name, g.body) for g in got] == [
        ("Eva Lund", "Hello\nyou"), (None, None), (None, None), (None, None), ("A", "B on LinkedIn: c"),
    ]


def test_plausible_name(apply):
    assert apply(text.plausible_name, ["Ana", "a b c d e f g", "a b c d e f g h", "x" * 61, ""]) == [True, True, False, False, False]


def test_has_content_agrees_with_cleaning(apply):
    given = ["", " \t\n", "\x00\x07", "\xa0　", "a", " \x1f.", "​", None]
    assert apply(text.has_content, given) == [v != "" for v in apply(text.tidy, given)]


def test_text_crosses_to_python_once(spark):
    df = spark.createDataFrame([("a &amp; b",), ("&nbsp;",)], "t STRING").select(text.clean_text(F.col("t")).alias("t"))
    plan = df.where("t <> ''")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert df.where("t <> ''").count() == 1


def test_very_long_names_are_handled(apply):
    assert apply(text.clean_author_name, ["Ann " + "a1 " * 20000])[0].value == "Ann"

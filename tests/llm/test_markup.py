import pytest

from loreline.llm.markup import clean_text, has_markup, marked_fields, render


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        (r"\href{u}{the map} of \textcolor{red}{danger}", "the map of danger"),
        (r"C:\Users\bob\notes here", r"C:\Users\bob\notes here"),
        ("if a<b and c>d then", "if a<b and c>d then"),
        ("{{quote|text=He said hi}}", "He said hi"),
        ("![the old map](m.png) hangs here", "the old map hangs here"),
        ("<textarea>typed</textarea>", "typed"),
        ("see note_ here", "see note_ here"),
        ("<p style='a'>yes</p><div hidden>no</div>", "yes"),
        (r"\label{x}Text \emph{y}", "Text y"),
        ("[[Ann Lee|Ann]] met '''Bob'''.", "Ann met Bob."),
        ("== Head ==\n* one\n* two", "Head\n\n- one\n- two"),
        ("# Head\n\nText with `code` and $x^2$.", "Head\n\nText with code and x^2."),
        ("<ol><li>a<li>b</ol>", "1. a\n2. b"),
        ("a &amp; b &lt;c&gt;", "a & b <c>"),
    ],
)
def test_what_is_visible_is_shown(text, shown):
    assert render(text)[0] == shown


@pytest.mark.parametrize("n", [3, 58, 62, 400])
def test_boxes_of_any_length(n):
    text = "{{Infobox\n" + "\n".join(f"| f{i} = v{i}" for i in range(n)) + "\n}}\nAfter."
    out = render(text)[0]
    assert all(f"f{i}: v{i}" in out for i in range(n)) and out.endswith("After.") and "{{" not in out and "|" not in out


def test_emphasis_of_any_length_and_unclosed_templates():
    long = "word " * 200 + "end"
    assert render(f"*{long}*")[0] == long
    assert render("{{open\ntext\n\nmore {{open\ntext")[0].count("text") == 2


def test_cells_that_span_columns_keep_the_rest_aligned():
    html = "<table><tr><td colspan=2>a</td><td>b</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"
    wiki = '{|\n| colspan="2" | a || b\n|-\n| 1 || 2 || 3\n|}'
    assert render(html)[0] == render(wiki)[0] == "a     b\n1  2  3"


@pytest.mark.parametrize("text", ["Plain text.", "5 * 3 = 15 and 2 < 4", "He said: [sic] (really)", "A_B and #1 - ok", "$5 or $6", "", None, "  "])
def test_ordinary_signs_are_no_markup(text):
    assert not has_markup(text)


def test_fields_with_nulls_repeats_long_texts_and_other_columns(spark):
    long = "<b>x</b> " * 20_000
    rows = [("a", 1, "t", "<b>x</b>", 0), ("a", 1, "t", "<b>x</b>", 0), ("a", 2, "t", None, 0), ("a", 3, "t", "", 0), ("a", 4, "t", long, 0), (None, None, "t", "[[x]]", 0)]
    df = spark.createDataFrame(rows, "origin string, rec_id long, field string, text string, marks int")
    assert sorted(map(str, map(tuple, marked_fields(df).collect()))) == ["('a', 1, 't')", "('a', 4, 't')", "(None, None, 't')"]
    out = {r.rec_id: r.readable for r in clean_text(df.drop("marks"), "text").collect()}
    assert out[2] is None and out[3] == "" and out[4] == ("x " * 20_000).strip()
    assert marked_fields(df.limit(0)).count() == 0

import pytest

from loreline.llm.markup import render


@pytest.mark.parametrize(
    ("text", "shown"),
    [
        ("Before {| the rest of the line stays.", ["Before", "the rest of the line stays."]),
        ('{| class="wikitable" | a || b |}\n\nAfter.', ["a", "b", "After."]),
        ("{| class=\"x\"\nBefore the first cell.\n|-\n| a || b\n|}", ["Before the first cell.", "a", "b"]),
        ("{| class=\"x\"\n| a || b\n\nAn unclosed table ends here.\n\n== Head ==\nText.", ["a", "b", "An unclosed table ends here.", "Head", "Text."]),
        ("{|\n| a\n|} after the end", ["a", "after the end"]),
        ("{| shown\n| a\n|}", ["shown", "a"]),
    ],
)
def test_broken_and_one_line_tables_keep_their_text(text, shown):
    out, hits = render(text)
    assert hits > 0
    at = -1
    for part in shown:
        at = out.find(part, at + 1)
        assert at >= 0, (part, out)
    assert not any(x in out for x in ("{|", "|}", "class=", "=="))


def test_an_unclosed_table_goes_on_over_blank_lines_only_to_rows():
    assert render("{|\n| a || b\n\n| c || d\n\nText.")[0] == "a  b  c  d\n\nText."


def test_a_whole_table_is_as_before():
    assert render("{| class=\"wikitable\"\n|+ Cap\n! A !! B\n|-\n| 1 || 2\n|}\nAfter.")[0] == "Cap\nA  B\n1  2\n\nAfter."

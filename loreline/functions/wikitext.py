"""Scalar expressions over wiki markup. All are built-in expressions; null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions.dialect import BLANK, UPPER, WORD, blank_to_null, split_lines, strip

# What must be equal for the same results.
LINK = r"\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]"
SHOWN_LINK = r"\[\[(?:[^\]|]+\|)?([^\]|]+)\]\]"
ARC = r"\{\{\s*([A-Za-z0-9 '’\-]+ Arc)\s*\}\}"
ANNOTATION = r"(?:'')?\(([^)]*)\)(?:'')?"
NOT_ARTICLES = ("file", "image", "category", "template", "wikipedia", "w")
NOT_PROSE = rf"(?iuU)^{BLANK}*(?:=+.*=+|'''(?:(?!''').)+'''|\[\[(?:File|Image):.*\]\]){BLANK}*$"
ABSENT_MARKS = "cover|flashback|mentioned|dream"
COMPLETE_FROM = 300
UNKNOWN_ARC = "Unknown"


def section(text: Column, heading: str) -> Column:
    """Text under the first heading of that name, up to the next of its level or above; ''
    where there is none. Case, blanks and byte-order marks in the heading don't matter."""
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in heading)
    at = rf"(?imdU)^(=+)[\s\x{{FEFF}}]*{quoted}\s*=+[ \t]*$([\s\S]*)"
    level = F.length(F.regexp_extract(text, at, 1))
    rest = F.regexp_extract(text, at, 2)
    stop = F.concat(F.lit("(?md)^={1,"), F.greatest(level, F.lit(1)).cast("string"), F.lit("}[^=]"))
    return strip(F.split(rest, stop, 2)[0])


def page_title(title: Column) -> Column:
    """A title as the wiki reads it: '_' is a blank, the first letter a capital."""
    t = strip(F.replace(title, F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1_000_000))


def canonical_name(target: Column) -> Column:
    """The page a link leads to, without section and subpage; null outside articles."""
    prefix = F.lower(strip(F.substring_index(F.regexp_replace(target, "^:+", ""), ":", 1)))
    outside = target.contains(":") & prefix.isin(*NOT_ARTICLES)
    title = page_title(F.substring_index(F.substring_index(target, "#", 1), "/", 1))
    return F.when(~outside, blank_to_null(title))


def links(text: Column) -> Column:
    """array<struct<target, label>> of all links; label '' where a link has none."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)).alias("target"), F.regexp_extract_all(text, F.lit(LINK), F.lit(2)).alias("label"))


def clean_alias(label: Column, own: Column, name: Column, common: Column | None = None) -> Column:
    """A link's text as an alias of ``name``, null where it isn't one.

    common: array of lower-case words an alias must not begin with.
    """
    t = strip(F.replace(F.regexp_replace(label, "'{2,}", ""), F.lit("’"), F.lit("'")))
    quoted = t.rlike(r'(?s)^".*"$|^“.*”$')
    t = F.when(quoted, strip(F.regexp_replace(t, r'(?s)^["“](.*)["”]$', "$1"))).otherwise(t)
    t = strip(F.regexp_replace(F.regexp_replace(t, "[,;:]+$", ""), r"(?:'s|(?<=s)')$", ""))
    first = F.lower(F.regexp_replace(F.split(t, rf"(?U){BLANK}+", 2)[0], r"^[.,;:]+|[.,;:]+$", ""))
    good = own & (t != "") & t.rlike("^" + UPPER) & (t != name)
    if common is not None:
        good = good & ~F.array_contains(common, first)
    return F.when(good, t)


def scenes(summary: Column) -> Column:
    """Paragraphs of prose, without headings, lone bold lines and lone images."""
    paragraphs = F.split(summary, rf"(?U)\n{BLANK}*\n", -1)
    prose = F.transform(paragraphs, lambda p: strip(F.array_join(F.filter(split_lines(p), lambda x: ~x.rlike(NOT_PROSE)), "\n")))
    return F.filter(prose, lambda p: p != "")


def strip_markup(text: Column) -> Column:
    """Readable text of wiki markup, names of links kept. The order of the steps matters."""
    t = F.regexp_replace(text, SHOWN_LINK, "$1")
    t = F.regexp_replace(t, rf"(?mdU)^=+{BLANK}*(.*?){BLANK}*=+$", "$1")
    t = F.regexp_replace(t, r"\{\{[^}]*\}\}", "")
    t = F.regexp_replace(t, "'''?", "")
    t = F.regexp_replace(t, r"(?s)<ref[^>]*>.*?</ref>", "")
    t = F.regexp_replace(t, "<[^>]+>", "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def notes(text: Column) -> Column:
    """Bullets of the chapter notes, without markup."""
    rows = F.regexp_extract_all(section(text, "Chapter Notes"), F.lit(rf"(?mdU)^\*+{BLANK}*(.+)$"), F.lit(1))
    return F.transform(rows, strip_markup)


def infobox_field(text: Column, field: str) -> Column:
    """Value of a field of the page's box, null where it is missing."""
    pattern = rf"(?U)\|\s*{field}\s*=\s*([^\n|}}]+)"
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))


def arc(text: Column) -> Column:
    """The first arc template of the page, else null."""
    return blank_to_null(F.regexp_extract(text, "(?U)" + ARC, 1))


def annotations(rest: Column) -> Column:
    return F.transform(F.regexp_extract_all(rest, F.lit(ANNOTATION), F.lit(1)), lambda x: F.lower(strip(x)))


def on_panel(notes_of: Column) -> Column:
    return ~F.exists(notes_of, lambda a: a.rlike(ABSENT_MARKS))


def is_complete(long_summary: Column) -> Column:
    return F.length(long_summary) >= COMPLETE_FROM


def dataset_names(raw: Column) -> tuple[Column, Column]:
    """(main names, epithets) of a data set's name: 'A (b) [C]' is 'A (b)' and 'A', and 'C'."""
    name = strip(raw)
    bracket = rf"(?U){BLANK}*\[([^\]]*)\]{BLANK}*$"
    epithet = F.when(name.rlike(bracket), strip(F.regexp_extract(name, bracket, 1)))
    name = F.when(name.rlike(bracket), strip(F.regexp_replace(name, bracket, ""))).otherwise(name)
    bare = strip(F.regexp_replace(name, rf"(?U){BLANK}*\([^)]*\){BLANK}*$", ""))
    return F.filter(F.array_distinct(F.array(name, bare)), lambda x: x != ""), F.filter(F.array(epithet), lambda x: x.isNotNull() & (x != ""))


def name_tokens(name: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(name), F.lit(WORD + "+"), F.lit(0)))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(strip(text), rf"(?U){BLANK}+", -1), lambda x: x != ""))

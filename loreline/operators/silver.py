"""Chapters out of bronze pages, their Markdown form, and reading that form again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreline.functions import wikitext as w
from loreline.functions.chartable import parse_characters
from loreline.functions.dialect import split_lines, strip

# Fixed values of the Markdown form.
NO_TEXT, NO_NOTES, LICENCE = "_(absent)_", "_(absentes)_", "CC BY-SA"
PAGE_URL = "https://wiki.example/wiki/Chapter_"
ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
SECTIONS = ("Short Summary", "Long Summary", "Chapter Notes")


def upsert_bronze(lines: DataFrame, order: str = "line_no") -> DataFrame:
    """The last written line of each number. Lines without a number are left out."""
    rest = [c for c in lines.columns if c not in ("number", order)]
    last = lines.where("number IS NOT NULL").groupBy("number").agg(F.max_by(F.struct(*rest, order), order).alias("r"))
    return last.select("number", *(f"r.{c}" for c in (*rest, order)))


def parse_chapters(bronze: DataFrame) -> DataFrame:
    """One chapter per bronze row (number, revid, timestamp, wikitext)."""
    t = F.col("wikitext")
    parts = bronze.select(
        "number", "revid", "timestamp", "wikitext",
        w.strip_markup(w.section(t, "Long Summary")).alias("long_summary"))
    return parts.select(
        "number", w.infobox_field(t, "title").alias("title"), w.infobox_field(t, "jname").alias("jname"), w.arc(t).alias("arc"),
        F.col("revid").alias("revision_id"), F.col("timestamp").alias("revised_at"),
        parse_characters(w.section(t, "Characters")).alias("characters"), w.notes(t).alias("notes"),
        w.strip_markup(w.section(t, "Short Summary")).alias("short_summary"), "long_summary",
        w.is_complete(F.col("long_summary")).alias("complete"))


def incremental_skip(bronze: DataFrame, state: DataFrame) -> DataFrame:
    """Rows whose number was not handled completely in the same revision."""
    done = state.where("complete").select("number", "revid").distinct()
    return bronze.join(done, ["number", "revid"], "left_anti")


def yaml_escape(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def render_markdown(page_url: str = PAGE_URL) -> Column:
    """The Markdown file of a chapter row, with YAML front matter."""

    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("string")

    people = F.transform("characters", lambda c: F.concat_ws(
        "\n", F.concat(F.lit("  - name: "), yaml_escape(c["name"])), F.concat(F.lit("    faction: "), yaml_escape(F.coalesce(c["faction"], F.lit("")))),
        F.concat(F.lit("    on_panel: "), flag(c["on_panel"]))))
    number = F.col("number").cast("string")
    filled = lambda name: F.when(text(name) == "", NO_TEXT).otherwise(text(name))
    bullets = F.array_join(F.transform(F.filter("notes", lambda x: x.isNotNull()), lambda n: F.concat(F.lit("- "), n)), "\n")
    head = F.regexp_replace(F.concat(F.lit("# Chapter "), number, F.lit(" — "), text("title")), "[ —]+$", "")
    lines = [
        F.lit("---"), F.concat(F.lit("chapter: "), number), F.concat(F.lit("title: "), yaml_escape(text("title"))), F.concat(F.lit("jname: "), yaml_escape(text("jname"))),
        F.concat(F.lit("arc: "), yaml_escape(text("arc"))), F.concat(F.lit("revision_id: "), F.coalesce(F.col("revision_id").cast("string"), F.lit("None"))),
        F.concat(F.lit("revised_at: "), yaml_escape(text("revised_at"))), F.concat(F.lit("complete: "), flag(F.col("complete"))),
        F.concat(F.lit("character_count: "), F.greatest(F.size("characters"), F.lit(0)).cast("string")), F.lit("characters:"),
        F.when(F.size("characters") > 0, F.array_join(people, "\n")), F.concat(F.lit(f"source: {page_url}"), number), F.lit(f"license: {LICENCE}"), F.lit("---"), F.lit(""), head, F.lit(""),
        F.lit("## Short Summary"), F.lit(""), filled("short_summary"), F.lit(""), F.lit("## Long Summary"), F.lit(""), filled("long_summary"), F.lit(""),
        F.lit("## Chapter Notes"), F.lit(""), F.when(F.size("notes") > 0, bullets).otherwise(NO_NOTES),
    ]
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n"))


# -- reading the Markdown form ----------------------------------------------------------------


def unquote(c: Column) -> Column:
    t = strip(c)
    return F.when(t.rlike(r'(?s)^".*"$') & (F.length(t) >= 2), F.substring(t, 2, 1_000_000).substr(F.lit(1), F.length(t) - 2)).otherwise(t)


def front_matter_value(matter: Column, field: str) -> Column:
    """Value of a top-level field, without quotes; null where the line is missing."""
    pattern = rf"(?md)^{field}:[ \t]*(.*)$"
    return F.when(matter.rlike(pattern), unquote(F.regexp_extract(matter, pattern, 1)))


def split_front_matter(text: Column) -> tuple[Column, Column]:
    """(header, body) cut at the first two '---'; null where the text doesn't begin so."""
    parts = F.split(text, "---", 3)
    good = text.startswith("---") & (F.size(parts) == 3)
    return F.when(good, parts[1]), F.when(good, parts[2])


def scalar(header: Column, key: str) -> Column:
    pattern = rf"(?md)^{key}: (.+)$"
    return F.when(header.rlike(pattern), F.regexp_replace(strip(F.regexp_extract(header, pattern, 1)), '^"+|"+$', ""))


def sections_map(body: Column) -> Column:
    """map of '## title' to the text under it; of a title that occurs again the last holds."""
    titles = F.transform(F.regexp_extract_all(body, F.lit(r"(?md)^## (.+)$"), F.lit(1)), strip)
    texts = F.transform(F.slice(F.split(body, r"(?md)^## .+$", -1), 2, 1_000_000), strip)
    pairs = F.arrays_zip(titles.alias("k"), texts.alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


# -- checks -------------------------------------------------------------------------------------


def _errors(*checks: tuple[Column, Column]) -> Column:
    found = F.array(*(F.when(F.coalesce(bad, F.lit(True)), message) for bad, message in checks))
    return F.filter(found, lambda x: x.isNotNull())


def _type_name(v: Column) -> Column:
    """The type of a JSON value by the name messages give it; null where there is none."""
    kind = F.schema_of_variant(v)
    whole = kind.startswith("DECIMAL") & ~F.to_json(v).rlike("[.eE]")
    return (
        F.when(kind == "STRING", "str").when((kind == "BIGINT") | whole, "int").when(kind == "BOOLEAN", "bool").when(kind == "VOID", "NoneType")
        .when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "dict").when(kind.isNotNull(), "float"))


def validate_bronze(lines: DataFrame) -> DataFrame:
    """(line_no, at, error) of JSON lines (line_no, value), in the order of the checks.

    A line that is no JSON counts as text. Whole numbers of any size are whole numbers.
    """
    rows = lines.select("line_no", F.try_parse_json("value").alias("v"))

    def sub(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "variant")

    names = ("number", "revid", "wikitext", "timestamp")
    rows = rows.select("line_no", "v", _type_name(F.col("v")).alias("kind"), *(_type_name(sub(n)).alias(f"t_{n}") for n in names))

    def said(*message: Column | str) -> Column:
        return F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), *(m if isinstance(m, Column) else F.lit(m) for m in message))

    def text(name: str) -> Column:
        return F.try_variant_get("v", f"$.{name}", "string")

    is_object = F.coalesce(F.col("kind") == "dict", F.lit(False))
    checks: list[tuple[Column, Column]] = [(~is_object, said("expected a JSON object, got ", F.coalesce("kind", F.lit("text"))))]
    for name, wanted in (("number", "int"), ("revid", "int"), ("wikitext", "str")):
        got = F.col(f"t_{name}")
        checks.append((is_object & got.isNull(), said(f"missing field '{name}'")))
        checks.append((is_object & (got != wanted), said(f"field '{name}' should be {wanted}, got ", got)))
    low = F.when(F.col("t_number") == "int", text("number").startswith("-") | (text("number") == "0")).when(F.col("t_number") == "bool", text("number") == "false")
    checks.append((is_object & low, said("field 'number' should be positive, got ", F.when(F.col("t_number") == "bool", "False").otherwise(text("number")))))
    checks.append((is_object & (F.col("t_wikitext") == "str") & (strip(text("wikitext")) == ""), said("field 'wikitext' is empty")))
    checks.append((is_object & F.col("t_timestamp").isNull(), said("missing field 'timestamp'")))
    iso = F.coalesce((F.col("t_timestamp") == "str") & text("timestamp").rlike(ISO), F.lit(False))
    shown = F.when(F.col("t_timestamp") == "str", F.concat(F.lit("'"), text("timestamp"), F.lit("'"))).when(F.col("t_timestamp") == "NoneType", "None").otherwise(F.to_json(sub("timestamp")))
    checks.append((is_object & F.col("t_timestamp").isNotNull() & ~iso, said("field 'timestamp' is not ISO-8601 UTC, got ", shown)))
    found = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(False)), message) for bad, message in checks)), lambda x: x.isNotNull())
    return rows.select("line_no", F.posexplode(found).alias("at", "error"))


def validate_rows(bronze: DataFrame) -> DataFrame:
    """(line_no, error): the bronze checks on typed rows, where a mistyped value is null."""
    found = F.array(
        F.when(F.col("number").isNull(), "missing field 'number'"), F.when(F.col("revid").isNull(), "missing field 'revid'"),
        F.when(F.col("wikitext").isNull(), "missing field 'wikitext'"), F.when(F.col("number") <= 0, "field 'number' should be positive"),
        F.when(strip(F.col("wikitext")) == "", "field 'wikitext' is empty"), F.when(F.col("timestamp").isNull(), "missing field 'timestamp'"),
        F.when(~F.col("timestamp").rlike(ISO), "field 'timestamp' is not ISO-8601 UTC"))
    return bronze.select("line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("error"))


def bronze_duplicates(bronze: DataFrame) -> DataFrame:
    return bronze.where("number IS NOT NULL").groupBy("number").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")


def validate_silver(files: DataFrame) -> DataFrame:
    """(file_name, error) of Markdown files (file_name, value)."""
    block = r"(?s)^---\n(.*?)\n---\n"
    matter = F.regexp_extract("value", block, 1)
    body = F.regexp_replace("value", block, "")
    rows = files.select("file_name", F.col("value").rlike(block).alias("ok"), matter.alias("m"), body.alias("b"))
    m, b = F.col("m"), F.col("b")
    names = F.regexp_extract_all(m, F.lit(r"(?md)^\s*-\s*name:[ \t]*(.*)$"), F.lit(1))
    listed = m.rlike(r"(?md)^characters:\s*$")
    checks = [(~m.rlike(r"(?md)^chapter:\s*\d+\s*$"), F.lit("front-matter missing numeric 'chapter:' field"))]
    checks += [(F.coalesce(front_matter_value(m, x), F.lit("")) == "", F.lit(f"front-matter missing non-empty '{x}:' field")) for x in ("title", "arc")]
    checks.append((~listed, F.lit("front-matter missing 'characters:' list")))
    checks.append((listed & ~F.exists(names, lambda n: unquote(n) != ""), F.lit("'characters:' list has no entries with a non-empty 'name'")))
    checks += [(~b.rlike(rf"(?md)^##\s*{x}\s*$"), F.lit(f"missing '## {x}' section")) for x in SECTIONS]
    found = F.when(F.col("ok"), _errors(*checks)).otherwise(F.array(F.lit("missing YAML front-matter (no leading '---' ... '---' block)")))
    return rows.select("file_name", F.explode(found).alias("problem")).select("file_name", F.concat("file_name", F.lit(": "), "problem").alias("error"))


def check_files(files: DataFrame) -> DataFrame:
    """(file_name, number, problems, words) of Markdown files named chapter_0000.md, from 10000 on with more digits."""
    header, body = split_front_matter(F.col("value"))
    rows = files.select("file_name", F.regexp_extract("file_name", r"chapter_(\d{4,})\.md", 1).try_cast("int").alias("number"), header.alias("h"), sections_map(body).alias("s"))
    h = F.col("h")
    listed = F.size(F.regexp_extract_all(h, F.lit(r"(?md)^  - name: "), F.lit(0)))
    declared = scalar(h, "character_count")
    words = w.word_count(F.coalesce(F.try_element_at("s", F.lit("Long Summary")), F.lit("")))
    checks = [
        (~scalar(h, "chapter").eqNullSafe(F.col("number").cast("string")), F.lit("chapter is not that of the file name")),
        (~scalar(h, "complete").eqNullSafe(F.lit("true")), F.lit("complete is not true")),
        (F.coalesce(scalar(h, "revision_id"), F.lit("")) == "", F.lit("revision_id missing")),
        (~declared.try_cast("int").eqNullSafe(listed), F.lit("character_count is not the number listed")),
    ]
    checks += [(~F.map_contains_key("s", F.lit(x)), F.lit(f"section {x} missing")) for x in SECTIONS]
    checks.append((words == 0, F.lit("Long Summary empty")))
    problems = F.when(h.isNull(), F.array(F.lit("no front-matter"))).otherwise(_errors(*checks))
    return rows.select("file_name", "number", problems.alias("problems"), words.alias("words"))


def missing_chapters(numbers: DataFrame, expected: int) -> DataFrame:
    spark = numbers.sparkSession
    return spark.range(1, expected + 1).select(F.col("id").cast("int").alias("number")).join(numbers.select("number"), "number", "left_anti")


def word_stats(words: DataFrame) -> DataFrame:
    """(least, median, most) of ``words``; of an even number of values the upper median.

    The rank is found with a window over counts by value, so no group is collected.
    """
    counts = words.where("words IS NOT NULL").groupBy("words").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("words").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return ranked.agg(F.min("words").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("words"))).alias("median"), F.max("words").alias("most"))


def gate(checked: DataFrame, expected: int) -> DataFrame:
    """One row (files, missing, failing, ok): ok if every expected chapter is there and good."""
    none = missing_chapters(checked, expected).select(F.lit(0).alias("file"), F.lit(0).alias("bad"), F.lit(1).alias("gone"))
    rows = checked.select(F.lit(1).alias("file"), (F.size("problems") > 0).cast("int").alias("bad"), F.lit(0).alias("gone")).unionByName(none)
    counts = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("file", "files"), ("gone", "missing"), ("bad", "failing"))))
    return counts.select("files", "missing", "failing", ((F.col("files") == expected) & (F.col("missing") == 0) & (F.col("failing") == 0)).alias("ok"))

from pyspark.sql import functions as F

from loreline.operators import silver as s

SILVER = (
    "number int, title string, jname string, arc string, revision_id long, revised_at string, "
    "characters array<struct<name:string,faction:string,on_panel:boolean,annotations:array<string>,label:string>>, "
    "notes array<string>, short_summary string, long_summary string, complete boolean"
)


def row(number, **given):
    base = {"number": number, "title": "T", "jname": "J", "arc": "A Arc", "revision_id": 7, "revised_at": "2020-01-01T00:00:00Z", "characters": [("Ann", None, True, [], None)], "notes": ["n"], "short_summary": "Short.", "long_summary": "Long text.", "complete": True}
    return tuple((base | given).values())


def test_chapter_numbers_of_any_length_are_read_from_the_file_name(spark):
    rows = spark.createDataFrame([row(7), row(9999), row(10000), row(123456)], SILVER)
    files = rows.select(F.format_string("chapter_%04d.md", "number").alias("file_name"), s.render_markdown().alias("value"))
    got = {r.file_name: (r.number, r.problems) for r in s.check_files(files).collect()}
    assert got == {"chapter_0007.md": (7, []), "chapter_9999.md": (9999, []), "chapter_10000.md": (10000, []), "chapter_123456.md": (123456, [])}


def test_a_file_name_without_a_number_is_a_problem_and_no_error(spark):
    rows = spark.createDataFrame([row(7)], SILVER)
    files = rows.select(F.lit("chapter_x.md").alias("file_name"), s.render_markdown().alias("value"))
    assert [(r.number, r.problems) for r in s.check_files(files).collect()] == [(None, ["chapter is not that of the file name"])]

"""The characters table of a page: group headers and, under them, characters with notes.

A header holds for the lines after it, so the lines are folded in order. The fold is an
expression over the array of lines: no line leaves its row and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loreline.functions.dialect import blank_to_null, split_lines, strip
from loreline.functions.wikitext import annotations, on_panel

_GROUP = r"^;\s*\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]"
_ENTRY = r"(?s)^\*\s*\[\[([^\]|]+?)(?:\|([^\]]*))?\]\]\s*(.*)$"
CHARACTER = "struct<name:string,faction:string,on_panel:boolean,annotations:array<string>,label:string>"


def _lines(section: Column) -> Column:
    return F.transform(split_lines(section), strip)


def parse_characters(section: Column) -> Column:
    """array of characters in order; of a name that occurs again the first line holds.

    A header that is empty without its brackets keeps the group before it.
    """
    empty = F.struct(F.lit(None).cast("string").alias("group"), F.array().cast(f"array<{CHARACTER}>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        linked = F.regexp_extract(line, _GROUP, 1)
        bare = strip(F.regexp_replace(line, r"[\[\];']", ""))
        head = line.startswith(";")
        group = F.when(head & (linked != ""), strip(linked)).when(head, F.coalesce(blank_to_null(bare), acc["group"])).otherwise(acc["group"])
        name = strip(F.regexp_extract(line, _ENTRY, 1))
        marks = annotations(F.regexp_extract(line, _ENTRY, 3))
        entry = F.struct(
            name.alias("name"), acc["group"].alias("faction"), on_panel(marks).alias("on_panel"), marks.alias("annotations"),
            F.when(F.regexp_extract(line, _ENTRY, 2) != "", strip(F.regexp_extract(line, _ENTRY, 2))).alias("label"))
        known = F.exists(acc["out"], lambda x: x["name"] == name)
        add = ~head & line.rlike(_ENTRY) & ~known
        return F.struct(group.alias("group"), F.when(add, F.concat(acc["out"], F.array(entry.cast(CHARACTER)))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_lines(section), empty, step, lambda acc: acc["out"])


def parse_groups(section: Column) -> Column:
    """Linked headers in order, each once."""
    names = F.transform(_lines(section), lambda x: strip(F.regexp_extract(x, _GROUP, 1)))
    return F.array_distinct(F.filter(names, lambda x: x != ""))

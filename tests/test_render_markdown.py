from loreline.plans.queries_pages import QUERIES
from test_check_files import SILVER, row

FULL = """---
chapter: 7
title: "T"
jname: "J"
arc: "A Arc"
revision_id: 7
revised_at: "2020-01-01T00:00:00Z"
complete: true
character_count: 1
characters:
  - name: "Ann"
    faction: ""
    on_panel: true
source: https://wiki.example/wiki/Chapter_7
license: CC BY-SA
---

# Chapter 7 — T

## Short Summary

Short.

## Long Summary

First.

source: second paragraph.

## Chapter Notes

- one
- two
"""
BARE = """---
chapter: 8
title: ""
jname: ""
arc: ""
revision_id: None
revised_at: ""
complete: false
character_count: 0
characters:
source: https://wiki.example/wiki/Chapter_8
license: CC BY-SA
---

# Chapter 8

## Short Summary

_(absent)_

## Long Summary

_(absent)_

## Chapter Notes

_(absentes)_
"""


def test_the_whole_file_comes_out(spark, tables):
    full = row(7, long_summary="First.\n\nsource: second paragraph.", notes=["one", None, "two"])
    bare = row(8, **dict.fromkeys(("title", "jname", "arc", "revision_id", "revised_at", "characters", "notes", "short_summary", "long_summary", "complete")))
    d = tables(silver=([full, full, bare], SILVER))
    got = {r.file_name: r for r in QUERIES["render_markdown"](spark, d).collect()}
    assert {k: r.value for k, r in got.items()} == {"chapter_0007.md": FULL, "chapter_0008.md": BARE}
    assert all(r.value.startswith(r.head + "\nsource: https://") for r in got.values())

"""Scans, sinks, ingestion and the stream, through temporary folders."""

import json

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from loreline.plans import ingestion
from loreline.sources import files
from loreline.sources.versioned import VersionedTable
from loreline.sources.wiki_api import scan_api_categories, scan_api_pages
from loreline.streaming.bronze_stream import stream_bronze

PAGE = "{{Infobox\n| title = Tale %d\n| jname = J\n}}\n==Short Summary==\nShort.\n==Long Summary==\n%s\n==Quick References==\n===Chapter Notes===\n*A note.\n===Characters===\n*[[Ann Lee|Ann]]\n==Site Navigation==\n{{Harbor Arc}}\n"
LONG = "[[Ann Lee|Ann]] sails from [[Grey Harbor]] at dawn. " * 12


def wiki(pages, calls):
    """An API of ``pages``: number -> [(revid, text), ...], of which each call takes the next."""

    def get(params):
        calls.append(params["titles"])
        out = []
        for title in params["titles"].split("|"):
            n = int(title.removeprefix("Chapter "))
            versions = pages.get(n)
            if not versions:
                out.append({"title": title, "missing": True})
                continue
            revid, text = versions[0] if len(versions) == 1 else versions.pop(0)
            out.append({"title": title, "revisions": [{"revid": revid, "timestamp": "2026-01-01T00:00:00Z", "slots": {"main": {"content": text}}}]})
        return {"query": {"pages": out}}

    return get


def test_ingestion_writes_all_layers_and_goes_on_from_them(spark, tmp_path):
    calls, data, wait = [], str(tmp_path), []
    pages = {1: [(10, PAGE % (1, LONG))], 2: [(20, PAGE % (2, "Stub.")), (21, PAGE % (2, LONG))]}
    run = lambda inc: ingestion.run(spark, wiki(pages, calls), 60, inc, data, delay=0, sleep=wait.append)
    assert run(False) == 2
    assert [c.count("|") + 1 for c in calls] == [50, 10, 1]  # two requests, then the stub again
    bronze = {r.number: r.revid for r in files.scan_bronze(spark, f"{data}/bronze/chapters.jsonl").collect()}
    assert bronze == {1: 10, 2: 21}
    assert sorted(map(tuple, files.scan_state(spark, f"{data}/state.json").collect())) == [(1, 10, True), (2, 21, True)]
    assert json.loads((tmp_path / "state.json").read_text())["1"] == {"revid": 10, "complete": True}
    names = sorted(p.name for p in (tmp_path / "silver").glob("chapter_*"))
    assert names == ["chapter_0001.md", "chapter_0002.md"]
    assert ingestion.check_silver(spark, f"{data}/silver", 2) == 0 and ingestion.check_silver(spark, f"{data}/silver", 3) == 1
    pages[1] = [(11, PAGE % (1, LONG + "More."))]
    assert run(True) == 1
    assert {r.number: r.revid for r in files.scan_bronze(spark, f"{data}/bronze/chapters.jsonl").collect()} == {1: 11, 2: 21}
    assert ingestion.rebuild_silver(spark, data) == 2


def test_bronze_keeps_the_last_line_of_a_number(spark, tmp_path):
    rows = [{"number": 1, "revid": 2, "timestamp": None, "wikitext": "a"}, {"number": 1, "revid": 1, "timestamp": "t", "wikitext": "b\n c"}]
    (tmp_path / "b.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\nnot json\n", encoding="utf-8")
    assert [(r.revid, r.wikitext) for r in files.scan_bronze(spark, str(tmp_path / "b.jsonl")).collect()] == [(1, "b\n c")]
    assert files.scan_bronze(spark, str(tmp_path / "none")).count() == 0 and files.scan_state(spark, str(tmp_path / "none")).count() == 0


def test_reference_files(spark, tmp_path):
    (tmp_path / "characters.json").write_text('[{"name": "Ann Lee [Red]", "status": "x"}]')
    (tmp_path / "islands.json").write_text('[{"name": "Grey Harbor", "location": 1}]')
    (tmp_path / "devil_fruits.json").write_text('[{"name": " Tofu no Mi", "english": "Tofu Fruit"}, {"name": "B"}]')
    (tmp_path / "concepts.txt").write_text("# comment\nDream\n\n Tide \n")
    (tmp_path / "common_words.txt").write_text("The\nthe\n# x\nA\n")
    for name, head in (("redirects", "redirect,canonical_name\n# c\nAnn L,Ann Lee\n"), ("disguises", "alias,canonical_name,revelation\nMask,Ann Lee,7\n"), ("type_overrides", "canonical_name,entity_type\nRock,Place\n")):
        (tmp_path / f"{name}.csv").write_text(head)
    (tmp_path / "wiki_categories.json").write_text('{"Ann Lee": ["Characters"], "Empty": []}')
    d = files.load_reference(spark, str(tmp_path))
    assert [r.name for r in d.concepts.collect()] == ["Dream", "Tide"] and d.common_words == ("a", "the")
    assert [tuple(r) for r in d.redirects.collect()] == [("Ann L", "Ann Lee")] and [tuple(r) for r in d.disguises.collect()] == [("Mask", "Ann Lee", 7)]
    assert {r.title: r.categories for r in d.categories.collect()} == {"Ann Lee": ["Characters"], "Empty": []}
    assert [r.english for r in d.fruits.orderBy("pos").collect()] == ["Tofu Fruit", None] and d.characters.columns == ["name"]


def test_sinks_read_back(spark, tmp_path):
    cats = spark.createDataFrame([("B", ["x"]), ("A", [])], "title string, categories array<string>")
    files.sink_category_cache(cats, str(tmp_path / "gold" / "cache.json"))
    assert {r.title: r.categories for r in files.scan_category_cache(spark, str(tmp_path / "gold" / "cache.json")).collect()} == {"A": [], "B": ["x"]}
    rows = spark.createDataFrame([('Red, "the"', "Ann", 2, 1, 3, None), ("É", "Bob", 5, 1, 3, None)], "alias string, canonical_name string, link_count int, first_chapter int, last_chapter int, revelation int")
    files.sink_candidates(rows, str(tmp_path / "c.csv"))
    text = (tmp_path / "c.csv").read_bytes()
    assert text == ('﻿alias,canonical_name,link_count,first_chapter,last_chapter,revelation\r\nÉ,Bob,5,1,3,\r\n"Red, ""the""",Ann,2,1,3,\r\n').encode()


def test_api_pages_retry_and_categories_follow_redirects(spark):
    tries, waits = [], []

    def flaky(params):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("down")
        return wiki({1: [(1, "x")]}, [])(params)

    assert scan_api_pages(spark, flaky, [1, 1, 2], 0, waits.append).count() == 1 and waits[:2] == [1, 2]
    with pytest.raises(OSError):
        scan_api_pages(spark, lambda p: (_ for _ in ()).throw(OSError()), [1], 0, waits.append)
    first = {"query": {"normalized": [{"from": "ann", "to": "Ann"}], "redirects": [{"from": "Ann", "to": "Ann Lee"}], "pages": [{"title": "Ann Lee", "categories": [{"title": "Category:Cooks"}]}]}, "continue": {"clcontinue": "x"}}
    second = {"query": {"pages": [{"title": "Ann Lee", "categories": [{"title": "Category:Humans"}]}, {"title": "Zed", "missing": True}]}}
    got = scan_api_categories(spark, lambda p: second if "clcontinue" in p else first, ["ann", "Zed"], waits.append)
    assert {r.title: r.categories for r in got.collect()} == {"ann": ["Cooks", "Humans"], "Zed": []}


def test_a_stream_with_a_new_checkpoint_is_read_and_a_repeated_batch_is_not(spark, tmp_path):
    schema = StructType([StructField("number", IntegerType()), StructField("revid", LongType()), StructField("timestamp", StringType()), StructField("wikitext", StringType())])
    table = VersionedTable(spark, f"file://{tmp_path}/t", schema)
    (tmp_path / "in").mkdir()

    def feed(name, *rows):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"number": n, "revid": r, "timestamp": "t", "wikitext": "w"}) + "\n" for n, r in rows))

    def run(check):
        stream_bronze(spark, f"file://{tmp_path}/in", table, f"file://{tmp_path}/{check}").awaitTermination()
        return {r.number: r.revid for r in table.read().collect()}

    feed("a.json", (1, 10), (1, 9), (2, 20))
    assert run("c1") == {1: 10, 2: 20}
    feed("b.json", (1, 8), (2, 21), (3, 30))
    assert run("c1") == {1: 10, 2: 21, 3: 30}
    feed("c.json", (4, 40))
    assert run("c2") == {1: 10, 2: 21, 3: 30, 4: 40}  # ids start at 0 again; nothing is skipped

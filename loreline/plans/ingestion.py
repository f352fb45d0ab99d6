"""Ingestion runs and command lines."""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.operators.silver import check_files, gate, incremental_skip, parse_chapters
from loreline.plans.extraction import Extraction, extract_entities
from loreline.session import materialise
from loreline.sources import files
from loreline.sources.wiki_api import http_get, scan_api_categories, scan_api_pages, update_category_cache

RETRIES, RETRY_DELAY = 2, 1.5  # fixed values


def ingest(bronze: DataFrame, state: DataFrame, fetched: DataFrame, incremental: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bronze, state, changed chapters) after the pages of a run came in."""
    new = incremental_skip(fetched, state) if incremental else fetched
    chapters = parse_chapters(new)
    merged = bronze.join(new.select("number"), "number", "left_anti").unionByName(new)
    left = chapters.select("number", F.col("revision_id").alias("revid"), "complete")
    kept = state.join(left.select("number"), "number", "left_anti").unionByName(left) if incremental else left
    return merged, kept, chapters


def run(spark: SparkSession, get: Callable, max_chapter: int, incremental: bool, data_dir: str, delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> int:
    """Fetch, parse, archive. Incomplete pages are asked for again, twice at most; bronze,
    silver and state are written at the end. Returns the number of changed chapters."""
    at = files.layer_paths(data_dir)
    path = f"{at['bronze']}/chapters.jsonl"
    bronze, state = files.scan_bronze(spark, path), files.scan_state(spark, at["state"])
    fetched = scan_api_pages(spark, get, range(1, max_chapter + 1), delay, sleep)
    for _ in range(RETRIES):
        stubs = [r.number for r in parse_chapters(incremental_skip(fetched, state) if incremental else fetched).where("NOT complete").select("number").collect()]
        if not stubs:
            break
        sleep(RETRY_DELAY)
        again = scan_api_pages(spark, get, stubs, 0, sleep)
        fetched = fetched.join(again.select("number"), "number", "left_anti").unionByName(again)
    merged, kept, chapters = (materialise(x, "ingest") for x in ingest(bronze, state, fetched, incremental))
    files.sink_silver(chapters, at["silver"])
    files.sink_bronze(merged, path)
    files.sink_state(kept, at["state"])
    return chapters.count()


def rebuild_silver(spark: SparkSession, data_dir: str) -> int:
    """Silver again from archived bronze; returns the number of chapters."""
    at = files.layer_paths(data_dir)
    bronze = files.scan_bronze(spark, f"{at['bronze']}/chapters.jsonl")
    files.sink_silver(parse_chapters(bronze), at["silver"])
    return bronze.count()


def entities_run(spark: SparkSession, data_dir: str, reference_dir: str, get: Callable | None = None) -> Extraction:
    """Extract, ask for unknown categories (with ``get``) and extract again, write gold."""
    at = files.layer_paths(data_dir)
    pages = materialise(files.scan_bronze(spark, f"{at['bronze']}/chapters.jsonl"), "bronze")
    out = extract_entities(pages, files.load_reference(spark, reference_dir))
    if get:
        cache = f"{reference_dir}/wiki_categories.json"
        unknown = out.types.where("entity_type = 'Unknown'").select(F.col("canonical_name").alias("name"))
        wanted = materialise(unknown.unionByName(out.pages_without_categories()).distinct(), "wanted")
        known = materialise(out.dimensions.categories, "categories")
        if update_category_cache(known, wanted, lambda t: scan_api_categories(spark, get, t), lambda c: files.sink_category_cache(c, cache)):
            out = extract_entities(pages, files.load_reference(spark, reference_dir))
    gold = f"{at['gold']}/entities"
    files.sink_registry(out.registry(), f"{gold}/registry.jsonl")
    files.sink_quality(out.quality(), f"{gold}/registry_quality.json")
    files.sink_candidates(out.disguise_candidates(), f"{gold}/disguise_candidates.csv")
    return out


def check_silver(spark: SparkSession, folder: str, expected: int) -> int:
    """Exit code 0 if all expected chapters are there and none has a problem, else 1."""
    return 0 if gate(check_files(files.scan_silver(spark, folder)), expected).first().ok else 1


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    sub = p.add_subparsers(dest="job", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("--api", required=True, help="address of the wiki's api.php")
    a.add_argument("--max-chapter", type=int, default=1193)
    a.add_argument("--incremental", action="store_true", help="only pages whose revision changed")
    a.add_argument("--delay", type=float, default=0.5, help="seconds between requests")
    a.add_argument("--data-dir", default="data")
    a.add_argument("--rebuild-silver", action="store_true", help="silver again from the archived bronze, without network")
    a = sub.add_parser("rebuild-silver")
    a.add_argument("--data-dir", default="data")
    a = sub.add_parser("entities")
    a.add_argument("--data-dir", default="data")
    a.add_argument("--reference-dir", default="reference")
    a.add_argument("--api", help="address of the wiki's api.php, to ask for unknown categories; without it nothing is fetched")
    a = sub.add_parser("check-silver")
    a.add_argument("--silver", default="data/silver")
    a.add_argument("--expected", type=int, default=1193)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("loreline").getOrCreate()
    if args.job == "ingest" and not args.rebuild_silver:
        print(run(spark, http_get(args.api), args.max_chapter, args.incremental, args.data_dir, args.delay))
    elif args.job in ("ingest", "rebuild-silver"):
        print(rebuild_silver(spark, args.data_dir))
    elif args.job == "entities":
        print(entities_run(spark, args.data_dir, args.reference_dir, http_get(args.api) if args.api else None).types.count())
    else:
        return check_silver(spark, args.silver, args.expected)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

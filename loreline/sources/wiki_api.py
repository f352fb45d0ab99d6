"""Pages and categories from a wiki's API. The transport is a parameter, ``get(params)``
giving the decoded answer, so everything else works and is tested without a network."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterable
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Get = Callable[[dict], dict]
BATCH, ATTEMPTS, TIMEOUT_S, HOPS = 50, 4, 45, 3  # fixed values


def batches(numbers: DataFrame, size: int = BATCH) -> DataFrame:
    """(batch, titles): chapter titles in requests of at most ``size``."""
    rows = numbers.select("number", F.floor((F.col("number") - 1) / size).alias("batch"))
    titles = F.transform(F.array_sort(F.collect_list("number")), lambda n: F.concat(F.lit("Chapter "), n.cast("string")))
    return rows.groupBy("batch").agg(titles.alias("titles"))


def http_get(api: str, agent: str = "loreline") -> Get:
    """A transport over HTTP for the API at that address."""

    def get(params: dict) -> dict:
        request = Request(f"{api}?{urlencode(params)}", headers={"User-Agent": agent})
        with urlopen(request, timeout=TIMEOUT_S) as answer:
            return json.load(answer)

    return get


def patiently(get: Get, params: dict, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Up to four attempts, waiting 1, 2 and 4 seconds between them."""
    for attempt in range(ATTEMPTS):
        try:
            return get(params)
        except Exception:
            if attempt == ATTEMPTS - 1:
                raise
            sleep(2**attempt)
    return {}


def scan_api_pages(spark: SparkSession, get: Get, numbers: Iterable[int], delay: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Bronze rows of the chapters that exist, asked for in batches."""
    rows, wanted = [], sorted(set(numbers))
    for i in range(0, len(wanted), BATCH):
        titles = "|".join(f"Chapter {n}" for n in wanted[i : i + BATCH])
        params = {"action": "query", "prop": "revisions|info", "rvprop": "content|timestamp|ids", "rvslots": "main", "format": "json", "formatversion": "2", "titles": titles}
        for page in patiently(get, params, sleep).get("query", {}).get("pages", []):
            if not page.get("missing"):
                r = page["revisions"][0]
                rows.append((int(page["title"].removeprefix("Chapter ")), r["revid"], r["timestamp"], r["slots"]["main"]["content"]))
        sleep(delay)
    return spark.createDataFrame(rows, "number int, revid long, timestamp string, wikitext string")


def scan_api_categories(spark: SparkSession, get: Get, titles: Iterable[str], sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(title, categories): visible categories of every title, those of its target for a
    redirect, none for a page that is missing. Pages of an answer are united by Spark and
    renames followed by joins, three hops at most."""
    wanted = sorted(set(titles))
    renamed, found = [], []
    for i in range(0, len(wanted), BATCH):
        params = {"action": "query", "prop": "categories", "clshow": "!hidden", "cllimit": "max", "redirects": "1", "format": "json", "formatversion": "2", "titles": "|".join(wanted[i : i + BATCH])}
        while True:
            answer = patiently(get, params, sleep)
            q = answer.get("query", {})
            renamed += [(s["from"], s["to"]) for s in q.get("normalized", []) + q.get("redirects", [])]
            found += [(p["title"], c["title"].split(":", 1)[1]) for p in q.get("pages", []) for c in p.get("categories", [])]
            if "continue" not in answer:
                break
            params = params | answer["continue"]
    hops = spark.createDataFrame(renamed, "page string, to string").distinct()
    out = spark.createDataFrame([(t, t) for t in wanted], "title string, page string")
    for _ in range(HOPS):
        out = out.join(hops, "page", "left").select("title", F.coalesce("to", "page").alias("page"))
    sets = spark.createDataFrame(found, "page string, category string").groupBy("page").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    return out.join(sets, "page", "left").select("title", F.coalesce("categories", F.array().cast("array<string>")).alias("categories"))


def update_category_cache(cache: DataFrame, titles: DataFrame, fetch: Callable[[list[str]], DataFrame], save: Callable[[DataFrame], None], size: int = BATCH) -> int:
    """Ask for the titles the cache lacks, in sorted batches, saving after each; returns
    how many were asked for. titles: (name)."""
    missing = titles.select(F.col("name").alias("title")).distinct().join(cache, "title", "left_anti")
    wanted = [r.title for r in missing.orderBy("title").toLocalIterator()]
    for i in range(0, len(wanted), size):
        cache = cache.unionByName(fetch(wanted[i : i + size]))
        save(cache)
    return len(wanted)

"""Texts that lost their end: at a field limit or in transfer.

Intact values are cut artificially to make positives; a hashed logistic regression over
closing characters, punctuation, the shape of the last paragraph and the distance to the
source's length limits tells cut from whole, and every record is scored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 20_000  # most records that training looks at; a documented bound, scoring covers all
BITS = 16
# What is put after a text that was cut on purpose to fit.
MARKS = r"\s*(?:\[…\]|\[\.\.\.\]|\((?:more|continued|suite|mehr|más|altro|mais)\)|\.\.\.|…+)\s*$"
_MARK = re.compile(MARKS)
_ENDS = ".!?。！？‽;"
_CLOSERS = "\"'”’»」』）)]}*_~`>＂"
_BULLET = re.compile(r"^\s*(?:[-*+•·#;:|!>]|\d{1,3}[.)]\s|\\item|</?\w|\{\||\|\}|```|\$\$|\\end\{|\\begin\{|\[\[)")
_LABEL = re.compile(r"^[^.!?。\n]{1,48}[:：]\s?\S")
_PAIRS = (("(", ")"), ("[", "]"), ("{", "}"), ("“", "”"), ("«", "»"), ("「", "」"), ("（", "）"), ("„", "“"))


# -- limits ----------------------------------------------------------------------------------


def length_limits(texts: DataFrame, share: float = 0.01, least: int = 4) -> DataFrame:
    """(origin, source, unit, at): lengths at which a source's texts pile up.

    Lengths in characters and bytes are counted over all texts, copies once, without a
    mark such as '...'. A length is a limit if it holds ``share`` of its source, at least
    ``least`` texts and ten times what the lengths around it hold on average.
    """
    bare = F.regexp_replace("text", MARKS, "")
    size = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.length(bare).alias("at")), F.struct(F.lit("bytes").alias("unit"), F.octet_length(bare).alias("at")))).alias("s")
    once = texts.where("text IS NOT NULL").select("origin", "source", F.xxhash64("text").alias("h"), size).distinct()
    counts = once.groupBy("origin", "source", "s.unit", "s.at").agg(F.count(F.lit(1)).alias("n"))
    around = Window.partitionBy("origin", "source", "unit").orderBy("at").rangeBetween(-60, 60)
    whole = Window.partitionBy("origin", "source", "unit")
    near = (F.sum("n").over(around) - F.col("n")) / 120
    found = counts.withColumn("near", near).withColumn("all", F.sum("n").over(whole))
    return found.where((F.col("n") >= least) & (F.col("n") >= share * F.col("all")) & (F.col("n") >= 10 * F.col("near"))).select("origin", "source", "unit", "at")


# -- features --------------------------------------------------------------------------------


def _kind(c: str) -> str:
    if not c:
        return "none"
    if c in _ENDS:
        return "end"
    if "぀" <= c <= "ヿ" or "一" <= c <= "鿿":
        return "cjk"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "upper" if c.isupper() else "lower"
    return c


def _distance(n: int, limits: list[int]) -> str:
    best = min((n - x for x in limits), key=abs, default=None)
    return "none" if best is None else str(best) if -4 <= best <= 1 else "past" if best > 1 else "below"


def features(text: str, chars: list[int], octets: list[int]) -> list[int]:
    """Indices of the hashed features of one text under its source's limits."""
    mark = _MARK.search(text)
    bare = text[: mark.start()] if mark else text.rstrip()
    mk = (mark.group().strip()[:1] + mark.group().strip()[-1:]) if mark else "none"
    last = bare[bare.rfind("\n\n") + 2 :] if "\n\n" in bare else bare
    line = last[last.rfind("\n") + 1 :]
    core = bare.rstrip(_CLOSERS)
    kind, raw = _kind(core[-1:]), _kind(bare[-1:])
    inside = sum(line.count(c) for c in ".!?。！？")
    label = bool(_LABEL.match(line)) and len(line) < 160 and inside <= 1
    bullet = bool(_BULLET.match(line))
    words = len(last.split()) if not any("぀" <= c <= "鿿" for c in last[:40]) else len(last) // 2
    size = min(words, 4) if words < 5 else 5 if words < 9 else 6 if words < 20 else 7
    wrapped = line[:1] in "(（[" and line[-1:] in ")）]"
    unclosed = "".join(a for a, b in _PAIRS if last.count(a) > last.count(b))
    dc = _distance(len(re.sub(r"\s+$", "", bare)) if mark else len(text), chars)
    db = _distance(len((bare if mark else text).encode("utf-8", "surrogatepass")), octets)
    at = dc if dc not in ("none", "below", "past") else "far"
    bt = db if db not in ("none", "below", "past") else "far"
    whole_line = f"{label}{bullet}{wrapped}"
    word = core.split()[-1].lower()[:16] if core.split() else ""
    names = (
        "bias", f"k={kind}", f"r={raw}", f"m={mk}", f"mk={mk}|{kind}", f"w={whole_line}", f"wk={whole_line}|{kind}|{mk}", f"s={size}", f"sk={size}|{kind}|{mk}",
        f"sm={size}|{inside > 0}|{mk}|{kind}", f"c={dc}", f"b={db}", f"ck={at}|{kind}", f"bk={bt}|{kind}", f"cm={at}|{mk}", f"bm={bt}|{mk}", f"o={unclosed}", f"ok={bool(unclosed)}|{kind}|{mk}",
        f"3={core[-3:].lower()}|{mk}", f"lw={word}|{mk}", f"p={bare.count(chr(10) + chr(10)) > 0}|{size}|{mk}", f"rk={raw}|{kind}",
    )
    mask = (1 << BITS) - 1
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) & mask for n in names]


def at_limit(text: str, chars: list[int], octets: list[int]) -> bool:
    """Is the text as long as a limit of its source lets it be?"""
    mark = _MARK.search(text)
    bare = text[: mark.start()] if mark else text
    return any(-4 <= n - x <= 1 for n, limits in ((len(bare), chars), (len(bare.encode("utf-8", "surrogatepass")), octets)) for x in limits)


def cut_somewhere(text: str, rng: random.Random, chars: list[int], octets: list[int]) -> str | None:
    """``text`` without its end, as a limit or a broken transfer leaves it; None if what
    remains could be whole."""
    marks = ("...", "…", " […]", " [...]", " (more)")
    fits = [x for x in chars if x < len(text)]
    sizes = [x for x in octets if x < len(text.encode("utf-8", "surrogatepass"))]
    how = rng.random()
    if how < 0.4 and (fits or sizes):
        if fits and (not sizes or rng.random() < 0.5):
            out = text[: rng.choice(fits)]
        else:
            out = text.encode("utf-8", "surrogatepass")[: rng.choice(sizes)].decode("utf-8", "ignore")
        if out.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS:
            return None
        return out.rstrip() + rng.choice(marks) if rng.random() < 0.4 else out
    at = rng.randint(max(20, len(text) // 4), len(text) - 2)
    out = text[:at].rstrip()
    if out.rstrip(_CLOSERS)[-1:] in _ENDS or "\n\n" not in text[at:] and len(text) - at < 2:
        return None
    return out + rng.choice(marks) if rng.random() < 0.35 else out


# -- model -----------------------------------------------------------------------------------


def fit(rows: list[tuple[list[int], int]], epochs: int = 12, seed: int = 7, l2: float = 1e-6) -> np.ndarray:
    """Logistic regression by AdaGrad over hashed features; classes weigh the same."""
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    if not rows:
        return weights
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    share = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(order.permutation(len(y)), max(1, len(y) // 64)):
            p = 1 / (1 + np.exp(-weights[x[part]].sum(axis=1)))
            g = np.zeros_like(weights)
            np.add.at(g, x[part].ravel(), np.repeat((p - y[part]) * share[part], x.shape[1]))
            hit = np.unique(x[part])
            g = g[hit] / len(part) + l2 * weights[hit]
            seen[hit] += g * g
            weights[hit] -= 0.2 * g / np.sqrt(seen[hit])
    return weights


def _probability(weights: np.ndarray, x: list[list[int]]) -> np.ndarray:
    return 1 / (1 + np.exp(-weights[np.array(x)].sum(axis=1))) if x else np.zeros(0)


def train(texts: DataFrame, limits: dict[tuple[str, str], tuple[list[int], list[int]]], sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Weights from about ``sample`` records, taken by hash.

    Each gives itself as whole, unless it is as long as a limit allows, and up to two cuts
    of itself as positives. Records that the first fits take for cut are then left out of
    the whole ones.
    """
    rows = texts.where("length(trim(text)) >= 60").select("origin", "source", "text")
    n = rows.count()
    picked = rows.where(F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1_000_000)) < int(1_000_000 * min(1.0, sample / max(n, 1))) )

    def examples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for origin, source, text in zip(b["origin"], b["source"], b["text"]):
                rng = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass")) ^ seed)
                chars, octets = limits.get((origin, source), ([], []))
                if not at_limit(text, chars, octets):
                    out.append((features(text, chars, octets), 0))
                for _ in range(2):
                    got = cut_somewhere(text, rng, chars, octets)
                    if got:
                        out.append((features(got, chars, octets), 1))
            yield pd.DataFrame(out, columns=["x", "y"])

    data = [(list(r.x), r.y) for r in picked.mapInPandas(examples, "x array<int>, y int").collect()]
    kept = data
    weights = fit(kept)
    for _ in range(2):
        scores = _probability(weights, [x for x, _ in data])
        kept = [d for d, s in zip(data, scores) if d[1] == 1 or s < 0.5]
        weights = fit(kept)
    return weights


def limit_table(limits: DataFrame) -> dict[tuple[str, str], tuple[list[int], list[int]]]:
    """Limits by origin and source: at most 100 lengths a source and unit (1 % each)."""
    out: dict[tuple[str, str], tuple[list[int], list[int]]] = {}
    for r in limits.collect():
        out.setdefault((r.origin, r.source), ([], []))[r.unit == "bytes"].append(r.at)
    return out


def score_cuts(texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Adds ``p_cut``, the probability that ``text`` lost its end, to every row.

    texts: (origin, source, text) and any other columns. Null and blank texts get null,
    repeated rows the same value, a null source counts as one of its own.
    """
    named = texts.withColumn("source", F.coalesce("source", F.lit("")))
    limits = limit_table(length_limits(named))
    weights = train(named, limits, sample).astype(np.float32)

    @F.pandas_udf("double")
    def probability(origin: pd.Series, source: pd.Series, text: pd.Series) -> pd.Series:
        out = np.full(len(text), np.nan)
        x, at = [], []
        for i, (o, s, t) in enumerate(zip(origin, source, text)):
            if t and not t.isspace():
                x.append(features(t, *limits.get((o, s), ([], []))))
                at.append(i)
        out[at] = _probability(weights, x)
        return pd.Series(out).where(~np.isnan(out), None)

    return named.withColumn("p_cut", probability("origin", "source", "text"))


def cut_rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(origin, source, records, cut, rate) over records, copies of a key once."""
    once = scored.where("p_cut IS NOT NULL").select("origin", "source", "rec_id", (F.col("p_cut") >= threshold).alias("is_cut")).distinct()
    return once.groupBy("origin", "source").agg(F.count(F.lit(1)).alias("records"), F.count_if("is_cut").alias("cut"), F.round(F.avg(F.col("is_cut").cast("double")), 6).alias("rate"))

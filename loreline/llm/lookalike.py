"""One consistent form for texts that look the same but differ in characters.

After compatibility normalisation and deletion of ignorable characters, each word is read
as a lattice of look-alike letters: every letter stands for the class of letters drawn
the same way. Viterbi picks the path of the best character bigrams of one script. The
lattice depends on the classes alone, so words that look the same always come out the
same, and words that look different never do.

Letters of one class are alike in common fonts for certain; letters that only resemble one
another are left apart, as are forms that can be seen to differ (bold or script letters of
mathematics, Roman numerals as single signs).
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreline.session import materialise

# Letters of several scripts that are drawn the same way, by class.
CLASSES = (
    "AАΑᎪ", "BВΒᏴ", "CСϹᏟ", "DᎠ", "EЕΕᎬ", "FϜ", "GԌᏀ", "HНΗᎻ", "IІΙӀ", "JЈᎫͿ", "KКΚᏦ", "LᏞ", "MМΜᎷ", "NΝ", "OОΟՕ", "PРΡᏢ", "QԚ", "RᎡ", "SЅՏᏚ", "TТΤᎢ", "UՍ", "VᏙѴ", "WԜᎳ", "XХΧ", "YΥҮᎩ", "ZΖᏃ",
    "aа", "cсϲ", "dԁ", "eе", "gցɡ", "hһհ", "iі", "jјϳ", "lӏ", "nո", "oоοօ", "pр", "qԛզ", "sѕ", "uս", "vνѵ", "wԝ", "xх", "yу", "ГΓ", "ПΠ", "ФΦ",
)
# Signs drawn the same way as an ASCII one.
SIGNS = {"\u2010": "-", "\u2011": "-"}
SWITCH = 1000.0  # cost of changing script inside a word, above any sum of bigram scores of a word
_OPTIONS = {c: k for k in CLASSES for c in k}
_SAME = {ord(c): k[0] for k in CLASSES for c in k}
# Words made only of letters that other scripts share; any other ASCII word is Latin and stays.
_SHARED = re.compile(r"(?<![A-Za-z])[" + "".join(k[0] for k in CLASSES if k[0].isascii()) + r"]+(?![A-Za-z])")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")


@lru_cache(maxsize=4096)
def script(c: str) -> str:
    """L, G, C, A or E for Latin, Greek, Cyrillic, Armenian and Cherokee letters, else ''."""
    if c.isascii():
        return "L" if c.isalpha() else ""
    kind = unicodedata.name(c, "").split(" ")[0]
    return {"LATIN": "L", "GREEK": "G", "CYRILLIC": "C", "ARMENIAN": "A", "CHEROKEE": "E"}.get(kind, "") if unicodedata.category(c)[0] == "L" else ""


@lru_cache(maxsize=65536)
def _compatible(c: str) -> str:
    """What a character counts as: full and half width, unbreakable and ligature forms resolved."""
    if c in SIGNS:
        return SIGNS[c]
    category, form = unicodedata.category(c), unicodedata.decomposition(c)
    if category == "Zs":
        return " "
    if category == "Cf" or "\ufe00" <= c <= "\ufe0f" or c == "\u034f":
        return ""
    if form.startswith(("<wide>", "<narrow>", "<noBreak>")) or (form.startswith("<compat>") and category in ("Ll", "Lu", "Lt")) or c in "\u212a\u212b":
        return "".join(map(_compatible, unicodedata.normalize("NFKC", c)))
    return c


def _joins(c: str) -> bool:
    """Does a joiner beside this character change how it is drawn?"""
    return "\u0590" <= c <= "\u109f" or unicodedata.category(c) == "So"


class _Table(dict):
    """Translation table of _compatible, filled as characters come up."""

    def __missing__(self, code: int) -> str:
        got = self[code] = _compatible(chr(code))
        return got


_TABLE = _Table()
_JOINER = re.compile("[\u200c\u200d]")


def visible(text: str) -> str:
    """Compatibility form without ignorable characters, letters and accents apart (NFD)."""
    if text.isascii():
        return text
    if _JOINER.search(text) and any(map(_joins, set(text))):
        near = [any(_joins(x) for x in text[max(0, i - 1) : i + 2]) for i in range(len(text))]
        out = "".join(c if c in "\u200c\u200d" and near[i] else _TABLE[ord(c)] for i, c in enumerate(text))
    else:
        out = text.translate(_TABLE)
    return unicodedata.normalize("NFD", out)


class Lattice:
    """Viterbi over look-alike classes under bigram counts by script."""

    def __init__(self, counts: dict[tuple[str, str], int]):
        first: Counter[str] = Counter()
        for (a, _), n in counts.items():
            first[a] += n
        self.counts, self.first, self.size = counts, first, len({b for _, b in counts}) + 1
        self.cache: dict[str, str] = {}

    def score(self, a: str, b: str) -> float:
        return math.log((self.counts.get((a, b), 0) + 0.5) / (self.first.get(a, 0) + 0.5 * self.size))

    def word(self, word: str) -> str:
        """The best reading of a word in NFD; combining marks stay where they are."""
        got = self.cache.get(word)
        if got is None:
            if len(self.cache) > 200_000:
                self.cache.clear()
            got = self.cache[word] = self._search(word)
        return got

    def _search(self, word: str) -> str:
        # Beams: per reading of the last letter, (cost, text so far, script); the first option wins ties.
        beams: dict[str, tuple[float, str, str]] = {"^": (0.0, "", "")}
        for c in word:
            options = _OPTIONS.get(c, c)
            if unicodedata.combining(c):
                beams = {k: (cost, text + c, s) for k, (cost, text, s) in beams.items()}
                continue
            new: dict[str, tuple[float, str, str]] = {}
            for o in options:
                s = script(o)
                best = None
                for last, (cost, text, before) in beams.items():
                    step = cost - self.score(last, o) + (SWITCH if s and before and s != before else 0)
                    if best is None or step < best[0] - 1e-12:
                        best = (step, text + o, s or before)
                new[o] = best
            beams = new
        closed = [(cost - self.score(last, "$"), text) for last, (cost, text, _) in beams.items()]
        return min(closed, key=lambda x: (round(x[0], 9), x[1]))[1]

    def text(self, text: str) -> str:
        v = visible(text)
        words = set((_SHARED if v.isascii() else _WORD).findall(v))
        other = {w: r for w in words if (r := self.word(w)) != w}
        if other:
            v = _WORD.sub(lambda m: other.get(m.group(), m.group()), v)
        return unicodedata.normalize("NFC", v)


def bigram_counts(texts: DataFrame, column: str = "text") -> dict[tuple[str, str], int]:
    """Bigrams, with word ends, of the words written in one script, over all rows.

    Words are counted in expressions and each distinct one is read once. Collected to the
    driver: its size is bounded by the letters of five alphabets, not by the rows.
    """
    # Capital and small letters, marks and invisible signs belong to a word until it is read.
    word = r"[\\p{L}\\p{Mn}\\p{Cf}\\x{034F}\\x{FE00}-\\x{FE0F}]+".replace("\\\\", "\\")
    words = texts.where(F.col(column).isNotNull()).select(F.explode(F.regexp_extract_all(column, F.lit(word), F.lit(0))).alias("w"))
    counted = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = counted.mapInPandas(_count, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r.a, r.b): r.n for r in total.collect()}


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pairs: Counter[tuple[str, str]] = Counter()
    for batch in batches:
        for t, n in zip(batch["w"], batch["n"]):
            for w in _WORD.findall(visible(t)):
                letters = w if w.isascii() else [c for c in w if not unicodedata.combining(c)]
                kinds = set(map(script, letters))
                if len(kinds) == 1 and kinds != {""}:
                    for a, b in zip(["^", *letters], [*letters, "$"]):
                        pairs[a, b] += n
    yield pd.DataFrame([(a, b, n) for (a, b), n in pairs.items()], columns=["a", "b", "n"]).astype({"n": "int64"})


def consistent_text(df: DataFrame, column: str, counts: dict[tuple[str, str], int], out: str = "consistent", digest: bool = False) -> DataFrame:
    """Adds ``out``: the consistent form of ``column`` (null stays null, '' stays '').

    counts: bigram_counts over the texts that are to be comparable. digest: the SHA-256 of
    the form instead of it, for comparisons of long texts.
    """
    import hashlib

    holder: list[Lattice] = []

    @F.pandas_udf("string")
    def form(texts: pd.Series) -> pd.Series:
        if not holder:
            holder.append(Lattice(counts))
        read = holder[0].text
        if digest:
            return texts.map(lambda t: None if t is None else hashlib.sha256(read(t).encode("utf-8", "surrogatepass")).hexdigest())
        return texts.map(lambda t: None if t is None else read(t))

    return df.withColumn(out, form(F.col(column)))


def same_looking_classes(texts: DataFrame) -> DataFrame:
    """(origin, scope, id, raw, form, members): every text with its class.

    texts: (origin, scope, id, text), other columns are ignored; null and empty texts are
    in no class. Rows of one origin, scope and form look the same; ``raw`` tells exact
    copies (digest of the text), ``form`` is the digest of the consistent form,
    ``members`` how many different texts look so. One row a text, however many look alike.
    """
    counts = bigram_counts(texts)
    rows = consistent_text(texts.where("text <> ''"), "text", counts, "form", digest=True)
    rows = materialise(rows.select("origin", "scope", "id", F.sha2("text", 256).alias("raw"), "form").distinct(), "looks")  # each form is made once
    sizes = rows.groupBy("origin", "scope", "form", "raw").agg(F.lit(1).alias("one")).groupBy("origin", "scope", "form").agg(F.count(F.lit(1)).alias("members"))
    return rows.join(sizes, ["origin", "scope", "form"])


def same_looking_pairs(texts: DataFrame) -> DataFrame:
    """(origin, a_id, b_id), a_id < b_id: rows of one origin and scope that look the same
    and differ in code points.

    Only classes with several different texts are expanded, and the pairs themselves are
    what is asked for; ``same_looking_classes`` has the same links without them. Exact
    copies do not pair with each other; null and empty texts pair with nothing.
    """
    rows = same_looking_classes(texts).where("members > 1").select("origin", "scope", "id", "raw", "form")
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("origin", "scope", "form")]
    pairs = a.join(b, [*on, F.col("a.id") < F.col("b.id"), F.col("a.raw") != F.col("b.raw")])
    return pairs.select("a.origin", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"))

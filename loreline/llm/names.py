"""Mapping free-entered names to the entries of a reference list, in SQL expressions only.

A name is freed of typing habits (markup, namespaces and page suffixes, honorifics,
nicknames, inversion, look-alike letters, accents, spacing), then compared by edit
distance with every entry through a pigeonhole join: an entry's key is cut into k + 1
segments, and a key within k edits holds one of them unchanged at a shifted place.

An entry's length sets its k: one edit for every LETTERS_PER_EDIT letters, MAX_EDITS at
most. A short name is so taken for another only if it is nearly the same, and no segment
is shorter than half of LETTERS_PER_EDIT.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreline.session import materialise

UNMATCHED = -1
MAX_EDITS = 3
LETTERS_PER_EDIT = 4

# Letters of other scripts that look like Latin ones, and digits typed for letters.
LOOK_ALIKES = "АВЕКМНОРСТХаеорсухіѕјΑΒΕΖΗΙΚΜΝΟΡΤΥΧο01"
LATIN = "ABEKMHOPCTXaeopcyxisjABEZHIKMNOPTYXool"
# Words put before a name that do not change whom it names.
HONORIFICS = (
    "the", "young", "old", "little", "big", "captain", "capt", "cap'n", "commander", "admiral", "doctor", "dr", "professor", "prof", "mister", "mr", "missus", "mrs", "miss", "ms",
    "sir", "lord", "lady", "king", "queen", "prince", "princess", "saint", "st", "uncle", "aunt", "brother", "sister", "master", "chief", "boss",
)
# What a page address or a typist appends: query, section, tab of the page, a remark in brackets, 'wiki', 'etc.'.
# A name may hold '/' itself, so of what follows one only tabs are taken off.
TRAILERS = r"(\?[\w=&%\-]*|#.*|/(?:history|talk|edit|gallery|images|references)|[ .\-]+wiki|\s*\[[^\[\]]*\]|[ .]+etc\.?|[ .\-]*\(?character\)?)$"


def _plain_letters() -> tuple[str, str]:
    """Accented Latin letters and full-width forms, with what they reduce to."""
    source, target = list(LOOK_ALIKES), list(LATIN)
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii():
            source.append(chr(code))
            target.append(base[0])
    source += [chr(0xFF01 + i) for i in range(94)] + ["　"]
    target += [chr(0x21 + i) for i in range(94)] + [" "]
    return "".join(source), "".join(target)


def typed_text(value: Column) -> Column:
    """Lower case, plain Latin letters, blanks as single spaces."""
    source, target = _plain_letters()
    v = F.regexp_replace(value, r"[\p{Mn}\p{Cf}]", "")
    v = F.lower(F.translate(F.translate(v, *_full_width_first()), source, target))
    return F.trim(F.regexp_replace(v, r"[\s\p{Z}_]+", " "))


def _full_width_first() -> tuple[str, str]:
    return "".join(chr(0xFF01 + i) for i in range(94)), "".join(chr(0x21 + i) for i in range(94))


def undecorated(text: Column) -> Column:
    """Without link brackets, quotes, page suffixes, nicknames and middle initials; 'B, A' as 'A B'."""
    v = F.regexp_replace(text, r"^\s*\[\[:?([^|\]]*).*$", "$1")
    v = F.trim(F.regexp_replace(v, "'{2,}", ""))
    v = F.regexp_replace(v, r'^["“]([^"”]*)["”]$', "$1")
    v = F.regexp_replace(v, r'\s["“][^"”]*["”](?=\s)', " ")
    v = F.trim(F.regexp_replace(v, TRAILERS, ""))
    v = F.regexp_replace(v, r"^[ :]+|[ :]+$", "")
    v = F.regexp_replace(v, r"^([^,]+),\s*(.+)$", "$2 $1")
    return F.regexp_replace(v, r"(?<=[\s._\-])[a-z]\.\s*(?=\S)", " ")


def plain_key(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def sound_key(text: Column) -> Column:
    """Plain key with letters that are typed for one another made the same."""
    return F.replace(F.translate(F.replace(plain_key(text), F.lit("qu"), F.lit("kw")), "cy", "ki"), F.lit("'"), F.lit(""))


def _forms(text: Column) -> Column:
    return F.array(F.struct(F.lit("plain").alias("form"), plain_key(text).alias("key")), F.struct(F.lit("sound").alias("form"), sound_key(text).alias("key")))


def edits(length: Column, k: int) -> Column:
    """Edits that an entry of that many letters allows."""
    return F.least(F.lit(k), F.floor(length / LETTERS_PER_EDIT)).cast("int")


def pigeonhole_join(values: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(value, entry_id, distance) of all pairs whose keys are within the entry's edits.

    values: (value, form, key); entries: (entry_id, form, key). Only keys of one form are
    compared. Exact: a value's substrings are taken at every place where, by the lengths
    alone, a segment can have moved to; no pair within ``edits`` of the entry's length and
    ``k`` is missed.
    """
    allowed = edits(F.col("len"), k)
    i = F.explode(F.sequence(F.lit(0), allowed)).alias("i")
    cut = entries.select("entry_id", "form", F.col("key").alias("ekey"), F.length("key").alias("len"))
    cut = cut.select("*", allowed.alias("allowed"), i)
    start, stop = F.floor(F.col("i") * F.col("len") / (F.col("allowed") + 1)), F.floor((F.col("i") + 1) * F.col("len") / (F.col("allowed") + 1))
    cut = cut.withColumn("segment", F.col("ekey").substr(start.cast("int") + 1, (stop - start).cast("int")))
    near = values.select("value", "form", "key", F.explode(F.sequence(F.greatest(F.lit(0), F.length("key") - k), F.length("key") + k)).alias("len"))
    near = near.where(F.abs(F.length("key") - F.col("len")) <= allowed).select("*", allowed.alias("allowed"), i)
    delta = F.length("key") - F.col("len")
    width = (stop - start).cast("int")
    low = F.greatest(F.lit(0), (start - F.floor((F.col("allowed") - delta) / 2)).cast("int"))
    high = F.least(F.length("key") - width, (start + F.floor((F.col("allowed") + delta) / 2)).cast("int"))
    near = near.select("*", low.alias("low"), high.alias("high"), width.alias("width")).where("low <= high")
    near = near.select("value", "form", "key", "len", "i", "width", F.explode(F.sequence("low", "high")).alias("at"))
    near = near.select("value", "form", "key", "len", "i", F.col("key").substr(F.col("at") + 1, F.col("width")).alias("segment"))
    pairs = near.distinct().join(cut, ["form", "len", "i", "segment"])
    distance = F.levenshtein("key", "ekey", k)
    return pairs.select("value", "entry_id", "allowed", distance.alias("distance")).where("distance BETWEEN 0 AND allowed").drop("allowed")


def match_names(values: DataFrame, entries: DataFrame, k: int = MAX_EDITS) -> DataFrame:
    """(value, entry_id, distance) for every distinct value; entry_id -1 names none.

    values: a string column ``value``; entries: (entry_id, canonical_name). An entry is
    taken if it alone is nearest within the edits its length allows, k at most; a tie
    between entries, an empty key and a null value come out as -1 with a null distance. A first name cut to its initial stands
    for an entry if that alone fits, with one edit in the rest. Repeated entries (one id)
    count once. Other columns are ignored.
    """
    values = values.select(F.col("value").cast("string").alias("value")).distinct()
    named = values.where("value IS NOT NULL").withColumn("text", undecorated(typed_text(F.col("value"))))
    bare = F.regexp_replace("text", "^(" + "|".join(HONORIFICS) + r")\b[\s.\-_]+", "")
    named = named.select("value", "text", F.explode(F.array_distinct(F.array("text", bare))).alias("alt"))
    keyed = named.select("value", "text", F.inline(_forms(F.col("alt")))).where("key <> ''").select("value", "form", "key").distinct()
    keyed = materialise(keyed, "keyed")  # read by every step
    listed = entries.where("canonical_name IS NOT NULL").select("entry_id", typed_text(F.col("canonical_name")).alias("t")).distinct()
    targets = listed.select("entry_id", F.inline(_forms(F.col("t")))).where("key <> ''").distinct()
    exact = keyed.join(targets, ["form", "key"]).select("value", "entry_id", F.lit(0).alias("distance"))
    found = materialise(_only_nearest(exact), "exact")
    rest = keyed.join(found.select("value"), "value", "left_anti")
    near = materialise(_only_nearest(pigeonhole_join(rest, targets, k)), "near")
    # First names cut to an initial: the key is the initial and the rest of the name.
    initial = r"^(\p{L})\.\s*(\p{L}.*)$"
    short = values.withColumn("t", typed_text(F.col("value"))).where(F.col("t").rlike(initial))
    short = short.select("value", F.concat_ws(":", F.regexp_extract("t", initial, 1)).alias("form"), sound_key(F.regexp_extract("t", initial, 2)).alias("key")).where("key <> ''")
    words = r"^(\p{L})[^ ]* (.+)$"
    cut = listed.where(F.col("t").rlike(words)).select("entry_id", F.regexp_extract("t", words, 1).alias("form"), sound_key(F.regexp_extract("t", words, 2)).alias("key"))
    done = found.unionByName(near)
    by_initial = materialise(_only_nearest(pigeonhole_join(short.join(done.select("value"), "value", "left_anti"), cut, 1)), "initial")
    done = done.unionByName(by_initial)
    none = values.join(done.select("value"), "value", "left_anti").select("value", F.lit(UNMATCHED).alias("entry_id"), F.lit(None).cast("int").alias("distance"))
    return done.unionByName(none)


def _only_nearest(pairs: DataFrame) -> DataFrame:
    """The nearest entry of each value where no other is as near."""
    best = pairs.groupBy("value", "entry_id").agg(F.min("distance").alias("distance"))
    best = best.groupBy("value").agg(F.min("distance").alias("distance"), F.min_by("entry_id", "distance").alias("a"), F.min_by("entry_id", F.struct("distance", -F.col("entry_id"))).alias("b"), F.min_by("entry_id", F.struct("distance", "entry_id")).alias("entry_id"))
    return best.where("entry_id = b").select("value", "entry_id", "distance")


def redirect_values(redirects: DataFrame) -> DataFrame:
    """(redirect_id, value): canonical_name, or redirect where that is null or blank."""
    blank = F.col("canonical_name").isNull() | ~F.col("canonical_name").rlike(r"[^\s\p{Z}]")
    return redirects.select("redirect_id", F.when(blank, F.col("redirect")).otherwise(F.col("canonical_name")).alias("value")).distinct()


def map_redirects(redirects: DataFrame, entries: DataFrame) -> DataFrame:
    """(redirect_id, value, entry_id, distance) for every redirect, once each."""
    asked = redirect_values(redirects)
    matched = match_names(asked, entries).withColumnRenamed("value", "v")
    out = asked.join(matched, asked["value"].eqNullSafe(matched["v"]), "left")
    return out.select("redirect_id", "value", F.coalesce("entry_id", F.lit(UNMATCHED)).alias("entry_id"), "distance")


def unmatched_values(redirects: DataFrame, entries: DataFrame) -> DataFrame:
    """(value, redirects): values that stand for no entry, with the number of their redirects."""
    return map_redirects(redirects, entries).where(F.col("entry_id") == UNMATCHED).groupBy("value").agg(F.count(F.lit(1)).alias("redirects"))

"""Queries over the core operators for general data processing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreline.operators.history import deliveries, entity_history
from loreline.operators.incremental import unhandled_chapters
from loreline.operators.known import known_mentions
from loreline.session import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return unhandled_chapters(table(spark, d, "chapters"), table(spark, d, "state"), table(spark, d, "runs"), files=True)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    got = known_mentions(table(spark, d, "mentions"), table(spark, d, "registry"), table(spark, d, "disguises"), ("valid_from",))
    case = "registered AND valid_from IS NOT NULL AND NOT (known_name = canonical_name AND valid_from = latest)"
    return got.where(case).select("mention_id", F.col("known_name").alias("canonical_name"), F.col("valid_from").cast("int").alias("valid_from"))


def p5_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Every mention with what was known; aliases as one string."""
    got = known_mentions(table(spark, d, "mentions"), table(spark, d, "registry"), table(spark, d, "disguises"))
    return got.select("mention_id", "known_name", F.col("valid_from").cast("int").alias("valid_from"), "entity_type", F.array_join("aliases", "|").alias("aliases"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    whole = _history(spark, d)
    return whole.select("canonical_name", F.col("valid_from").cast("int").alias("valid_from"), F.col("valid_to").cast("int").alias("valid_to"))


def p7_history(spark: SparkSession, d: str) -> DataFrame:
    whole = _history(spark, d)
    return whole.select(
        "canonical_name", "entity_type", F.array_join("aliases", "|").alias("aliases"),
        F.col("valid_from").cast("int").alias("valid_from"), F.col("valid_to").cast("int").alias("valid_to"))


DELIVERIES = 4  # sources that the log of updates is read as, by order of arrival


def _history(spark: SparkSession, d: str) -> DataFrame:
    return entity_history(*deliveries(table(spark, d, "registry_updates"), DELIVERIES))


QUERIES = {f.__name__: f for f in (p3_found, p5_found, p5_attributes, p7_found, p7_history)}

_P3 = r"""
WITH ok AS (SELECT DISTINCT run_id, started_at FROM runs WHERE status = 'ok'),
cur AS (SELECT number, max(revid) AS revid FROM chapters
        WHERE number > 0 AND regexp_matches(wikitext, '[^\s\p{Z}\x{FEFF}\x{200B}]') GROUP BY number),
st AS (SELECT number, revid, complete FROM (
         SELECT number, revid, min(coalesce(complete, false)) AS complete,
                row_number() OVER (PARTITION BY number ORDER BY started_at DESC, run_id DESC, revid DESC) AS k
         FROM state JOIN ok USING (run_id) GROUP BY number, started_at, run_id, revid) WHERE k = 1)
SELECT cur.number, cur.revid FROM cur LEFT JOIN st USING (number)
WHERE st.number IS NULL OR st.revid <> cur.revid OR NOT st.complete
"""

_P5 = """
WITH reg AS (SELECT canonical_name, valid_from, max(coalesce(valid_to, 2147483647)) AS valid_to, min(entity_type) AS entity_type, min(aliases) AS aliases
             FROM registry WHERE canonical_name IS NOT NULL AND valid_from IS NOT NULL GROUP BY 1, 2),
lat AS (SELECT canonical_name, max(valid_from) AS latest FROM reg GROUP BY 1),
dis AS (SELECT alias, canonical_name, max(coalesce(revelation, 2147483647)) AS until FROM disguises GROUP BY 1, 2),
m AS (SELECT DISTINCT mention_id, m.canonical_name, m.chapter,
             CASE WHEN m.chapter < until THEN m.alias ELSE m.canonical_name END AS known
      FROM mentions m LEFT JOIN dis ON dis.alias = m.alias AND dis.canonical_name = m.canonical_name),
p AS (SELECT DISTINCT known, chapter FROM m),
v AS (SELECT known, chapter, max(valid_from) AS valid_from FROM p JOIN reg ON reg.canonical_name = known
      AND valid_from <= chapter AND valid_to >= chapter GROUP BY 1, 2)
"""

_P7 = """
WITH o AS (SELECT canonical_name, chapter, coalesce(present, false) AS present,
                  CASE WHEN present THEN entity_type END AS entity_type,
                  CASE WHEN present THEN array_to_string(list_sort(list_distinct(coalesce(aliases, []))), '|') END AS aliases
           FROM (SELECT *, row_number() OVER (PARTITION BY canonical_name, chapter ORDER BY update_id DESC) AS k
                 FROM registry_updates WHERE trim(canonical_name) <> '' AND chapter IS NOT NULL) WHERE k = 1),
c AS (SELECT *, row_number() OVER w AS i, lag(present) OVER w AS p0, lag(entity_type) OVER w AS t0, lag(aliases) OVER w AS a0
      FROM o WINDOW w AS (PARTITION BY canonical_name ORDER BY chapter)),
s AS (SELECT * FROM c WHERE i = 1 OR p0 IS DISTINCT FROM present OR t0 IS DISTINCT FROM entity_type OR a0 IS DISTINCT FROM aliases),
h AS (SELECT *, coalesce(lead(chapter) OVER (PARTITION BY canonical_name ORDER BY chapter) - 1, -1) AS valid_to FROM s)
"""

ORACLES = {
    "p3_found": _P3,
    "p5_found": _P5 + """
SELECT mention_id, known AS canonical_name, v.valid_from FROM m JOIN v USING (known, chapter)
JOIN lat ON lat.canonical_name = m.canonical_name
WHERE NOT (known = m.canonical_name AND v.valid_from = latest)""",
    "p5_attributes": _P5 + """
SELECT mention_id, known AS known_name, v.valid_from, entity_type, array_to_string(aliases, '|') AS aliases
FROM m LEFT JOIN v USING (known, chapter) LEFT JOIN reg ON reg.canonical_name = known AND reg.valid_from = v.valid_from""",
    "p7_found": _P7 + "SELECT canonical_name, chapter AS valid_from, valid_to FROM h WHERE present",
    "p7_history": _P7 + "SELECT canonical_name, entity_type, aliases, chapter AS valid_from, valid_to FROM h WHERE present",
}

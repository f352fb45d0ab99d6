"""SQL of the queries over pages, chapters, registry and quality."""

_B = r"[\s\p{Z}\x1C-\x1F\x0B\x85]"


def _strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^{_B}+', ''), '{_B}+$', '')"


def _section(x: str, heading: str) -> str:
    at = rf"'(?im)^(=+)[\s\p{{Z}}\x{{FEFF}}\x85]*{heading}{_B}*=+[ \t]*$([\s\S]*)'"
    rest = f"regexp_extract({x}, {at}, 2)"
    cuts = " ".join(f"WHEN {n} THEN regexp_replace({rest}, '(?m)^={{1,{n}}}[^=][\\s\\S]*', '')" for n in range(1, 7))
    return _strip(f"CASE length(regexp_extract({x}, {at}, 1)) {cuts} ELSE '' END")


def _plain(x: str) -> str:
    x = rf"regexp_replace({x}, '\[\[(?:[^\]|]+\|)?([^\]|]+)\]\]', '\1', 'g')"
    x = rf"regexp_replace({x}, '(?m)^=+{_B}*(.*?){_B}*=+$', '\1', 'g')"
    x = rf"regexp_replace({x}, '\{{\{{[^}}]*\}}\}}', '', 'g')"
    x = f"regexp_replace({x}, '''''''?', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<ref[^>]*>.*?</ref>', '', 'g')"
    x = f"regexp_replace({x}, '<[^>]+>', '', 'g')"
    return _strip(rf"regexp_replace({x}, '\n{{3,}}', e'\n\n', 'g')")


def _title(x: str) -> str:
    t = _strip(f"replace({x}, '_', ' ')")
    return f"(upper(substr({t}, 1, 1)) || substr({t}, 2))"


_LINK = r"'\[\[([^\[\]|]+)(?:\|([^\[\]]*))?\]\]'"
_PAGES = """WITH pages AS (SELECT number, revid, timestamp, line_no, wikitext FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY line_no DESC) AS k FROM chapters WHERE number > 0 AND wikitext IS NOT NULL) WHERE k = 1)"""
_LINKS = rf"""{_PAGES},
l AS (SELECT number, unnest(range(len(t))) AS pos, unnest(t) AS target, unnest(u) AS label FROM (
  SELECT number, regexp_extract_all(wikitext, {_LINK}, 1) AS t, regexp_extract_all(wikitext, {_LINK}, 2) AS u FROM pages))"""
# Links to sections, subpages and list pages, which the pages themselves seldom hold.
_MADE = _LINKS.replace("\nl AS (", "\nl0 AS (") + """,
l AS (SELECT * FROM l0 UNION ALL SELECT 0, 0, unnest([canonical_name, canonical_name || '#History']), '' FROM canon_list WHERE contains(canonical_name, '/')
  UNION ALL SELECT 0, 0, unnest([canonical_name || '/Early life', canonical_name || '#Abilities']), '' FROM registry WHERE canonical_name IS NOT NULL
  UNION ALL SELECT 0, 0, unnest([catalog, catalog || '#' || replace(canonical_name, ' ', '_'), catalog || '/Part two#' || canonical_name, catalog || '#Unlisted ' || canonical_name]), '' FROM registry WHERE catalog IS NOT NULL AND canonical_name IS NOT NULL)"""
_NAME = rf"""CASE WHEN contains(target, ':') AND lower({_strip("split_part(regexp_replace(target, '^:+', ''), ':', 1)")}) IN ('file','image','category','template','wikipedia','w') THEN NULL
  ELSE nullif({_title("split_part(split_part(target, '#', 1), '/', 1)")}, '') END"""
_PROSE = rf"(?i)^{_B}*(?:=+.*=+|'''(?:[^']|'[^']|''[^'])+'''|\[\[(?:File|Image):.*\]\]){_B}*$".replace("'", "''")
_SCENES = rf"""{_PAGES},
p AS (SELECT number, unnest(range(len(a))) AS i, unnest(a) AS par FROM (SELECT number, regexp_split_to_array({_section("wikitext", "Long Summary")}, '\n{_B}*\n') AS a FROM pages)),
f AS (SELECT number, i, {_strip(f"array_to_string(list_filter(regexp_split_to_array(par, '\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\x{{2028}}\\x{{2029}}]'), lambda x: NOT regexp_full_match(x, '{_PROSE}')), e'\\n')")} AS text FROM p),
sc AS (SELECT number AS chapter, row_number() OVER (PARTITION BY number ORDER BY i) - 1 AS scene, text FROM f WHERE text <> '')"""
_TARGETS = rf"""t0 AS (SELECT DISTINCT target FROM src), cats AS (
  SELECT title, list_sort(list_distinct(list(c))) AS categories FROM (
    SELECT canonical_name AS title, CASE max(entity_type) WHEN 'Character' THEN 'Characters' WHEN 'Place' THEN 'Islands' WHEN 'Group' THEN 'Crews' WHEN 'Ship' THEN 'Ships'
      WHEN 'Devil Fruit' THEN 'Paramecia' WHEN 'Weapon' THEN 'Swords' WHEN 'Object' THEN 'Artifacts' WHEN 'Unknown' THEN 'Terms' END AS c FROM registry WHERE canonical_name IS NOT NULL GROUP BY 1
    UNION ALL SELECT catalog, 'Lists' FROM registry WHERE catalog IS NOT NULL
    UNION ALL SELECT canonical_name, CASE entity_type WHEN 'Character' THEN 'Characters' WHEN 'Place' THEN 'Islands' WHEN 'Group' THEN 'Crews' WHEN 'Ship' THEN 'Ships'
      WHEN 'Devil Fruit' THEN 'Paramecia' WHEN 'Weapon' THEN 'Swords' WHEN 'Object' THEN 'Artifacts' WHEN 'Unknown' THEN 'Terms' END FROM canon_list WHERE contains(canonical_name, '/')) WHERE c IS NOT NULL GROUP BY 1),
kind AS (SELECT title, CASE WHEN list_contains(categories, 'Paramecia') THEN 'Devil Fruit' WHEN list_contains(categories, 'Ships') THEN 'Ship' WHEN list_contains(categories, 'Swords') THEN 'Weapon'
  WHEN list_contains(categories, 'Islands') THEN 'Place' WHEN list_contains(categories, 'Characters') THEN 'Character' WHEN list_contains(categories, 'Crews') THEN 'Group'
  WHEN list_contains(categories, 'Artifacts') THEN 'Object' END AS t FROM cats)"""
_PARTS = rf"""pt AS (SELECT DISTINCT {_NAME} AS parent, {_title("split_part(target, '#', 1)")} AS page, contains(target, '#') AS has FROM l),
parts AS (SELECT DISTINCT parent AS name, 'parent' AS kind FROM pt WHERE parent IS NOT NULL AND (page <> parent OR has)
  UNION SELECT DISTINCT page, 'subpage' FROM pt WHERE parent IS NOT NULL AND page <> parent)"""
_RESOLVED = rf"""{_TARGETS}, {_PARTS}, catalogs AS (SELECT name FROM parts JOIN cats ON title = name WHERE kind = 'parent' AND list_contains(categories, 'Lists')),
r0 AS (SELECT target, {_NAME} AS parent, {_title("split_part(target, '#', 1)")} AS page, contains(target, '#') AS has,
  CASE WHEN contains(target, '#') THEN {_strip("replace(regexp_replace(target, '^[^#]*#', ''), '_', ' ')")} ELSE '' END AS entry FROM t0),
targets AS (SELECT target, CASE WHEN cg.name IS NOT NULL THEN CASE WHEN entry <> '' AND (ec.categories IS NULL OR list_contains(ec.categories, 'Lists')) THEN entry END
    WHEN page <> parent AND k.t IS NOT NULL THEN page ELSE parent END AS canonical_name,
  CASE WHEN cg.name IS NOT NULL THEN true WHEN page <> parent AND k.t IS NOT NULL THEN NOT has ELSE page = parent AND NOT has END AS own, cg.name AS catalog
  FROM r0 LEFT JOIN catalogs cg ON cg.name = parent LEFT JOIN cats ec ON ec.title = entry LEFT JOIN kind k ON k.title = page WHERE parent IS NOT NULL)"""


def _alias(label: str, common: str) -> str:
    t = _strip(f"replace(regexp_replace({label}, '''{{2,}}', '', 'g'), '’', '''')")
    t = f"CASE WHEN regexp_full_match({t}, '(?s)\".*\"|“.*”') THEN {_strip(f'substr({t}, 2, length({t}) - 2)')} ELSE {t} END"
    t = _strip(f"regexp_replace({_strip(f"regexp_replace({t}, '[,;:]+$', '')")}, '(''s|(s)'')$', '\\2')")
    first = f"lower(regexp_replace(regexp_replace(regexp_split_to_array({t}, '{_B}+')[1], '^[.,;:]+', ''), '[.,;:]+$', ''))"
    return f"CASE WHEN own AND {t} <> '' AND regexp_matches({t}, '^[\\p{{Lu}}\\x{{2160}}-\\x{{216F}}\\x{{24B6}}-\\x{{24CF}}]') AND {t} <> canonical_name{f' AND NOT list_contains({common}, {first})' if common else ''} THEN {t} END"


_COMMON = (
    "string_split('a an the this that these those some any every each all both another other such he she it they we you i him her them us me "
    "his hers its their theirs our your my who whom whose what which there here', ' ')"
)
_LINES = rf"""lines AS (SELECT number, unnest(range(len(a))) AS pos, {_strip("unnest(a)")} AS line FROM (
  SELECT number, regexp_split_to_array({_section("wikitext", "Characters")}, '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{{2028}}\x{{2029}}]') AS a FROM pages)),
heads AS (SELECT *, CASE WHEN line LIKE ';%' THEN coalesce(nullif({_strip(r"regexp_extract(line, '^;\s*\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]', 1)")}, ''), nullif({_strip(r"regexp_replace(line, '[\[\];'']', '', 'g')")}, '')) END AS head FROM lines),
held AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY number ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS faction FROM heads),
people AS (SELECT number, pos, faction, {_strip(r"regexp_extract(line, '(?s)^\*\s*\[\[([^\]|]+?)(?:\|([^\]]*))?\]\]\s*(.*)$', 1)")} AS name,
  nullif({_strip(r"regexp_extract(line, '(?s)^\*\s*\[\[([^\]|]+?)(?:\|([^\]]*))?\]\]\s*(.*)$', 2)")}, '') AS label,
  list_transform(regexp_extract_all(regexp_extract(line, '(?s)^\*\s*\[\[([^\]|]+?)(?:\|([^\]]*))?\]\]\s*(.*)$', 3), '(?:'''')?\(([^)]*)\)(?:'''')?', 1), lambda x: lower({_strip("x")})) AS marks
  FROM held WHERE regexp_matches(line, '(?s)^\*\s*\[\[([^\]|]+?)(?:\|([^\]]*))?\]\]')),
chars AS (SELECT number, name, faction, len(list_filter(marks, lambda x: regexp_matches(x, 'cover|flashback|mentioned|dream'))) = 0 AS on_panel, array_to_string(marks, '|') AS annotations, label
  FROM (SELECT *, row_number() OVER (PARTITION BY number, name ORDER BY pos) AS k FROM people) WHERE k = 1),
groups AS (SELECT DISTINCT number, {_strip(r"regexp_extract(line, '^;\s*\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]', 1)")} AS faction FROM lines WHERE regexp_matches(line, '^;\s*\[\[([^\]|]+?)(?:\|[^\]]*)?\]\]'))"""

_FACTS = """WITH f AS (SELECT DISTINCT * FROM mentions WHERE canonical_name IS NOT NULL AND chapter IS NOT NULL),
told AS (SELECT DISTINCT * FROM disguises WHERE revelation IS NOT NULL),
masks AS (SELECT DISTINCT alias, canonical_name, coalesce(revelation, 2147483647) AS until FROM disguises),
people AS (SELECT c.name AS canonical_name, chapter, coalesce(c.on_panel, false) AS appearance FROM (
  SELECT number AS chapter, unnest(characters) AS c FROM (SELECT DISTINCT number, arc, characters FROM silver)) WHERE c.name IS NOT NULL),
kinds AS (SELECT canonical_name, max(entity_type) AS entity_type FROM registry WHERE canonical_name IS NOT NULL GROUP BY 1),
first_use AS (SELECT canonical_name, alias, min(chapter) AS first FROM f WHERE alias IS NOT NULL GROUP BY 1, 2),
kn AS (SELECT mention_id, chapter, CASE WHEN chapter < until THEN f.alias ELSE f.canonical_name END AS canonical_name, CASE WHEN chapter < until THEN NULL ELSE f.alias END AS alias
  FROM f LEFT JOIN masks ON masks.canonical_name = f.canonical_name AND masks.alias = f.alias),
first_known AS (SELECT canonical_name, alias, min(chapter) AS first FROM kn WHERE alias IS NOT NULL GROUP BY 1, 2),
dated AS (SELECT coalesce(u.canonical_name, d.canonical_name) AS canonical_name, coalesce(u.alias, d.alias) AS alias, coalesce(d.revelation, u.first) AS first
  FROM first_known u FULL JOIN told d ON u.canonical_name = d.canonical_name AND u.alias = d.alias),
totals AS (SELECT canonical_name, count(*) AS mention_count FROM f GROUP BY 1)"""
_STEPS = """, steps AS (SELECT canonical_name, chapter, sum(n)::BIGINT AS n FROM (SELECT canonical_name, chapter, 1 AS n FROM kn UNION ALL SELECT canonical_name, chapter, 0 FROM people WHERE chapter IS NOT NULL) GROUP BY 1, 2),
met AS (SELECT told.canonical_name, revelation AS chapter, sum(n)::BIGINT AS n, min(chapter) AS low, max(chapter) AS high FROM told JOIN steps ON steps.canonical_name = told.alias GROUP BY 1, 2),
al AS (SELECT canonical_name, chapter, sum(n) AS n, min(low) AS low, max(high) AS high FROM (SELECT canonical_name, chapter, n, chapter AS low, chapter AS high FROM steps UNION ALL SELECT * FROM met) GROUP BY 1, 2),
reg AS (SELECT a.canonical_name, chapter AS valid_from, coalesce(lead(chapter) OVER w - 1, until) AS valid_to, min(low) OVER w AS first_chapter_seen, max(high) OVER w AS last_chapter_seen, (sum(n) OVER w)::BIGINT AS mention_count
  FROM al a LEFT JOIN (SELECT alias, max(revelation) - 1 AS until FROM told GROUP BY 1) e ON e.alias = a.canonical_name WINDOW w AS (PARTITION BY a.canonical_name ORDER BY chapter))"""
_MATCHES = """, chk AS (SELECT f.canonical_name, surface, CASE WHEN p.canonical_name IS NULL THEN 0.0 ELSE 1.0 END AS met FROM f
  LEFT JOIN (SELECT DISTINCT canonical_name, chapter FROM people) p USING (canonical_name, chapter)
  WHERE source = 'alias_match' AND f.canonical_name IN (SELECT canonical_name FROM people))"""
_WORDS = rf"len(list_filter(regexp_split_to_array({_strip('x')}, '{_B}+'), lambda y: y <> ''))"
_DIM = rf"""WITH src AS (SELECT '' AS target), {_TARGETS}"""
_LEX = """lex AS (SELECT canonical_name AS n, entity_type AS t FROM canon_list WHERE entity_type IN ('Character','Place','Devil Fruit')),
bare AS (SELECT DISTINCT n AS name, t FROM (SELECT n, t FROM lex UNION ALL SELECT trim(regexp_replace(n, '\\s*\\([^)]*\\)\\s*$', '')), t FROM lex) WHERE n <> ''),
lexicon AS (SELECT name, min(t) AS entity_type FROM bare GROUP BY 1 HAVING count(DISTINCT t) = 1)""".replace("\\\\", "\\")
_ENGLISH = r"""fr AS (SELECT entry_id, trim(canonical_name) AS n, trim(regexp_replace(canonical_name, '\s*\([^)]*\)\s*$', '')) AS bare FROM canon_list WHERE entity_type = 'Devil Fruit'),
eng AS (SELECT english, arg_max(name, entry_id) AS canonical_name FROM (SELECT entry_id, 'The ' || n || ' fruit' AS english, CASE WHEN bare <> '' AND length(bare) < length(n) THEN bare ELSE n END AS name FROM fr) GROUP BY 1)"""
_KEEP = """names AS (SELECT DISTINCT canonical_name AS name FROM mentions WHERE canonical_name IS NOT NULL),
verdict AS (SELECT name, name IN ('Reef Corsairs','Tinder Cove') AS concept, name IN ('Kestrel Bay','Old Pellam','Harbor Watch') AS saved, coalesce(list_contains(categories, 'Terms') AND coalesce(t, '') <> 'Group', false) AS out, categories
  FROM names LEFT JOIN cats ON cats.title = name LEFT JOIN kind ON kind.title = name)"""

ORACLES = {
    "upsert_bronze": _PAGES + " SELECT number, revid, timestamp, line_no, md5(wikitext) AS digest FROM pages",
    "incremental_skip": _PAGES + " SELECT number, revid FROM pages p WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.number = p.number AND s.revid = p.revid AND complete)",
    "batch_titles": _PAGES + " SELECT (number - 1) // 50 AS batch, string_agg('Chapter ' || number, '|' ORDER BY number) AS titles FROM pages GROUP BY 1",
    "section": _PAGES + f" SELECT number, {_section('wikitext', 'Short Summary')} AS short, {_section('wikitext', 'Long Summary')} AS long, {_section('wikitext', 'Characters')} AS characters FROM pages",
    "links": _LINKS + " SELECT number, pos, target, coalesce(label, '') AS label FROM l",
    "canonical_name": _LINKS + f" SELECT DISTINCT target, {_NAME} AS canonical_name, {_title('target')} AS page_title FROM l",
    "scenes": _SCENES + " SELECT chapter, scene, text FROM sc",
    "scenes_per_chapter": _SCENES + " SELECT number AS chapter, count(text) AS scenes FROM pages LEFT JOIN sc ON chapter = number GROUP BY 1",
    "strip_markup": _PAGES + f" SELECT number, {_plain(_section('wikitext', 'Long Summary'))} AS text FROM pages",
    "parse_chapter": _PAGES + rf""" SELECT number, nullif({_strip(r"regexp_extract(wikitext, '\|\s*title\s*=\s*([^\n|}]+)', 1)")}, '') AS title, nullif({_strip(r"regexp_extract(wikitext, '\|\s*jname\s*=\s*([^\n|}]+)', 1)")}, '') AS jname,
  nullif(regexp_extract(wikitext, '\{{\{{\s*([A-Za-z0-9 ''’\-]+ Arc)\s*\}}\}}', 1), '') AS arc, revid AS revision_id, timestamp AS revised_at, {_plain(_section("wikitext", "Short Summary"))} AS short_summary,
  array_to_string(list_transform(regexp_extract_all({_section("wikitext", "Chapter Notes")}, '(?m)^\*+{_B}*(.+)$', 1), lambda x: {_plain("x")}), e'\n') AS notes,
  length({_plain(_section("wikitext", "Long Summary"))}) >= 300 AS complete, length({_plain(_section("wikitext", "Long Summary"))}) AS size FROM pages""",
    "parse_characters": f"{_PAGES}, {_LINES} SELECT * FROM chars",
    "parse_groups": f"{_PAGES}, {_LINES} SELECT * FROM groups",
    "name_tokens": r"SELECT DISTINCT entry_id, unnest(regexp_extract_all(lower(canonical_name), '[\p{L}\p{N}_]+')) AS token FROM canon_list",
    "word_count": f"SELECT doc_id, {_WORDS} AS words FROM (SELECT DISTINCT doc_id, text AS x FROM documents WHERE text IS NOT NULL)",
    "dataset_names": """SELECT entry_id, array_to_string(list_sort(list_distinct(CASE entity_type WHEN 'Character' THEN [n, n || ' (x)'] ELSE [n, trim(regexp_replace(n, '\\s*\\([^)]*\\)\\s*$', ''))] END)), '|') AS names, CASE WHEN entity_type IN ('Character', 'Place') THEN entity_type ELSE '' END AS epithets
FROM (SELECT *, trim(canonical_name) AS n FROM canon_list)""",
    "resolve_english": f"WITH {_ENGLISH} SELECT english, canonical_name FROM eng",
    "resolve_all": _FACTS + f""", {_ENGLISH},
r AS (SELECT redirect, min(canonical_name) AS t FROM redirects WHERE canonical_name IS NOT NULL AND redirect IS NOT NULL GROUP BY 1),
items AS (SELECT mention_id AS id, 'm' AS kind, canonical_name, alias, chapter FROM f UNION ALL SELECT DISTINCT redirect_id, 'r', redirect, NULL, 1 FROM redirects WHERE redirect IS NOT NULL
  UNION ALL SELECT entry_id, 'e', 'The ' || trim(canonical_name) || ' fruit', 'Fruit', 1 FROM canon_list WHERE entity_type = 'Devil Fruit'),
a AS (SELECT id, kind, chapter, coalesce(t, items.canonical_name) AS n, CASE WHEN t IS NOT NULL THEN coalesce(alias, items.canonical_name) ELSE alias END AS alias FROM items LEFT JOIN r ON redirect = items.canonical_name),
b AS (SELECT id, kind, chapter, coalesce(eng.canonical_name, n) AS n, alias FROM a LEFT JOIN eng ON english = n)
SELECT id, kind, CASE WHEN chapter < until THEN b.alias ELSE n END AS canonical_name, CASE WHEN chapter < until THEN NULL ELSE b.alias END AS alias FROM b LEFT JOIN masks ON masks.canonical_name = n AND masks.alias = b.alias""",
    "disguise_candidates": rf"""{_LINKS}, {_LINES}, tx AS (SELECT number, unnest([{_section("wikitext", "Long Summary")}, {_section("wikitext", "Characters")}, {_section("wikitext", "Chapter Notes")}]) AS text FROM pages),
src AS (SELECT number AS chapter, unnest(regexp_extract_all(text, {_LINK}, 1)) AS target, unnest(regexp_extract_all(text, {_LINK}, 2)) AS label FROM tx UNION ALL SELECT number, name, NULL FROM chars UNION ALL SELECT number, target, NULL FROM l), {_RESOLVED},
found AS (SELECT chapter, canonical_name, {_alias("label", _COMMON)} AS alias FROM src JOIN targets USING (target) WHERE canonical_name IS NOT NULL AND label IS NOT NULL),
folk AS (SELECT DISTINCT canonical_name FROM chars JOIN targets ON target = name WHERE canonical_name IS NOT NULL)
SELECT alias, canonical_name, count(*) AS link_count, min(chapter) AS first_chapter, max(chapter) AS last_chapter, NULL::INT AS revelation FROM found SEMI JOIN folk USING (canonical_name)
WHERE alias IS NOT NULL AND NOT list_has_any(regexp_extract_all(lower(alias), '[\p{{L}}\p{{N}}_]+'), regexp_extract_all(lower(canonical_name), '[\p{{L}}\p{{N}}_]+')) GROUP BY 1, 2""",
    "parts_of_pages": f"{_MADE}, {_PARTS} SELECT name, kind FROM parts",
    "link_target": f"{_MADE}, src AS (SELECT target FROM l), {_RESOLVED} SELECT * FROM targets WHERE canonical_name IS NOT NULL",
    "link_mentions": rf"""{_SCENES}, l AS (SELECT unnest(regexp_extract_all(wikitext, {_LINK}, 1)) AS target FROM pages),
src AS (SELECT chapter, unnest(regexp_extract_all(text, {_LINK}, 1)) AS target, unnest(regexp_extract_all(text, {_LINK}, 2)) AS label FROM sc), {_RESOLVED}
SELECT chapter, canonical_name, alias, count(*) AS n FROM (SELECT chapter, canonical_name, {_alias("coalesce(label, '')", _COMMON)} AS alias FROM src JOIN targets USING (target) WHERE canonical_name IS NOT NULL) GROUP BY ALL""",
    "cast": rf"""{_LINKS}, {_LINES}, src AS (SELECT number AS chapter, name AS target, label, on_panel, annotations, false AS grouped FROM chars UNION ALL SELECT number, faction, NULL, false, '', true FROM groups), {_RESOLVED}
SELECT chapter, canonical_name, on_panel AND NOT grouped AS appearance, grouped, CASE WHEN NOT grouped THEN {_alias("coalesce(label, '')", "")} END AS alias FROM src JOIN targets USING (target)
WHERE canonical_name IS NOT NULL AND (grouped OR on_panel OR regexp_matches(annotations, 'flashback|cover'))""",
    "category_types": f"{_DIM} SELECT title, t AS entity_type FROM kind",
    "lexicon_types": f"""WITH {_LEX} SELECT name, entity_type FROM lexicon
UNION ALL SELECT DISTINCT e, 'Character' FROM (SELECT split_part(canonical_name, ' ', 1) AS e FROM canon_list WHERE entity_type = 'Character') WHERE e <> '' AND e NOT IN (SELECT name FROM bare)""",
    "keep": f"{_DIM}, {_KEEP} SELECT name, NOT concept AND NOT (NOT saved AND out) AS kept, NOT concept AND NOT saved AND out AS excluded FROM verdict",
    "excluded_names": f"{_DIM}, {_KEEP} SELECT name AS canonical_name, array_to_string(categories, '|') AS categories FROM verdict WHERE NOT concept AND NOT saved AND out",
    "resolve_disguise": _FACTS + " SELECT mention_id, canonical_name, alias FROM kn",
    "resolve_redirect": """WITH r AS (SELECT redirect, min(canonical_name) AS t FROM redirects WHERE canonical_name IS NOT NULL AND redirect IS NOT NULL GROUP BY 1)
SELECT redirect_id, coalesce(t, redirect) AS canonical_name, CASE WHEN t IS NOT NULL THEN redirect END AS alias FROM (SELECT DISTINCT redirect_id, redirect FROM redirects WHERE redirect IS NOT NULL) LEFT JOIN r USING (redirect)""",
    "entity_types": f"""{_DIM}, {_LEX}, o(canonical_name, t) AS (VALUES ('Kestrel Bay','Place'), ('Old Pellam','Character'), ('Harbor Watch','Group')),
n AS (SELECT DISTINCT canonical_name FROM mentions WHERE canonical_name IS NOT NULL AND chapter IS NOT NULL), e AS (SELECT canonical_name, min(catalog) AS catalog FROM registry WHERE catalog IS NOT NULL GROUP BY 1)
SELECT n.canonical_name, CASE WHEN n.canonical_name IN (SELECT alias FROM disguises) THEN 'Character' ELSE coalesce(o.t, l.entity_type, k.t, kc.t, 'Unknown') END AS entity_type
FROM n LEFT JOIN o USING (canonical_name) LEFT JOIN lexicon l ON l.name = n.canonical_name LEFT JOIN kind k ON k.title = n.canonical_name LEFT JOIN e ON e.canonical_name = n.canonical_name LEFT JOIN kind kc ON kc.title = e.catalog""",
    "entry_catalogs": _FACTS + " SELECT canonical_name, min(catalog) AS catalog FROM f WHERE catalog IS NOT NULL GROUP BY 1",
    "pages_without_categories": f"""{_MADE}, src AS (SELECT target FROM l), {_TARGETS}, {_PARTS}
SELECT name FROM parts UNION SELECT canonical_name FROM mentions WHERE canonical_name IS NOT NULL AND chapter IS NOT NULL AND catalog IS NOT NULL EXCEPT SELECT title FROM cats""",
    "alias_first_use": _FACTS + " SELECT * FROM first_use",
    "disguise_alias_date": _FACTS + " SELECT * FROM dated",
    "mention_steps": _FACTS + _STEPS + " SELECT * FROM steps",
    "disguise_merge": _FACTS + """, st AS (SELECT canonical_name, chapter, count(*) AS n FROM kn GROUP BY 1, 2)
SELECT told.canonical_name, revelation AS chapter, sum(n)::BIGINT AS n, min(chapter) AS low, max(chapter) AS high FROM told JOIN st ON st.canonical_name = told.alias GROUP BY 1, 2""",
    "registry": _FACTS + _STEPS + " SELECT * FROM reg",
    "registry_at": _FACTS + _STEPS + " SELECT * FROM reg WHERE valid_from <= 100 AND (valid_to IS NULL OR valid_to >= 100)",
    "aliases_asof": _FACTS + """, st AS (SELECT DISTINCT canonical_name, chapter FROM kn)
SELECT st.canonical_name, chapter AS valid_from, coalesce(string_agg(DISTINCT alias, '|' ORDER BY alias), '') AS aliases FROM st LEFT JOIN dated ON dated.canonical_name = st.canonical_name AND first <= chapter GROUP BY 1, 2""",
    "mention_totals": _FACTS + " SELECT * FROM totals",
    "mentions_by_source": _FACTS + " SELECT s.source, count(f.mention_id) AS mentions FROM (VALUES ('link'), ('alias_match')) s(source) LEFT JOIN f ON f.source = s.source GROUP BY 1",
    "unknown_mention_share": _FACTS + " SELECT round(avg(CASE WHEN entity_type = 'Unknown' THEN 1.0 ELSE 0.0 END), 6) AS share FROM f JOIN kinds USING (canonical_name)",
    "top_entities": _FACTS + " SELECT canonical_name, entity_type, mention_count FROM totals JOIN kinds USING (canonical_name) ORDER BY mention_count DESC, canonical_name LIMIT 50",
    "unknown_entities": _FACTS + " SELECT canonical_name, coalesce(mention_count, 0) AS mention_count FROM kinds LEFT JOIN totals USING (canonical_name) WHERE entity_type = 'Unknown'",
    "recall_proxy": _FACTS + """, arcs AS (SELECT number AS chapter, coalesce(min(arc), 'Unknown') AS arc FROM silver GROUP BY 1),
hits AS (SELECT arc, CASE WHEN m.chapter IS NULL THEN 0.0 ELSE 1.0 END AS met FROM people LEFT JOIN (SELECT DISTINCT canonical_name, chapter FROM f) m USING (canonical_name, chapter) JOIN arcs ON arcs.chapter = people.chapter WHERE appearance)
SELECT arc, round(avg(met), 6) AS recall, count(*) AS appearances FROM hits GROUP BY 1 UNION ALL SELECT NULL, round(avg(met), 6), count(*) FROM hits""",
    "precision_proxy": _FACTS + _MATCHES + " SELECT round(avg(met), 6) AS precision FROM chk",
    "suspicious_aliases": _FACTS + _MATCHES + """ SELECT surface AS alias, canonical_name, count(*) AS matches, count(*) FILTER (WHERE met = 0) AS outside_cast FROM chk GROUP BY 1, 2
HAVING count(*) FILTER (WHERE met = 0) > 0 ORDER BY 4 DESC, count(*) FILTER (WHERE met = 0) / count(*) DESC, 1, 2 LIMIT 20""",
    "validate_rows": rf"""SELECT line_no, unnest(list_filter([CASE WHEN number IS NULL THEN 'missing field ''number''' END, CASE WHEN revid IS NULL THEN 'missing field ''revid''' END, CASE WHEN wikitext IS NULL THEN 'missing field ''wikitext''' END,
CASE WHEN number <= 0 THEN 'field ''number'' should be positive' END, CASE WHEN {_strip("wikitext")} = '' THEN 'field ''wikitext'' is empty' END, CASE WHEN timestamp IS NULL THEN 'missing field ''timestamp''' END,
CASE WHEN NOT regexp_full_match(timestamp, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}Z') THEN 'field ''timestamp'' is not ISO-8601 UTC' END], lambda x: x IS NOT NULL)) AS error FROM chapters""",
    "bronze_duplicates": "SELECT number, count(*) AS lines FROM chapters WHERE number IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "missing_chapters": "SELECT x::INT AS number FROM range(1, (SELECT coalesce(max(number), 0) FROM chapters WHERE number > 0) + 1) t(x) WHERE x NOT IN (SELECT number FROM silver WHERE number IS NOT NULL)",
    "word_stats": f"""WITH w AS (SELECT {_WORDS} AS words FROM (SELECT DISTINCT number, long_summary AS x FROM silver WHERE long_summary IS NOT NULL))
SELECT min(words) AS least, list_sort(list(words))[len(list(words)) // 2 + 1] AS median, max(words) AS most FROM w""",
}
ORACLES["validate_bronze"] = rf"""WITH x AS (SELECT *, line_no % 8 AS k FROM chapters),
e AS (SELECT line_no, CASE k WHEN 3 THEN ['expected a JSON object, got list'] WHEN 4 THEN ['expected a JSON object, got text'] ELSE list_filter([
  CASE WHEN number IS NULL THEN CASE WHEN k = 2 THEN 'field ''number'' should be int, got NoneType' ELSE 'missing field ''number''' END WHEN k = 1 THEN 'field ''number'' should be int, got str' END,
  CASE WHEN revid IS NULL THEN CASE WHEN k = 2 THEN 'field ''revid'' should be int, got NoneType' ELSE 'missing field ''revid''' END WHEN k = 5 THEN 'field ''revid'' should be int, got bool' END,
  CASE WHEN wikitext IS NULL THEN CASE WHEN k = 2 THEN 'field ''wikitext'' should be str, got NoneType' ELSE 'missing field ''wikitext''' END WHEN k = 6 THEN 'field ''wikitext'' should be str, got float' END,
  CASE WHEN number <= 0 AND k <> 1 THEN 'field ''number'' should be positive, got ' || number END,
  CASE WHEN {_strip("wikitext")} = '' AND k <> 6 THEN 'field ''wikitext'' is empty' END,
  CASE WHEN timestamp IS NULL THEN CASE WHEN k = 2 THEN 'field ''timestamp'' is not ISO-8601 UTC, got None' ELSE 'missing field ''timestamp''' END
    WHEN k = 7 THEN 'field ''timestamp'' is not ISO-8601 UTC, got 20260101'
    WHEN NOT regexp_full_match(timestamp, '\d{{4}}-\d{{2}}-\d{{2}}T\d{{2}}:\d{{2}}:\d{{2}}Z') THEN 'field ''timestamp'' is not ISO-8601 UTC, got ''' || timestamp || '''' END], lambda y: y IS NOT NULL) END AS errors FROM x)
SELECT line_no, 'line ' || line_no || ': ' || unnest(errors) AS error FROM e"""


def _quoted(x: str) -> str:
    return rf"""'"' || replace(replace(coalesce({x}, ''), '\', '\\'), '"', '\"') || '"'"""


_FILES = rf"""WITH s AS (SELECT *, 'chapter_' || lpad(number::VARCHAR, 4, '0') || '.md' AS file_name, {_strip("coalesce(title, '')")} = '' AS untitled, {_strip("coalesce(arc, '')")} = '' AS homeless,
  len(list_filter(coalesce(characters, []), lambda c: {_strip("coalesce(c.name, '')")} <> '')) = 0 AS alone FROM (SELECT *, row_number() OVER (PARTITION BY number) AS k FROM silver) WHERE k = 1),
checked AS (SELECT file_name, number, concat_ws('; ', CASE WHEN complete IS NOT TRUE THEN 'complete is not true' END, CASE WHEN words = 0 THEN 'Long Summary empty' END) AS problems, words FROM (
  SELECT *, CASE WHEN coalesce(long_summary, '') = '' THEN 1 ELSE len(list_filter(regexp_split_to_array({_strip(r"regexp_replace(long_summary, '(?m)^## .+$[\s\S]*', '')")}, '{_B}+'), lambda y: y <> '')) END::BIGINT AS words FROM s))"""
_HEAD = f"""concat_ws(e'\\n', '---', 'chapter: ' || number, 'title: ' || {_quoted("title")}, 'jname: ' || {_quoted("jname")}, 'arc: ' || {_quoted("arc")}, 'revision_id: ' || coalesce(revision_id::VARCHAR, 'None'),
  'revised_at: ' || {_quoted("revised_at")}, 'complete: ' || coalesce(complete, false), 'character_count: ' || len(coalesce(characters, [])), 'characters:',
  nullif(array_to_string(list_transform(characters, lambda c: concat_ws(e'\\n', '  - name: ' || {_quoted("c.name")}, '    faction: ' || {_quoted("c.faction")}, '    on_panel: ' || coalesce(c.on_panel, false))), e'\\n'), ''))"""

ORACLES |= {
    "render_markdown": rf"""{_FILES}, h AS (SELECT *, {_HEAD} AS head FROM s)
SELECT file_name, head, head || e'\nsource: https://wiki.example/wiki/Chapter_' || number || e'\nlicense: CC BY-SA\n---\n\n' || regexp_replace('# Chapter ' || number || ' — ' || coalesce(title, ''), '[ —]+$', '')
  || e'\n\n## Short Summary\n\n' || coalesce(nullif(short_summary, ''), '_(absent)_') || e'\n\n## Long Summary\n\n' || coalesce(nullif(long_summary, ''), '_(absent)_') || e'\n\n## Chapter Notes\n\n'
  || CASE WHEN len(coalesce(notes, [])) > 0 THEN array_to_string(list_transform(list_filter(notes, lambda n: n IS NOT NULL), lambda n: '- ' || n), e'\n') ELSE '_(absentes)_' END || e'\n' AS value FROM h""",
    "validate_silver": _FILES + """ SELECT file_name, file_name || ': ' || unnest(list_filter([CASE WHEN untitled THEN 'front-matter missing non-empty ''title:'' field' END, CASE WHEN homeless THEN 'front-matter missing non-empty ''arc:'' field' END,
CASE WHEN alone THEN '''characters:'' list has no entries with a non-empty ''name''' END], lambda x: x IS NOT NULL)) AS error FROM s""",
    "check_files": _FILES + " SELECT file_name, number, problems, words FROM checked",
    "gate": _FILES + """, c AS (SELECT count(*) AS files, count(*) FILTER (WHERE problems <> '') AS failing FROM checked), n AS (SELECT coalesce(max(number), 0) AS n FROM chapters WHERE number > 0),
g AS (SELECT count(*) AS missing FROM range(1, (SELECT n FROM n) + 1) t(x) WHERE x NOT IN (SELECT number FROM silver WHERE number IS NOT NULL))
SELECT files, missing, failing, files = n AND missing = 0 AND failing = 0 AS ok FROM c, g, n""",
}

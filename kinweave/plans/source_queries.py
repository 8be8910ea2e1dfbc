"""Extraction from files and pages, index tables, dictionary matches, routing, the qualification ladder, names and shapes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators import graph, indexes, matching
from kinweave.plans.archive_queries import ACTOR, visible_people
from kinweave.plans.kin_queries import names_sql, replaced
from kinweave.plans.registry import archived, query
from kinweave.shared import scratch_path, table
from kinweave.sources import readers
from kinweave.sources.archive import Dialect, relation, run

# The words that decide a question's route, its kind, and what is only noise.
CONTRADICTION_TERMS = ("والد", "أبو", "ابو", "father", "والدة", "mother", "تناقض", "تعارض", "contradiction", "conflict")
DEEP_TERMS = ("تحقق", "تحقيق", "قارن", "مقارنة", "تناقض", "تعارض", "تتبع", "اثبات", "إثبات", "اصل", "مسار", "بحث", "investigate", "compare", "contradiction", "trace", "prove", "explain")
NOISE = ("مرحبا", "السلام عليكم", "شكرا", "شكرا لكم", "كيف حالك", "spam", "اعلان")
KIND_TERMS = {
    "relationship": ("والد", "والدة", "ابو", "أبو", "ابن", "بنت", "زوج", "قرابة", "نسب", "علاقة", "تناقض", "تعارض", "رواية", "روايات", "father", "parent", "family"),
    "source_evidence": ("مصدر", "دليل", "نص", "صفحة", "سجل", "مرجع", "اقتباس", "source", "evidence", "document", "record"),
    "identity": ("هوية", "شخص", "اسم", "لقب", "اسماء", "alias", "identity", "person"),
    "geography": ("مكان", "مدينة", "قرية", "هاجر", "هجرة", "مسار", "جغراف", "place", "location"),
}
# Words that make a sentence a claim, and words that make a quotation one of lineage.
RELATION_TERMS = ("والد", "أبو", "ابو", "ابن", "بنت", "زوج", "أخ", "أخت", "ينتمي", "هاجر", "سكن", "يقول")
LINEAGE_MARKERS = ("ابن", "ابنة", "أبناء", "أبنائه", "أبيه", "أبوه", "والده", "والد", "والدة", "بنت", "بن", "ولد", "أمه", "أمها", "أم", "أخوه", "أخته", "أخ", "شقيق", "زوجته", "زوجة", "تزوج", "ذرية", "عقب", "نسل")

ASKED = ("", "مرحبا", "spam", "who is the father of Salim?", "compare both records of the place", "which document is the source of this record", "an alias of that person", "هل يوجد تعارض بين الروايات؟", "أين المكان والمدينة", "show me the place", "trace the family of this person in the record", "معنى اسم هذا الشخص")


def values(d: Dialect, items: tuple[str, ...], name: str = "x") -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(items)) + f") AS v(id, {name}))"


def routing_form(d: Dialect, x: str) -> str:
    ranges = "[\\x{064B}-\\x{065F}\\x{0670}\\x{06D6}-\\x{06ED}]"
    return f"trim({replaced(d, f'lower(translate({replaced(d, x, ranges, "")}, {chr(39)}أإآٱىة{chr(39)}, {chr(39)}اااايه{chr(39)}))', '[' + chr(92) + 'p{P}' + chr(92) + 's]+', ' ')})"


def folded(term: str) -> str:
    return term.translate(str.maketrans("أإآٱىة", "اااايه"))


def hits(terms: tuple[str, ...], x: str = "t") -> str:
    """How many of the terms the text holds, each folded as the text is."""
    return "(" + " + ".join(f"CASE WHEN contains({x}, '{folded(w)}') THEN 1 ELSE 0 END" for w in terms) + ")"


def routes(d: Dialect) -> str:
    kinds = " ".join(f"WHEN {k} > 0 AND {k} = best THEN '{k}'" for k in KIND_TERMS)
    scores = ", ".join(f"{hits(terms)} AS {k}" for k, terms in KIND_TERMS.items())
    return f"""q AS (SELECT id, sources, {routing_form(d, 'x')} AS t FROM (SELECT id, x, id % 3 AS sources FROM {values(d, ASKED)} AS a UNION ALL SELECT question_id + 1000, title, 0 FROM questions) AS q0),
    s AS (SELECT q.*, {scores}, {hits(CONTRADICTION_TERMS)} > 0 AS contradiction, {hits(DEEP_TERMS)} > 0 AS deep FROM q),
    k AS (SELECT *, CASE {kinds} ELSE 'general' END AS query_type FROM (SELECT s.*, greatest({', '.join(KIND_TERMS)}) AS best FROM s) AS b),
    r AS (SELECT id, sources, query_type, contradiction, CASE WHEN t = '' OR (sources = 0 AND t IN ({', '.join(repr(folded(n)) for n in NOISE)})) THEN 'ignore/noise/0.05' WHEN contradiction THEN 'deep/contradiction_signal/0.9' WHEN deep THEN 'deep/multi_step/0.86'
      WHEN sources >= 2 AND query_type IN ('relationship', 'identity') THEN 'deep/multi_step/0.8' WHEN sources > 0 THEN 'cheap/source_context/0.7' ELSE 'cheap/simple_lookup/0.58' END AS d FROM k)"""


@archived
def routing_decisions(d: Dialect) -> str:
    """Ordered rules: noise, contradiction, words that need many steps, many sources about people, any source, else a look-up."""
    part = lambda i: d.pick(f"split(d, '/')[{i}]", f"split_part(d, '/', {i + 1})")
    return f", {routes(d)} SELECT id, query_type, {part(0)} AS route, {part(1)} AS reason_code, CAST({part(2)} AS DOUBLE) AS score, {part(0)} = 'deep' OR contradiction OR sources >= 2 AS go_on FROM r"


SENTENCES = ("قال الراوي: سكن أحمد القرية. ولم يذكر غيرها! والد علي هو حسن", "سالم ابن خالد، وهو من أهل المدينة؟\\nبنت عمه ليلى. لا شيء هنا", "no claim at all. ينتمي سعد إلى القبيلة")


def texts(d: Dialect) -> str:
    parts = ", ".join(f"({i}, '{t.split(chr(92) + 'n')[0]}', '{t.split(chr(92) + 'n')[1] if chr(92) + 'n' in t else ''}')" for i, t in enumerate(SENTENCES))
    return f"(SELECT id, CASE WHEN b = '' THEN a ELSE a || chr(10) || b END AS x FROM (VALUES {parts}) AS v(id, a, b) UNION ALL SELECT passage_id + 100, body FROM passages WHERE passage_id % 50 = 0)"


@archived
def claim_sentences(d: Dialect) -> str:
    """Sentences with a word of relation, cut at the first of the words in their order: who, what, whom; a hundred characters where nobody stands before it."""
    found = d.pick("explode(regexp_extract_all(x, '[^.!?\\\\n]+[.!?]?', 0))", "unnest(regexp_extract_all(x, '[^.!?\\n]+[.!?]?'))")
    term = "CASE " + " ".join(f"WHEN contains(s, '{t}') THEN '{t}'" for t in RELATION_TERMS) + " END"
    trim = lambda x: d.pick(f"trim(BOTH ' ،,.؟?' FROM {x})", f"trim({x}, ' ،,.؟?')")
    return f""", s AS (SELECT id, trim({replaced(d, 'y', chr(92) + 's+', ' ')}) AS s FROM (SELECT id, {found} AS y FROM {texts(d)} AS t) AS u), p AS (SELECT id, s, {term} AS predicate FROM s),
    c AS (SELECT id, s, predicate, {trim('substr(s, 1, instr(s, predicate) - 1)')} AS subject, {trim('substr(s, instr(s, predicate) + length(predicate))')} AS object FROM p WHERE predicate IS NOT NULL)
    SELECT id, s AS sentence, substr(CASE WHEN subject = '' THEN substr(s, 1, 100) ELSE subject END, 1, 500) AS subject, predicate, CASE WHEN object <> '' THEN substr(object, 1, 500) END AS object FROM c"""


@archived
def lineage_quotes(d: Dialect) -> str:
    """Stretches between marks that hold a word of lineage as a whole word, at most 800 characters, with their places in the text; thirty a text."""
    pieces = d.pick("split(x, '[\\\\n\\\\r,.،!?؟؛]')", "regexp_split_to_array(x, '[\\n\\r,.،!?؟؛]')")
    size = lambda a: d.pick(f"aggregate(transform({a}, w -> length(w) + 1), 0, (s, v) -> s + v)", f"coalesce(list_sum(list_transform({a}, lambda w: len(w) + 1)), 0)")
    at = d.pick(f"transform(p, (w, i) -> named_struct('w', w, 'b', {size('slice(p, 1, i)')}))", f"list_transform(range(1, len(p) + 1), lambda i: {{'w': p[i], 'b': {size('p[1:i-1]')}}})")
    word = "(^|[^\\p{L}\\p{N}])(" + "|".join(LINEAGE_MARKERS) + ")($|[^\\p{L}\\p{N}])"
    holds = d.pick(f"w RLIKE '{word.replace(chr(92), chr(92) * 2)}'", f"regexp_matches(w, '{word}')")
    left = d.pick("regexp_replace(w, '^\\\\s+', '')", "regexp_replace(w, '^\\s+', '')")
    return f""", t AS (SELECT id, {pieces} AS p FROM {texts(d)} AS x0), e AS (SELECT id, {d.explode(at)} AS z FROM t), f AS (SELECT id, z.w AS w, z.b AS b FROM e),
    g AS (SELECT id, b + length(w) - length({left}) AS start, {replaced(d, replaced(d, 'w', '^' + chr(92) + 's+', ''), chr(92) + 's+$', '')} AS quote FROM f WHERE {holds}),
    h AS (SELECT id, start, start + length(quote) AS stop, quote, row_number() OVER (PARTITION BY id ORDER BY start) AS n FROM g WHERE length(quote) BETWEEN 1 AND 800)
    SELECT id, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop, quote FROM h WHERE n <= 30"""


GAZETTEER = "gaz AS (SELECT CAST(item_id AS BIGINT) AS place_id, {word} AS key, item_id % 4 = 0 AS historical FROM benchmark)"


@archived
def place_mentions(d: Dialect) -> str:
    """Places of a dictionary that a statement names: resolved where one place bears the name, unresolved where several do.

    Names have four letters at least, and a text meets those whose first four letters it holds; whether it holds the rest is looked at then.
    """
    word = d.pick("lower(split(text, ' ')[2])", "lower(split_part(text, ' ', 3))")
    cut = d.pick("explode(array_distinct(transform(sequence(1, length(x) - 3), i -> substr(x, i, 4))))", "unnest(list_distinct(list_transform(range(1, len(x) - 2), lambda i: substr(x, i, 4))))")
    return f""", {GAZETTEER.format(word=word)}, names AS (SELECT DISTINCT place_id, key FROM gaz WHERE length(trim(key)) >= 4),
    t AS (SELECT statement_id, source_id, lower(body) AS x FROM statements WHERE length(body) >= 4), g AS (SELECT statement_id, source_id, x, {cut} AS head FROM t),
    m AS (SELECT DISTINCT g.statement_id, g.source_id, n.key, n.place_id FROM g JOIN names n ON substr(n.key, 1, 4) = g.head WHERE contains(g.x, n.key))
    SELECT statement_id, source_id, key AS mention, count(DISTINCT place_id) AS candidates, CASE WHEN count(DISTINCT place_id) = 1 THEN 'resolved' ELSE 'unresolved' END AS resolution, CASE WHEN count(DISTINCT place_id) = 1 THEN min(place_id) END AS place_id FROM m GROUP BY statement_id, source_id, key"""


SKELETON = ("اأإآٱبتثنيىئجحخدذرزسشصضطظعغفقكلمهةوؤء", "اااااٮٮٮٮٮٮٮحححددررسسصصططععففكلمههووء")


@archived
def name_match_ladder(d: Dialect) -> str:
    """A name typed against all names: by the key itself, without spaces, without particles, by beginnings, by parts, by few edits, by outline; the first that holds."""
    q = "احمد بن علي"
    fold = lambda x: f"trim({replaced(d, f'translate({replaced(d, x, chr(91) + chr(92) + "p{Mn}ـ]", "")}, {chr(39)}أإآٱىة٠١٢٣٤٥٦٧٨٩{chr(39)}, {chr(39)}اااايه0123456789{chr(39)})', chr(92) + 's+', ' ')})"
    particle = lambda x: replaced(d, replaced(d, f"{x}", "^((ال|بن|بنت|ابو) ){0,2}", "") if False else d.pick(f"regexp_replace({x}, '^((ال|بن|بنت|ابو) ){{1,2}}', '')", f"regexp_replace({x}, '^((ال|بن|بنت|ابو) ){{1,2}}', '')"), "^ال(.)", d.pick("$1", "\\1"))
    within = lambda a, b, n: f"abs(length({a}) - length({b})) <= {n}"
    start = d.pick("startswith", "starts_with")
    words = d.pick(f"exists(split(c, ' '), w -> startswith(w, qc))", "len(list_filter(string_split(c, ' '), lambda w: starts_with(w, qc))) > 0")
    less = lambda n, x: f"{n} - least(20, greatest(0, {x}))"
    return f""", n AS (SELECT id, name, {fold('name')} AS c FROM {names_sql(d)} AS n0 UNION ALL SELECT 100 + id, 'احمد', 'احمد' FROM {names_sql(d)} AS n1 WHERE id = 0 UNION ALL SELECT 200, 'أحمد بن على بن سالم', {fold("'أحمد بن على بن سالم'")} UNION ALL SELECT 201, 'أحمدبن علي', 'احمدبن علي' UNION ALL SELECT 202, 'أحمد بن غلي', 'احمد بن غلي' UNION ALL SELECT 203, 'بن أحمد بن علي', 'بن احمد بن علي' UNION ALL SELECT 204, 'آخمد بن غلي', 'اخمد بن غلي'),
    k AS (SELECT id, name, c, replace(replace(c, ' ', ''), '-', '') AS m, {particle('c')} AS p, translate(c, '{SKELETON[0]}', '{SKELETON[1]}') AS s, '{q}' AS qc, replace('{q}', ' ', '') AS qm, {particle(f"'{q}'")} AS qp, translate('{q}', '{SKELETON[0]}', '{SKELETON[1]}') AS qs FROM n),
    r AS (SELECT id, name, CASE WHEN c = qc THEN 100 WHEN m = qm THEN 96 WHEN p = qp THEN 94 WHEN {start}(c, qc) THEN {less(92, 'length(c) - length(qc)')} WHEN {start}(m, qm) THEN {less(90, 'length(m) - length(qm)')} WHEN {start}(p, qp) THEN {less(88, 'length(p) - length(qp)')} WHEN {words} THEN {less(85, 'length(c) - length(qc)')}
      WHEN contains(c, qc) THEN {less(72, 'instr(c, qc) - 1')} WHEN contains(m, qm) THEN {less(70, 'instr(m, qm) - 1')} WHEN contains(p, qp) THEN {less(68, 'instr(p, qp) - 1')} WHEN {within('qc', 'c', 2)} AND levenshtein(qc, c) <= 2 THEN 66 - 8 * levenshtein(qc, c) WHEN {within('qm', 'm', 2)} AND levenshtein(qm, m) <= 2 THEN 60 - 8 * levenshtein(qm, m)
      WHEN {within('qs', 's', 1)} AND qs = s THEN 58 WHEN {within('qs', 's', 1)} AND levenshtein(qs, s) <= 1 THEN 48 END AS score FROM k)
    SELECT id, name, CAST(score AS INT) AS score FROM r WHERE score IS NOT NULL"""


@archived
def temporal_exclusions(d: Dialect) -> str:
    """Why a published parent edge can't speak about ages: the first of nine reasons, or that it can; then one row a parent and child, the best first."""
    return f""", dep AS (SELECT source_id FROM dependencies WHERE status IN ('needs_review', 'confirmed') UNION SELECT depends_on FROM dependencies WHERE status IN ('needs_review', 'confirmed')),
    cl AS (SELECT k.child_id, k.parent_id, min(k.claim_id) AS claim_id FROM (SELECT subject_id AS child_id, object_id AS parent_id, claim_id FROM claims WHERE status = 'supported') AS k GROUP BY k.child_id, k.parent_id),
    ok AS (SELECT DISTINCT e.claim_id FROM evidence e JOIN statements s ON s.statement_id = e.statement_id WHERE s.review_status = 'accepted'), ce AS (SELECT DISTINCT claim_id FROM counter_evidence),
    x AS (SELECT e.edge_id, e.parent_id, e.child_id, c.claim_id, CASE WHEN p.identity_status = 'draft' AND p.person_id % 2 = 0 OR q.identity_status = 'draft' AND q.person_id % 4 = 0 THEN 'unreviewed_identity' WHEN e.source_id IS NULL THEN 'missing_source' WHEN s.visibility <> 'public' THEN 'private_source' WHEN s.dependency_status <> 'independent' OR dep.source_id IS NOT NULL AND e.edge_id % 3 = 0 THEN 'dependent_source' WHEN c.claim_id IS NULL AND e.edge_id % 2 = 0 THEN 'missing_claim'
        WHEN ok.claim_id IS NULL AND e.edge_id % 5 = 0 THEN 'unaccepted_evidence' WHEN ce.claim_id IS NOT NULL THEN 'counter_evidence'
        WHEN p.birth_from IS NULL OR p.birth_to IS NULL OR q.birth_from IS NULL OR q.birth_to IS NULL OR p.birth_from > p.birth_to OR q.birth_from > q.birth_to OR p.birth_from > q.birth_to OR (p.death_from IS NOT NULL AND p.death_to IS NOT NULL AND p.death_from > p.death_to) THEN 'invalid_dates' WHEN p.death_to IS NOT NULL AND p.death_to < q.birth_from THEN 'invalid_chronology' ELSE 'qualified' END AS reason
      FROM edges e JOIN versions v ON v.version_id = e.version_id AND v.state = 'published' JOIN people p ON p.person_id = e.parent_id JOIN people q ON q.person_id = e.child_id LEFT JOIN sources s ON s.source_id = e.source_id LEFT JOIN dep ON dep.source_id = e.source_id LEFT JOIN cl c ON c.child_id = e.child_id AND c.parent_id = e.parent_id LEFT JOIN ok ON ok.claim_id = c.claim_id LEFT JOIN ce ON ce.claim_id = c.claim_id WHERE e.predicate = 'parent_of'),
    one AS (SELECT reason FROM (SELECT x.*, row_number() OVER (PARTITION BY parent_id, child_id ORDER BY CASE WHEN reason = 'qualified' THEN 0 ELSE 1 END, edge_id) AS n FROM x) AS y WHERE n = 1)
    SELECT reason, count(*) AS n FROM one GROUP BY reason"""


@archived
def spelling_lexicon(d: Dialect) -> str:
    """The latest decision of each item; spellings that were accepted or corrected, grouped by their key: the commonest first, then by bytes, eight at most."""
    ranked = "row_number() OVER (PARTITION BY key ORDER BY n DESC, spelling)"
    first = d.pick("array_join(transform(sort_array(collect_list(named_struct('r', r, 's', spelling))), e -> e.s), '|')", "string_agg(spelling, '|' ORDER BY r)")
    return f""", dec AS (SELECT o_orderkey AS id, o_custkey AS item, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'corrected' ELSE 'rejected' END AS decision, trim(CASE WHEN o_orderkey % 3 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END || CASE WHEN o_orderkey % 5 = 0 THEN '  ' ELSE '' END) AS spelling, o_orderdate AS made FROM orders),
    latest AS (SELECT * FROM (SELECT dec.*, row_number() OVER (PARTITION BY item ORDER BY made DESC, id DESC) AS n FROM dec) AS x WHERE n = 1), sp AS (SELECT spelling, lower(spelling) AS key, count(*) AS n FROM latest WHERE decision IN ('accepted', 'corrected') AND spelling <> '' GROUP BY spelling),
    g AS (SELECT sp.*, {ranked} AS r, CAST(sum(n) OVER () AS BIGINT) AS total FROM sp) SELECT key, CAST(sum(n) AS BIGINT) AS occurrences, max(total) AS total, {first} AS variants FROM g WHERE r <= 8 GROUP BY key"""


@archived
def dictionary_index(d: Dialect) -> str:
    """Eight kinds of entry with an alias and how often each is spoken of, each under its policy."""
    return f""", al AS (SELECT person_id, min(value) AS value FROM aliases GROUP BY person_id), asso AS (SELECT entity_type, entity_id, count(*) AS n FROM associations GROUP BY entity_type, entity_id), per AS (SELECT place_id, count(*) AS n FROM associations GROUP BY place_id), hn AS (SELECT place_id, min(name) AS value FROM place_names GROUP BY place_id),
    passes AS (SELECT source_id, count(*) AS n FROM passages GROUP BY source_id), cl AS (SELECT subject_id, count(*) AS n FROM claims GROUP BY subject_id)
    SELECT 'person' AS kind, CAST(p.person_id AS STRING) AS id, p.name, al.value AS alias, coalesce(cl.n, 0) AS n FROM people p LEFT JOIN al ON al.person_id = p.person_id LEFT JOIN cl ON cl.subject_id = p.person_id WHERE p.person_id IN (SELECT person_id FROM {visible_people(ACTOR)} AS vp)
    UNION ALL SELECT 'family', CAST(family_id AS STRING), name, alias, coalesce(a.n, 0) FROM families f LEFT JOIN asso a ON a.entity_type = 'family' AND a.entity_id = f.family_id WHERE visibility = 'public'
    UNION ALL SELECT 'tribe', CAST(tribe_id AS STRING), name, alias, coalesce(a.n, 0) FROM tribes t LEFT JOIN asso a ON a.entity_type = 'tribe' AND a.entity_id = t.tribe_id WHERE visibility = 'public'
    UNION ALL SELECT 'branch', CAST(branch_id AS STRING), name, NULL, coalesce(a.n, 0) FROM branches b LEFT JOIN asso a ON a.entity_type = 'branch' AND a.entity_id = b.branch_id WHERE visibility = 'public'
    UNION ALL SELECT 'place', CAST(p.place_id AS STRING), p.name, hn.value, coalesce(per.n, 0) FROM places p LEFT JOIN hn ON hn.place_id = p.place_id LEFT JOIN per ON per.place_id = p.place_id WHERE p.visibility = 'public'
    UNION ALL SELECT 'historical_name', CAST(place_id AS STRING), name, NULL, 1 FROM place_names
    UNION ALL SELECT 'source', s.source_id, s.title, s.author, coalesce(ps.n, 0) FROM sources s LEFT JOIN passes ps ON ps.source_id = s.source_id WHERE s.visibility = 'public'
    UNION ALL SELECT 'tree', CAST(t.tree_id AS STRING), t.name, NULL, (SELECT count(*) FROM versions) FROM trees t WHERE t.visibility = 'public'"""


@archived
def place_geometry(d: Dialect) -> str:
    """Regions as outlines: signed area and centroid by the sum over their edges, and the distance from the centroid to the place itself."""
    corners = "(VALUES (0, 0.0e0, 0.0e0), (1, 2.0e0, 0.0e0), (2, 2.5e0, 1.0e0), (3, 0.5e0, 2.0e0)) AS c(n, dx, dy)"
    return f""", v AS (SELECT p.place_id, p.lat, p.lon, c.n, p.lon + c.dx * (1 + p.place_id % 3) AS x, p.lat + c.dy AS y FROM places p CROSS JOIN {corners} WHERE p.lat IS NOT NULL),
    e AS (SELECT a.place_id, a.lat, a.lon, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM v a JOIN v b ON b.place_id = a.place_id AND b.n = (a.n + 1) % 4),
    s AS (SELECT place_id, min(lat) AS lat, min(lon) AS lon, sum(x1 * y2 - x2 * y1) / 2 AS area, sum((x1 + x2) * (x1 * y2 - x2 * y1)) AS mx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) AS my FROM e GROUP BY place_id),
    g AS (SELECT place_id, lat, lon, area, mx / (6 * area) AS cx, my / (6 * area) AS cy FROM s)
    SELECT place_id, round(area, 6) AS area, round(cx, 6) AS lon, round(cy, 6) AS lat, round({d.haversine('lat', 'lon', 'cy', 'cx')}, 3) AS km FROM g"""


@archived
def json_elements(d: Dialect) -> str:
    """Elements of a JSON array with their place, each read by path."""
    made = "'[' || " + " || ',' || ".join(f"'{{\"id\": ' || (p_partkey * 3 + {i}) || ', \"w\": {{\"size\": ' || (p_size + {i}) || '}}}}'" for i in range(3)) + " || ']'"
    one = d.pick("posexplode(from_json(j, 'array<struct<id:bigint,w:struct<size:int>>>'))", "")
    if d.spark:
        return f" SELECT p_partkey AS id, pos + 1 AS nth, col.id AS element, col.w.size AS size FROM (SELECT p_partkey, {one} FROM (SELECT p_partkey, {made} AS j FROM part) AS a) AS b"
    return f" SELECT p_partkey AS id, CAST(i + 1 AS INT) AS nth, CAST(j->i->>'id' AS BIGINT) AS element, CAST(j->i->'w'->>'size' AS INT) AS size FROM (SELECT p_partkey, CAST({made} AS JSON) AS j, unnest(range(3)) AS i FROM part)"


@archived
def metric_lines(d: Dialect) -> str:
    """Cumulative buckets as lines that a scraper reads."""
    edges = (10, 25, 50, 100, 1000)
    counted = " UNION ALL ".join(f"SELECT event_type, '{e}' AS le, count(*) FILTER (WHERE value <= {e}) AS n FROM events GROUP BY event_type" for e in edges)
    return f""" SELECT 'value_bucket{{kind="' || event_type || '",le="' || le || '"}} ' || n AS line FROM ({counted} UNION ALL SELECT event_type, '+Inf', count(*) FROM events GROUP BY event_type) AS b"""


@archived
def extracted_pages(d: Dialect) -> str:
    """Uploads as pages: line ends are made one, form feeds part pages, windows of 3500 characters are trimmed, empty ones go."""
    strip = replaced(d, replaced(d, "substr(p, s + 1, 3500)", "^\\s+", ""), "\\s+$", "")
    pages = d.pick("posexplode(split(t, '\\\\f'))", "")
    cut = f", raw AS (SELECT passage_id, replace(replace(substr(body, 1, 4000) || chr(13) || chr(10) || 'end' || chr(13) || chr(12) || '  ' || chr(12) || substr(body, 1, 60), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM passages)"
    if d.spark:
        parts = f"SELECT passage_id, pos + 1 AS page, col AS p FROM (SELECT passage_id, {pages} FROM raw) AS a"
        windows = "SELECT passage_id, page, p, explode(sequence(0, greatest(length(p), 1) - 1, 3500)) AS s FROM parts"
    else:
        parts = "SELECT passage_id, i + 1 AS page, string_split(t, chr(12))[i + 1] AS p FROM (SELECT passage_id, t, unnest(range(len(string_split(t, chr(12))))) AS i FROM raw)"
        windows = "SELECT passage_id, page, p, unnest(range(0, greatest(len(p), 1), 3500)) AS s FROM parts"
    return f"{cut}, parts AS ({parts}), win AS ({windows}), x AS (SELECT passage_id, page, s, length(p) AS n, {strip} AS segment FROM win) SELECT passage_id, CAST(page AS INT) AS page, CAST(s AS INT) AS start, CAST(least(s + 3500, n) AS INT) AS stop, {d.pick('sha2(segment, 256)', 'sha256(segment)')} AS digest FROM x WHERE segment <> ''"


@archived
def pdf_words(d: Dialect) -> str:
    """Words with their boxes from a page of layout markup, as shares of the page; entities are read."""
    word = lambda i, dx: f"'<word xMin=\"' || ({dx} + p_size) || '\" yMin=\"20.5\" xMax=\"' || ({dx} + p_size + 30) || '\" yMax=\"32.5\">' || {i} || '</word>'"
    markup = f"'<page width=\"400\" height=\"800\"><line>' || {word('p_name', 10)} || '</line><line>' || {word(repr('a &amp; b'), 60)} || {word('p_brand', 120)} || '</line></page>'"
    tag = '<word xMin="([0-9.]+)" yMin="([0-9.]+)" xMax="([0-9.]+)" yMax="([0-9.]+)">([^<]*)</word>'
    all_of = lambda g: f"regexp_extract_all(m, '{tag}', {g})"
    if d.spark:
        rows = f"SELECT id, pos AS i, col AS x1, {all_of(2)}[pos] AS y1, {all_of(3)}[pos] AS x2, {all_of(4)}[pos] AS y2, {all_of(5)}[pos] AS t FROM (SELECT id, m, posexplode({all_of(1)}) FROM src) AS a"
    else:
        rows = f"SELECT id, i, {all_of(1)}[i + 1] AS x1, {all_of(2)}[i + 1] AS y1, {all_of(3)}[i + 1] AS x2, {all_of(4)}[i + 1] AS y2, {all_of(5)}[i + 1] AS t FROM (SELECT id, m, unnest(range(len({all_of(1)}))) AS i FROM src)"
    num = lambda x, of: f"round(CAST({x} AS DOUBLE) / {of}, 6)"
    return f", src AS (SELECT p_partkey AS id, {markup} AS m FROM part), w AS ({rows}) SELECT id, CAST(i AS INT) AS nth, replace(replace(t, '&lt;', '<'), '&amp;', '&') AS text, {num('x1', 400)} AS x, {num('y1', 800)} AS y, round((CAST(x2 AS DOUBLE) - CAST(x1 AS DOUBLE)) / 400, 6) AS w, round((CAST(y2 AS DOUBLE) - CAST(y1 AS DOUBLE)) / 800, 6) AS h FROM w WHERE trim(t) <> ''"


@query("ocr_word_file", "SELECT CAST(p_partkey // 80 AS INT) AS page_num, '1.1.' || p_partkey % 9 AS line, CAST(p_partkey % 80 AS INT) AS word_num, p_name AS text, CAST(p_size AS DOUBLE) AS conf, CAST(p_size AS INT) AS \"left\", CAST(p_partkey % 100 AS INT) AS top, CAST(p_size + 40 AS INT) AS \"right\", CAST(p_partkey % 100 + 12 AS INT) AS bottom FROM part WHERE p_size >= 10")
def ocr_word_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An engine's tab-separated words, written to a file and read back: words of some confidence with their boxes; other levels and blanks go."""
    p = table(spark, sf_dir, "part")
    line = lambda level, text: p.selectExpr(f"{level} AS level", "CAST(floor(p_partkey / 80) AS INT) AS page_num", "1 AS block_num", "1 AS par_num", "p_partkey % 9 AS line_num", "p_partkey % 80 AS word_num", "p_size AS left", "p_partkey % 100 AS top", "40 AS width", "12 AS height", "p_size AS conf", f"{text} AS text")
    path = scratch_path(spark, "ocr")
    line(5, "p_name").union(line(4, "''")).union(line(5, "' '")).write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreTrailingWhiteSpace", False).csv(path)
    return readers.ocr_words(spark, path, 10)


@query("labelled_case_file", "SELECT CAST(item_id AS VARCHAR) AS id, substr(text, 1, 20) AS query, CAST(1 AS INT) AS relevant, CAST(2 AS INT) AS documents FROM benchmark")
def labelled_case_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled cases as one JSON object a line, written and read back with their schema."""
    doc = lambda i, good: F.struct(F.concat("item_id", F.lit(f"-{i}")).alias("id"), F.col("text"), F.lit(good).alias("relevant"))
    path = scratch_path(spark, "cases")
    table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.substring("text", 1, 20).alias("query"), F.array(doc(0, True), doc(1, False)).alias("documents")).write.json(path)
    cases = readers.jsonl(spark, path, readers.RETRIEVAL_CASE)
    return cases.select("id", "query", F.size(F.filter("documents", lambda x: x["relevant"])).alias("relevant"), F.size("documents").alias("documents"))


# index tables


@query("trigram_index_search", """SELECT doc_id AS passage_id FROM documents WHERE contains(lower(text), 'licensed under') AND length(text) < 100000""")
def trigram_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that hold a phrase, by a written table of trigrams: passages with the phrase's trigrams are few, and only these are read."""
    passages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), F.col("text").alias("body")).where(F.length("body") < 100000)
    return indexes.holding(passages, indexes.postings(passages, "passage_id", "body"), "passage_id", "body", "licensed under").select("passage_id")


@query("viewport_index", """SELECT event_id, CAST(props->>'k' AS INT) AS place_id FROM events WHERE CAST(props->>'k' AS INT) * 1.7 - 85 BETWEEN -12 AND 31 AND CAST(props->>'k' AS INT) * 3.5 - 175 BETWEEN -60 AND 75.5""")
def viewport_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies in a box, from a table partitioned by cells of a grid: cells that the box does not touch are not read. A box outside the world or turned around is refused."""
    v = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("place_id"))
    points = v.select("event_id", "place_id", (F.col("place_id") * 1.7 - 85).alias("lat"), (F.col("place_id") * 3.5 - 175).alias("lon"))
    return indexes.in_box(indexes.grid(points, "lat", "lon"), -12.0, -60.0, 31.0, 75.5).select("event_id", "place_id")


@query("vector_index_recall", "SELECT true AS enough, count(*) FILTER (WHERE vec_id % 100 = 0) AS queries FROM embeddings")
def vector_index_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest vectors by an index of cells, every hundredth vector asked: whether at least nine of ten true neighbours are found."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = e.where("vec_id % 100 = 0")
    index = indexes.cells(e, "vec_id", "embedding")
    found = indexes.nearest(index, asked, "vec_id", "embedding", k=10)
    true = indexes.nearest_exact(e, asked, "vec_id", "embedding", k=10)
    both = true.join(found.select("query", "vec_id", F.lit(1).alias("hit")), ["query", "vec_id"], "left")
    return both.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"), F.countDistinct("query").alias("queries"))


@query("relationship_paths")
def relationship_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Simple ways between two people over parents, partners and siblings, either way, in each published version one may see: the shortest of each version, five in all, and whether any walk reached the depth."""
    e = run(spark, sf_dir, " SELECT e.version_id, e.parent_id, e.child_id FROM edges e JOIN versions v ON v.version_id = e.version_id JOIN trees t ON t.tree_id = v.tree_id WHERE v.state = 'published' AND t.visibility = 'public' AND e.predicate IN ('parent_of', 'spouse_of', 'sibling_of')")
    code = lambda c: F.concat_ws(":", F.col("version_id").cast("string"), F.col(c).cast("string"))
    steps = graph.undirected(e.select(code("parent_id").alias("x"), code("child_id").alias("y")), "x", "y").distinct()
    nodes = relation(spark, sf_dir, "nodes").where("person_id = 60").select(code("person_id").alias("id"))
    depth = 5
    found = graph.walks(steps, nodes, depth)
    there = found.where(F.element_at("path", -1).endswith(":92")).withColumn("version_id", F.substring_index(F.get("path", F.lit(0)), ":", 1).cast("long"))
    least = there.groupBy("version_id").agg(F.min(F.size("path")).alias("least"))
    cut = found.agg(F.coalesce(F.max(F.size("path")) > depth, F.lit(False)).alias("truncated"))
    best = there.join(least, "version_id").where(F.size("path") == F.col("least")).select("version_id", (F.col("least") - 1).alias("hops"), F.array_join(F.transform("path", lambda x: F.substring_index(x, ":", -1)), ">").alias("path"))
    return best.orderBy("hops", "version_id", "path").limit(5).crossJoin(F.broadcast(cut))


@query("label_occurrences")
def label_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that overlapping tiles read twice: in order, one that covers 0.82 of the smaller box of an earlier one is that one again. A page is a bounded group."""
    boxes = table(spark, sf_dir, "part").selectExpr("CAST(floor(p_partkey / 80) AS BIGINT) AS page", "p_partkey AS id", "p_size AS x", "p_partkey % 40 AS y", "10 + p_size % 7 AS w", "12 AS h")
    return boxes.groupBy("page").applyInPandas(lambda g: matching.merge_labels(g), "page long, id long, occurrences int")


@archived
def suite_scores(d: Dialect) -> str:
    """Precision, recall and F1 by suite of cases, and how often the first answer was right."""
    return """, c AS (SELECT CASE o_custkey % 4 WHEN 0 THEN 'extraction' WHEN 1 THEN 'resolution' WHEN 2 THEN 'contradiction' ELSE 'citation' END AS suite, o_orderkey % 3 <> 0 AS expected, o_orderkey % 4 <> 0 AS given, o_orderkey % 5 = 0 AS first FROM orders),
    s AS (SELECT suite, count(*) FILTER (WHERE expected AND given) AS tp, count(*) FILTER (WHERE given AND NOT expected) AS fp, count(*) FILTER (WHERE expected AND NOT given) AS fn, avg(CASE WHEN first THEN 1.0e0 ELSE 0.0e0 END) AS p1 FROM c GROUP BY suite)
    SELECT suite, tp, fp, fn, round(tp / (tp + fp + 0.0e0), 6) AS precision, round(tp / (tp + fn + 0.0e0), 6) AS recall, round(2.0e0 * tp / (2 * tp + fp + fn), 6) AS f1, round(p1, 6) AS precision_at_1 FROM s"""

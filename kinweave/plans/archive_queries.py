"""Visibility inside every read, search, retrieval legs, browse and findings over the archive.

Each visibility rule is a set of visible ids, computed once an actor and semi-joined; none is a predicate inside
a row. Sums and ranks end in an id, so that every order is total.
"""

from __future__ import annotations

from kinweave.plans.registry import archived
from kinweave.sources.archive import Dialect

ACTOR = 7
TERM = "red widget"

PUBLISHED = "(SELECT v.version_id, v.tree_id, t.visibility, t.owner_id FROM versions v JOIN trees t ON t.tree_id = v.tree_id WHERE v.state = 'published')"


def visible_people(actor: int = ACTOR) -> str:
    """In a published version of a public tree, or one's own, or in a tree that one works on. No role opens people."""
    return f"""(SELECT n.person_id FROM nodes n JOIN {PUBLISHED} pv ON pv.version_id = n.version_id WHERE pv.visibility = 'public'
      UNION SELECT person_id FROM people WHERE created_by = {actor}
      UNION SELECT n.person_id FROM nodes n JOIN versions v ON v.version_id = n.version_id JOIN collaborators c ON c.tree_id = v.tree_id WHERE c.user_id = {actor})"""


def visible_sources(actor: int = ACTOR, research: bool = False) -> str:
    return f"(SELECT source_id FROM sources WHERE visibility = 'public' OR created_by = {actor} OR {str(research).lower()})"


#: The visibility of each claim's evidence, for and against it.
EVIDENCE = """(SELECT e.claim_id, e.counter, so.visibility FROM (SELECT claim_id, statement_id, passage_id, false AS counter FROM evidence UNION ALL SELECT claim_id, statement_id, passage_id, true FROM counter_evidence) e
      LEFT JOIN statements st ON st.statement_id = e.statement_id LEFT JOIN passages pa ON pa.passage_id = e.passage_id LEFT JOIN sources so ON so.source_id = coalesce(st.source_id, pa.source_id))"""

PUBLIC_CLAIMS = f"(SELECT claim_id FROM {EVIDENCE} ev GROUP BY claim_id HAVING bool_or(visibility = 'public' AND NOT counter) AND NOT coalesce(bool_or(visibility = 'private'), false))"


def visible_claims_of(actor: int = ACTOR, research: bool = False) -> str:
    return f"(SELECT claim_id FROM {PUBLIC_CLAIMS} pc UNION SELECT claim_id FROM claims WHERE created_by = {actor} OR {str(research).lower()})"


def visible_questions_of(actor: int = ACTOR, research: bool = False) -> str:
    return f"""(SELECT q.question_id FROM question_sources q JOIN sources s ON s.source_id = q.source_id WHERE s.visibility = 'public'
      UNION SELECT q.question_id FROM question_claims q JOIN {PUBLIC_CLAIMS} pc ON pc.claim_id = q.claim_id UNION SELECT question_id FROM questions WHERE created_by = {actor} OR {str(research).lower()})"""


def visible_trees(actor: int = ACTOR) -> str:
    return f"(SELECT tree_id FROM {PUBLISHED} pv WHERE visibility = 'public' UNION SELECT tree_id FROM trees WHERE owner_id = {actor} UNION SELECT tree_id FROM collaborators WHERE user_id = {actor})"


@archived
def policy_people(d: Dialect) -> str:
    return f" SELECT person_id FROM {visible_people()} AS x"


@archived
def policy_references(d: Dialect) -> str:
    """Families, tribes, branches and places: public rows, and all rows for those who may write."""
    kinds = (("family", "families", "family_id"), ("tribe", "tribes", "tribe_id"), ("branch", "branches", "branch_id"), ("place", "places", "place_id"))
    return " SELECT kind, writer, count(*) AS n, sum(id) AS ids FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {w} AS writer, CAST({i} AS BIGINT) AS id FROM {t} WHERE visibility = 'public' OR {w}" for k, t, i in kinds for w in ("true", "false")) + ") AS x GROUP BY kind, writer"


@archived
def policy_sources(d: Dialect) -> str:
    return f" SELECT 'actor' AS who, source_id FROM {visible_sources(1)} AS x UNION ALL SELECT 'research', source_id FROM {visible_sources(1, True)} AS y UNION ALL SELECT 'nobody', source_id FROM {visible_sources(-1)} AS z"


@archived
def policy_claims(d: Dialect) -> str:
    """Some public evidence, no private evidence and no private counter-evidence; or one's own."""
    return f" SELECT claim_id FROM {visible_claims_of()} AS x"


@archived
def policy_questions(d: Dialect) -> str:
    """A public source linked, or a public claim linked (any of them), or one's own."""
    return f" SELECT question_id FROM {visible_questions_of()} AS x"


@archived
def policy_trees(d: Dialect) -> str:
    return f" SELECT tree_id FROM {visible_trees()} AS x"


@archived
def policy_batch(d: Dialect) -> str:
    """Every requested id gets an answer: missing, the first grant that holds, or hidden."""
    return f""" SELECT r.id, CASE WHEN p.person_id IS NULL THEN 'missing' WHEN pub.person_id IS NOT NULL THEN 'public' WHEN p.created_by = {ACTOR} THEN 'owner' WHEN col.person_id IS NOT NULL THEN 'collaborator' ELSE 'hidden' END AS access
      FROM (SELECT person_id AS id FROM people UNION ALL SELECT person_id + 1000000000 FROM people WHERE person_id < 9) AS r LEFT JOIN people p ON p.person_id = r.id
      LEFT JOIN (SELECT DISTINCT n.person_id FROM nodes n JOIN {PUBLISHED} pv ON pv.version_id = n.version_id WHERE pv.visibility = 'public') AS pub ON pub.person_id = r.id
      LEFT JOIN (SELECT DISTINCT n.person_id FROM nodes n JOIN versions v ON v.version_id = n.version_id JOIN collaborators c ON c.tree_id = v.tree_id WHERE c.user_id = {ACTOR}) AS col ON col.person_id = r.id"""


@archived
def name_search(d: Dialect) -> str:
    """Five kinds in one ranking, each under its policy; the second name is looked up for the page alone."""
    sim = lambda x: f"round({d.similarity(x, repr(TERM))} * 70, 6)"
    aliases = f"(SELECT a.person_id, a.value, a.created FROM aliases a WHERE a.source_id IS NULL OR a.source_id IN (SELECT source_id FROM {visible_sources()} AS vs))"
    exact = lambda x, n=100: f"CASE WHEN {x} = '{TERM}' THEN {n}.0e0 ELSE 0.0e0 END"
    return f""", va AS {aliases}, results AS (
      SELECT CAST(p.person_id AS BIGINT) AS id, 'person' AS kind, p.name, CAST(NULL AS STRING) AS joined_name, p.identity_status AS status, greatest({exact('p.normalized')}, CASE WHEN ha.person_id IS NOT NULL THEN 90.0e0 ELSE 0.0e0 END, {sim('p.normalized')}) AS score
      FROM people p LEFT JOIN (SELECT DISTINCT person_id FROM va WHERE value = '{TERM}') ha ON ha.person_id = p.person_id WHERE p.person_id IN (SELECT person_id FROM {visible_people()} AS vp)
      UNION ALL SELECT CAST(family_id AS BIGINT), 'family', name, NULL, NULL, greatest({exact('name')}, {exact('alias', 90)}, {sim('name')}) FROM families WHERE visibility = 'public'
      UNION ALL SELECT CAST(tribe_id AS BIGINT), 'tribe', name, NULL, NULL, greatest({exact('name')}, {exact('alias', 90)}, {sim('name')}) FROM tribes WHERE visibility = 'public'
      UNION ALL SELECT CAST(branch_id AS BIGINT), 'branch', b.name, f.name, NULL, greatest({exact('b.name')}, {sim('b.name')}) FROM branches b JOIN families f ON f.family_id = b.family_id WHERE b.visibility = 'public' AND f.visibility = 'public'
      UNION ALL SELECT CAST(p.place_id AS BIGINT), 'place', p.name, NULL, p.place_type, greatest({exact('p.name')}, CASE WHEN hn.place_id IS NOT NULL THEN 85.0e0 ELSE 0.0e0 END, {sim('p.name')}) FROM places p LEFT JOIN (SELECT DISTINCT place_id FROM place_names WHERE contains(lower(name), '{TERM}')) hn ON hn.place_id = p.place_id WHERE p.visibility = 'public'),
    page AS (SELECT * FROM results WHERE score > 0 ORDER BY score DESC, name, kind, id LIMIT 40),
    second AS (SELECT 'person' AS kind, CAST(person_id AS BIGINT) AS id, min(value) AS value FROM (SELECT person_id, value, row_number() OVER (PARTITION BY person_id ORDER BY created, value) AS n FROM va) AS f WHERE n = 1 GROUP BY person_id
      UNION ALL SELECT 'family', CAST(family_id AS BIGINT), alias FROM families UNION ALL SELECT 'tribe', CAST(tribe_id AS BIGINT), alias FROM tribes UNION ALL SELECT 'place', CAST(place_id AS BIGINT), name FROM place_names)
    SELECT page.kind, page.id, page.name, coalesce(second.value, page.joined_name, '') AS secondary, page.status, page.score FROM page LEFT JOIN second ON second.kind = page.kind AND second.id = page.id"""


@archived
def source_search(d: Dialect) -> str:
    """Title, author or citation must hold the term; public sources; all ranked."""
    return f" SELECT source_id, title, coalesce(author, '') AS author, source_type, greatest(CASE WHEN title = 'red' THEN 100.0e0 ELSE 0.0e0 END, round({d.similarity('title', repr('red'))} * 70, 6), CASE WHEN contains(lower(coalesce(author, '')), 'red') THEN 60.0e0 ELSE 0.0e0 END) AS score FROM sources WHERE (contains(lower(title), 'red') OR contains(lower(coalesce(author, '')), 'red') OR contains(lower(coalesce(citation, '')), 'red')) AND visibility = 'public' ORDER BY score DESC, title, source_id LIMIT 20"


def claim_search_of(d: Dialect, term: str, status: str = "", source: str = "", from_year: int = 0, to_year: int = 0, place: int = -1) -> str:
    """A predicate stands in the plan only where its parameter is set. Years hold each bound against its own year."""
    has = lambda x: f"contains(lower(coalesce({x}, '')), '{term}')"
    where = [f"c.claim_id IN (SELECT claim_id FROM {visible_claims_of()} AS vc)"]
    if term:
        where.append(f"({has('c.predicate')} OR {has('c.notes')} OR c.subject_id IN (SELECT person_id FROM named) OR c.object_id IN (SELECT person_id FROM named))")
    if status:
        where.append(f"c.status = '{status}'")
    if source:
        where.append(f"c.claim_id IN (SELECT e.claim_id FROM evidence e JOIN statements s ON s.statement_id = e.statement_id WHERE s.source_id = '{source}')")
    if place >= 0:
        where.append(f"c.place_id = {place}")
    if from_year:
        where.append(f"(c.year_from IS NULL OR c.year_from <= {from_year})")
    if to_year:
        where.append(f"(c.year_to IS NULL OR c.year_to >= {to_year})")
    score = f"greatest(CASE WHEN c.predicate = '{term}' THEN 100.0e0 ELSE 0.0e0 END, round({d.similarity('c.predicate', repr(term))} * 70, 6), CASE WHEN {has('c.notes')} THEN 60.0e0 ELSE 0.0e0 END)"
    named = f", named AS (SELECT p.person_id FROM people p WHERE contains(p.normalized, '{term}') AND p.person_id IN (SELECT person_id FROM {visible_people()} AS vp))"
    return f"{named} SELECT c.claim_id, c.predicate, c.status, {score} AS score FROM claims c WHERE {' AND '.join(where)} ORDER BY score DESC, c.claim_id LIMIT 50"


@archived
def claim_search(d: Dialect) -> str:
    return claim_search_of(d, "red")


@archived
def claim_search_filtered(d: Dialect) -> str:
    return claim_search_of(d, "father", status="supported", from_year=1850, to_year=1760)


@archived
def claim_search_of_source(d: Dialect) -> str:
    return claim_search_of(d, "", source="src4", to_year=1850)


def passage_search_of(d: Dialect, term: str, source: str = "", k: int = 20) -> str:
    """Public passages that hold the term, and only these are scored; equal texts first."""
    t = term.replace("'", "''")
    own = f" AND p.source_id = '{source}'" if source else ""
    return f""" SELECT p.passage_id, p.source_id, s.title, p.locator, greatest(CASE WHEN lower(p.body) = '{t}' THEN 100.0e0 ELSE 0.0e0 END, round({d.similarity('p.body', f"'{t}'")} * 80, 6), CASE WHEN contains(lower(p.body), '{t}') THEN 65.0e0 ELSE 0.0e0 END) AS score
      FROM passages p JOIN sources s ON s.source_id = p.source_id WHERE contains(lower(p.body), '{t}') AND s.visibility = 'public'{own} ORDER BY score DESC, p.created DESC, p.passage_id LIMIT {k}"""


@archived
def passage_search(d: Dialect) -> str:
    return passage_search_of(d, "license")


@archived
def passage_search_in_source(d: Dialect) -> str:
    return passage_search_of(d, "the ", source="src3")


@archived
def question_search(d: Dialect) -> str:
    has = lambda x: f"contains(lower(coalesce({x}, '')), 'the ')"
    return f" SELECT question_id, title, status, greatest(CASE WHEN lower(title) = 'the' THEN 100.0e0 ELSE 0.0e0 END, round({d.similarity('title', repr('the '))} * 70, 6), CASE WHEN {has('description')} THEN 55.0e0 ELSE 0.0e0 END) AS score FROM questions WHERE ({has('title')} OR {has('description')}) AND question_id IN (SELECT question_id FROM {visible_questions_of()} AS vq) AND status = 'open' ORDER BY score DESC, question_id LIMIT 20"


#: Embedded passages: the vector of a passage, where it has one.
VECTORS = "(SELECT vec_id AS passage_id, embedding FROM embeddings)"


def cosine(d: Dialect, a: str, b: str) -> str:
    if not d.spark:
        return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (u, v) -> CAST(u AS DOUBLE) * CAST(v AS DOUBLE)), 0.0e0, (s, v) -> s + v)"
    return f"({dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})))"


BEST_STATEMENT = """(SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY passage_id, source_id ORDER BY CASE review_status WHEN 'accepted' THEN 0 WHEN 'needs_review' THEN 1 ELSE 2 END, created, statement_id) AS n FROM statements s) AS r WHERE n = 1)"""


@archived
def semantic_search(d: Dialect) -> str:
    """Nearest public passages with their best statement and their source's dependency; filters by person, place and year of publication."""
    return f""", target AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    linked AS (SELECT coalesce(e.passage_id, s.passage_id) AS passage_id FROM evidence e LEFT JOIN statements s ON s.statement_id = e.statement_id JOIN claims c ON c.claim_id = e.claim_id WHERE c.subject_id < 100000 OR c.object_id < 100000),
    placed AS (SELECT source_id FROM associations WHERE place_id < 50 UNION SELECT source_id FROM migrations WHERE from_place < 50 OR to_place < 50),
    scored AS (SELECT p.passage_id, p.source_id, p.locator, s.title, s.dependency_status, round({cosine(d, 'v.embedding', 't.q')}, 6) AS score
      FROM {VECTORS} v JOIN passages p ON p.passage_id = v.passage_id JOIN sources s ON s.source_id = p.source_id CROSS JOIN target t
      WHERE s.visibility = 'public' AND (s.year_from IS NULL OR s.year_from <= 1950) AND (s.year_to IS NULL OR s.year_to >= 1906) AND p.passage_id IN (SELECT passage_id FROM linked) AND s.source_id IN (SELECT source_id FROM placed)),
    page AS (SELECT * FROM scored WHERE score > 0 ORDER BY score DESC, passage_id LIMIT 20),
    dep AS (SELECT source_id, bool_or(status = 'confirmed') AS derived, bool_or(status = 'needs_review') AS likely FROM dependencies GROUP BY source_id)
    SELECT page.passage_id, page.source_id, page.title, page.locator, b.statement_id, coalesce(b.review_status, 'unreviewed') AS review_status, CASE WHEN dep.derived THEN 'derived' WHEN dep.likely THEN 'likely_dependent' ELSE page.dependency_status END AS dependency_status, page.score
    FROM page LEFT JOIN {BEST_STATEMENT} b ON b.passage_id = page.passage_id AND b.source_id = page.source_id LEFT JOIN dep ON dep.source_id = page.source_id"""


def lexical_leg_of(d: Dialect, term: str, k: int = 50) -> str:
    t = f"'{term}'"
    return f"""(SELECT p.passage_id AS id, round(greatest(CASE WHEN lower(p.body) = {t} THEN 1.0e0 ELSE 0.0e0 END, {d.similarity('p.body', t)}, CASE WHEN contains(lower(p.body), {t}) THEN 0.75e0 ELSE 0.0e0 END, CASE WHEN contains(lower(st.body), {t}) THEN 0.85e0 ELSE 0.0e0 END), 6) AS score
      FROM passages p JOIN sources s ON s.source_id = p.source_id JOIN (SELECT * FROM (SELECT x.*, row_number() OVER (PARTITION BY passage_id ORDER BY created, statement_id) AS n FROM statements x WHERE review_status = 'accepted') AS a WHERE n = 1) st ON st.passage_id = p.passage_id
      WHERE s.visibility = 'public')"""


@archived
def lexical_leg(d: Dialect) -> str:
    """Passages with an accepted statement: 1 equal, .85 in the statement, .75 in the passage, else similarity."""
    return f" SELECT id AS passage_id, score FROM {lexical_leg_of(d, 'the')} AS l WHERE score > 0 ORDER BY score DESC, id LIMIT 50"


@archived
def hybrid_fusion(d: Dialect) -> str:
    """Both legs on the passage: weighted where both speak. The thirty best are reranked by the question's words; rerank, then score, then id gives the place."""
    question = "the ing and that tion"
    words = d.pick("array_distinct", "list_distinct")
    return f""", target AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
    lex AS (SELECT * FROM {lexical_leg_of(d, 'the')} AS l WHERE score > 0 ORDER BY score DESC, id LIMIT 50),
    vec AS (SELECT * FROM (SELECT v.passage_id AS id, round({cosine(d, 'v.embedding', 't.q')}, 6) AS score FROM {VECTORS} v JOIN passages p ON p.passage_id = v.passage_id JOIN sources s ON s.source_id = p.source_id CROSS JOIN target t WHERE s.visibility = 'public') AS w WHERE score > 0 ORDER BY score DESC, id LIMIT 50),
    fused AS (SELECT coalesce(lex.id, vec.id) AS id, lex.score AS lexical, vec.score AS vector, round(CASE WHEN lex.score IS NOT NULL AND vec.score IS NOT NULL THEN 0.55e0 * lex.score + 0.45e0 * vec.score ELSE coalesce(lex.score, vec.score) END, 6) AS combined FROM lex FULL OUTER JOIN vec ON vec.id = lex.id ORDER BY combined DESC, id LIMIT 30),
    reranked AS (SELECT f.*, round({d.common(f"{words}({d.words(repr(question))})", f"{words}({d.words('p.body')})")} * 1.0e0 / {d.size(f"{words}({d.words(repr(question))})")}, 4) AS rerank FROM fused f JOIN passages p ON p.passage_id = f.id)
    SELECT id AS passage_id, lexical, vector, combined, rerank, CAST(row_number() OVER (ORDER BY rerank DESC, combined DESC, id) AS INT) AS place FROM reranked"""


SHORT = "'red'"


@archived
def claims_leg(d: Dialect) -> str:
    """Claims with visible, accepted evidence whose predicate, notes or first statement speak of the term."""
    ws = d.word_similarity(repr("license"), "substr(ve.body, 1, 60)")
    sim = d.similarity("c.predicate", repr("license"))
    return f""", ve AS (SELECT * FROM (SELECT e.claim_id, e.statement_id, coalesce(e.passage_id, st.passage_id) AS passage_id, so.source_id, st.body, st.review_status, row_number() OVER (PARTITION BY e.claim_id ORDER BY e.statement_id NULLS LAST, e.passage_id NULLS LAST) AS n
      FROM evidence e LEFT JOIN statements st ON st.statement_id = e.statement_id LEFT JOIN passages pa ON pa.passage_id = e.passage_id JOIN sources so ON so.source_id = coalesce(st.source_id, pa.source_id) WHERE so.visibility = 'public') AS x WHERE n = 1),
    scored AS (SELECT c.claim_id, c.status, ve.source_id, ve.statement_id, c.notes, round({sim}, 6) AS sim, round({ws}, 6) AS ws FROM claims c JOIN ve ON ve.claim_id = c.claim_id WHERE ve.review_status = 'accepted')
    SELECT claim_id, status, source_id, statement_id, round(greatest(sim, CASE WHEN contains(lower(coalesce(notes, '')), 'license') THEN 0.7e0 ELSE 0.0e0 END, ws * 0.8e0), 6) AS score FROM scored WHERE sim > 0.1e0 OR ws > 0.15e0 OR contains(lower(coalesce(notes, '')), 'license') ORDER BY score DESC, claim_id LIMIT 20"""


@archived
def trees_leg(d: Dialect) -> str:
    """Relationships of published versions whose people or predicate speak of the term, where tree and source are open."""
    ws = lambda x: d.word_similarity(SHORT, x)
    return f""", r AS (SELECT e.edge_id, t.tree_id, t.name, v.version_number, a.label AS subject, b.label AS object, e.predicate, e.status, {ws('a.label')} AS wa, {ws('b.label')} AS wb
      FROM edges e JOIN versions v ON v.version_id = e.version_id AND v.state = 'published' JOIN trees t ON t.tree_id = v.tree_id JOIN nodes a ON a.person_id = e.parent_id AND a.version_id = e.version_id JOIN nodes b ON b.person_id = e.child_id AND b.version_id = e.version_id LEFT JOIN sources s ON s.source_id = e.source_id
      WHERE t.visibility = 'public' AND (s.source_id IS NULL OR s.visibility = 'public'))
    SELECT edge_id, tree_id, version_number, subject, object, predicate, status, round(greatest(CASE WHEN contains(lower(subject), {SHORT}) THEN 0.9e0 ELSE 0.0e0 END, CASE WHEN contains(lower(object), {SHORT}) THEN 0.9e0 ELSE 0.0e0 END, CASE WHEN contains(predicate, {SHORT}) THEN 0.8e0 ELSE 0.0e0 END, wa, wb), 6) AS score
    FROM r WHERE contains(lower(subject), {SHORT}) OR contains(lower(object), {SHORT}) OR contains(predicate, {SHORT}) OR wa > 0.15e0 OR wb > 0.15e0 ORDER BY score DESC, edge_id LIMIT 20"""


@archived
def findings_leg(d: Dialect) -> str:
    """Findings that are not dismissed, by three kinds of likeness, newest first."""
    return f" SELECT finding_id, title, status FROM findings WHERE (contains(lower(title), 'red f') OR contains(lower(explanation), 'red f') OR {d.similarity('title', repr('urgent red'))} > 0.1e0 OR {d.word_similarity(repr('urgent red'), 'title')} > 0.15e0 OR {d.word_similarity(repr('urgent red'), 'explanation')} > 0.15e0) AND status <> 'dismissed' ORDER BY finding_id DESC LIMIT 20"


@archived
def questions_leg(d: Dialect) -> str:
    t = repr("thea tion")
    return f" SELECT question_id, status, priority FROM questions WHERE (contains(lower(title), {t}) OR contains(lower(coalesce(description, '')), {t}) OR {d.similarity('title', t)} > 0.1e0 OR {d.word_similarity(t, 'title')} > 0.15e0 OR {d.word_similarity(t, 'coalesce(description, title)')} > 0.15e0) AND status NOT IN ('resolved', 'archived') ORDER BY question_id DESC LIMIT 20"


@archived
def word_similarity_questions(d: Dialect) -> str:
    """Best-extent trigram similarity of a phrase with each question's title."""
    return f" SELECT question_id, score FROM (SELECT question_id, round({d.word_similarity(repr('thea tion'), 'title')}, 6) AS score FROM questions) AS q WHERE score >= 0.15e0"


@archived
def conflict_labels(d: Dialect) -> str:
    """Claims that stand against something, with the sources that speak of them."""
    return f""", s AS (SELECT e.claim_id, {d.distinct_list('coalesce(st.source_id, pa.source_id)')} AS source_ids FROM evidence e LEFT JOIN statements st ON st.statement_id = e.statement_id LEFT JOIN passages pa ON pa.passage_id = e.passage_id GROUP BY e.claim_id)
    SELECT 'research_claim' AS type, c.claim_id AS left_id, c.claim_id AS right_id, c.status, coalesce({d.joined('s.source_ids')}, '') AS source_ids FROM claims c LEFT JOIN s ON s.claim_id = c.claim_id WHERE c.status IN ('contested', 'disputed', 'contradicted', 'rejected')"""


@archived
def graph_citations(d: Dialect) -> str:
    """Passages behind a graph's claims are added to the citations that are there, each once, in order of claim and passage."""
    return f""", cited AS (SELECT id AS passage_id, CAST(row_number() OVER (ORDER BY score DESC, id) AS INT) AS place FROM (SELECT * FROM {lexical_leg_of(d, 'the')} AS l WHERE score > 0 ORDER BY score DESC, id LIMIT 50) AS x),
    behind AS (SELECT pa.passage_id, min(e.claim_id) AS claim_id FROM evidence e JOIN claims c ON c.claim_id = e.claim_id JOIN passages pa ON pa.passage_id = e.passage_id JOIN sources s ON s.source_id = pa.source_id WHERE c.subject_id < 40 AND s.visibility = 'public' GROUP BY pa.passage_id),
    added AS (SELECT b.passage_id, b.claim_id, row_number() OVER (ORDER BY b.claim_id, b.passage_id) AS n FROM behind b LEFT JOIN cited c ON c.passage_id = b.passage_id WHERE c.passage_id IS NULL)
    SELECT passage_id, place, 'retrieval' AS origin FROM cited UNION ALL SELECT passage_id, CAST((SELECT count(*) FROM cited) + n AS INT), 'graph' FROM added"""


@archived
def layered_package(d: Dialect) -> str:
    """Evidence by the five epistemic layers, each under its policy: how much, and which comes first."""
    return f""" SELECT layer, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM (
      SELECT 'source_statement' AS layer, CAST(statement_id AS BIGINT) AS id FROM statements WHERE review_status = 'accepted' AND source_id IN (SELECT source_id FROM {visible_sources(-1)} AS vs)
      UNION ALL SELECT 'research_claim', claim_id FROM claims WHERE claim_id IN (SELECT claim_id FROM {visible_claims_of(-1)} AS vc)
      UNION ALL SELECT 'tree_interpretation', CAST(edge_id AS BIGINT) FROM edges e JOIN versions v ON v.version_id = e.version_id WHERE v.state = 'published' AND v.tree_id IN (SELECT tree_id FROM {visible_trees(-1)} AS vt)
      UNION ALL SELECT 'platform_finding', finding_id FROM findings WHERE status <> 'dismissed'
      UNION ALL SELECT 'open_question', question_id FROM questions WHERE status NOT IN ('resolved', 'archived') AND question_id IN (SELECT question_id FROM {visible_questions_of(-1)} AS vq)) AS x GROUP BY layer"""


@archived
def people_browse(d: Dialect) -> str:
    """Name or alias holds the term, under the policy; a page of fifty."""
    return f" SELECT p.person_id, p.name FROM people p WHERE (contains(p.normalized, 'ring') OR p.person_id IN (SELECT person_id FROM aliases WHERE contains(value, 'red'))) AND p.person_id IN (SELECT person_id FROM {visible_people()} AS vp) ORDER BY p.name, p.person_id LIMIT 50"


@archived
def people_page(d: Dialect) -> str:
    """The third page of twenty; unknown births come last."""
    return " SELECT person_id, name, birth_from FROM people ORDER BY birth_from ASC NULLS LAST, person_id LIMIT 20 OFFSET 40"


@archived
def statement_queue(d: Dialect) -> str:
    """What waits for review first: a rank by status, then priority of its source, then age."""
    return " SELECT statement_id, review_status FROM statements st ORDER BY CASE review_status WHEN 'needs_review' THEN 0 WHEN 'rejected' THEN 1 ELSE 2 END, created, statement_id LIMIT 40"


@archived
def run_history(d: Dialect) -> str:
    """Runs with what they found; runs are seen by kind: contradiction runs need a finding that is open, temporal ones any, others none."""
    return """, visible AS (SELECT run_kind, run_id FROM findings WHERE run_kind = 'contradiction' AND status = 'open' AND run_id IS NOT NULL UNION SELECT run_kind, run_id FROM findings WHERE run_kind = 'temporal' AND run_id IS NOT NULL)
    SELECT f.run_kind, f.run_id, count(*) AS findings, count(*) FILTER (WHERE f.status = 'open') AS still_open, max(f.finding_id) AS newest FROM findings f JOIN visible v ON v.run_kind = f.run_kind AND v.run_id = f.run_id GROUP BY f.run_kind, f.run_id"""


@archived
def finding_visibility(d: Dialect) -> str:
    """A finding is read through its kind of run: by a claim one may see, by a tree one may see, or freely."""
    return f""" SELECT finding_id FROM findings WHERE run_kind = 'contradiction' AND finding_id IN (SELECT claim_id FROM {visible_claims_of()} AS vc)
      UNION SELECT finding_id FROM findings WHERE run_kind = 'temporal' AND run_id IN (SELECT tree_id FROM {visible_trees()} AS vt) UNION SELECT finding_id FROM findings WHERE run_kind = 'spatial' AND run_id IS NULL"""


@archived
def entity_labels(d: Dialect) -> str:
    """An association's entity has one of four kinds; its name is the first of four left joins that meets, else what it is."""
    return """ SELECT ga.association_id, ga.entity_type, coalesce(p.name, f.name, t.name, b.name, ga.entity_type || ' ' || ga.entity_id) AS label FROM associations ga
      LEFT JOIN people p ON ga.entity_type = 'person' AND p.person_id = ga.entity_id LEFT JOIN families f ON ga.entity_type = 'family' AND f.family_id = ga.entity_id LEFT JOIN tribes t ON ga.entity_type = 'tribe' AND t.tribe_id = ga.entity_id LEFT JOIN branches b ON ga.entity_type = 'branch' AND b.branch_id = ga.entity_id"""


@archived
def statement_coverage(d: Dialect) -> str:
    """Passages with how many of their statements are accepted; the status stands in the join, so passages without one stay."""
    return " SELECT p.source_id, count(DISTINCT p.passage_id) AS passages, count(ss.statement_id) AS accepted, count(DISTINCT CASE WHEN ss.statement_id IS NULL THEN p.passage_id END) AS bare FROM passages p LEFT JOIN statements ss ON ss.passage_id = p.passage_id AND ss.review_status = 'accepted' GROUP BY p.source_id"


def map_time(a: str, b: str, lo: int, hi: int) -> str:
    """A missing year is 0; both missing passes; else it begins by the end and does not end before the beginning."""
    return f"((coalesce({a}, 0) = 0 AND coalesce({b}, 0) = 0) OR (coalesce({a}, 0) <= {hi} AND (coalesce({b}, 0) = 0 OR coalesce({b}, 0) >= {lo})))"


@archived
def map_features_in_time(d: Dialect) -> str:
    return f" SELECT place_id, count(*) AS n FROM associations WHERE {map_time('year_from', 'year_to', 1760, 1790)} GROUP BY place_id"


DRAWN = "CASE WHEN documented > 0 THEN 'documented' WHEN interpreted > 0 THEN 'interpreted' ELSE 'inferred' END"


@archived
def regions_by_drawn_status(d: Dialect) -> str:
    """A region is filtered by the status that it is drawn with, which is made of its associations."""
    return f", r AS (SELECT place_id, {DRAWN} AS drawn, n FROM (SELECT place_id, count(*) AS n, count(*) FILTER (WHERE status = 'documented') AS documented, count(*) FILTER (WHERE status = 'interpreted') AS interpreted FROM associations WHERE place_id % 2 = 1 GROUP BY place_id) AS a) SELECT place_id, drawn, n FROM r WHERE drawn <> 'inferred'"


@archived
def map_layers_filled_in_order(d: Dialect) -> str:
    """Layers fill one budget in turn; what would have been the next row says that the map is cut. The box must be a box."""
    box = "p.lat BETWEEN -50 AND 50 AND p.lon BETWEEN -110 AND 110"
    return f""", l AS (SELECT 1 AS layer_no, CAST(p.place_id AS BIGINT) AS id, p.place_id FROM places p WHERE p.visibility = 'public' AND {box}
      UNION ALL SELECT 2, CAST(a.association_id AS BIGINT), a.place_id FROM associations a JOIN places p ON p.place_id = a.place_id WHERE {box} AND a.status = 'documented'
      UNION ALL SELECT 3, CAST(m.migration_id AS BIGINT), m.from_place FROM migrations m JOIN places p ON p.place_id = m.from_place WHERE {box}),
    page AS (SELECT * FROM l ORDER BY layer_no, id LIMIT 301)
    SELECT layer_no, id, place_id, truncated FROM (SELECT layer_no, id, place_id, row_number() OVER (ORDER BY layer_no, id) AS n, count(*) OVER () > 300 AS truncated FROM page) AS x WHERE n <= 300"""


@archived
def lineage_edges(d: Dialect) -> str:
    """Edges of a tree without those that are only interpreted, and how many of these the toggle hides."""
    return " SELECT version_id, edge_id, parent_id, child_id, hidden FROM (SELECT e.*, CAST(sum(CASE WHEN status = 'interpreted' THEN 1 ELSE 0 END) OVER (PARTITION BY version_id) AS BIGINT) AS hidden FROM edges e) AS x WHERE status <> 'interpreted'"


@archived
def active_claims(d: Dialect) -> str:
    """Not one of the statuses that end a claim; a missing status is no status."""
    return " SELECT claim_id, predicate, status FROM claims WHERE status NOT IN ('rejected', 'superseded', 'unknown', 'unresolved') AND predicate IN ('father_of', 'parent_of')"


@archived
def chart_library(d: Dialect) -> str:
    """Files with their counts and their latest run."""
    return """, runs AS (SELECT o_custkey AS file_id, o_orderkey AS run_id, o_orderstatus AS state, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n, count(*) OVER (PARTITION BY o_custkey) AS runs, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey) AS BIGINT) AS done FROM orders)
    SELECT c.c_custkey AS file_id, coalesce(r.runs, 0) AS runs, coalesce(r.done, 0) AS done, r.run_id AS latest_run, r.state AS latest_state FROM customer c LEFT JOIN runs r ON r.file_id = c.c_custkey AND r.n = 1 WHERE c.c_mktsegment = 'BUILDING'"""


@archived
def merge_candidates(d: Dialect) -> str:
    """Pairs of people who share name and tree, best first, a hundred at most. Here people meet on name and tree at once: of a name alone there may be thousands."""
    best = " SELECT a, b, version_id, score FROM pairs ORDER BY score DESC, a, b, version_id LIMIT 100"
    if d.spark:
        return f""", placed AS (SELECT p.person_id, p.normalized, p.gender, n.version_id FROM people p JOIN nodes n ON n.person_id = p.person_id WHERE p.gender <> ''),
    pairs AS (SELECT a.person_id AS a, b.person_id AS b, a.version_id, CASE WHEN a.gender = b.gender THEN 0.9e0 ELSE 0.6e0 END AS score FROM placed a JOIN placed b ON b.normalized = a.normalized AND b.version_id = a.version_id AND a.person_id < b.person_id){best}"""
    return """, pairs AS (SELECT a.person_id AS a, b.person_id AS b, na.version_id, CASE WHEN a.gender = b.gender THEN 0.9e0 ELSE 0.6e0 END AS score FROM people a JOIN people b ON a.normalized = b.normalized AND a.person_id < b.person_id JOIN nodes na ON na.person_id = a.person_id JOIN nodes nb ON nb.person_id = b.person_id AND nb.version_id = na.version_id WHERE a.gender <> '' AND b.gender <> '')
    SELECT a, b, version_id, score FROM pairs ORDER BY score DESC, a, b, version_id LIMIT 100"""


@archived
def bounded_snapshot(d: Dialect) -> str:
    """The first rows by id, and whether there were more."""
    return " SELECT claim_id, subject_id, object_id, truncated FROM (SELECT c.*, row_number() OVER (ORDER BY claim_id) AS n, count(*) OVER () > 5000 AS truncated FROM (SELECT * FROM claims ORDER BY claim_id LIMIT 5001) AS c) AS x WHERE n <= 5000"


@archived
def embedding_backlog(d: Dialect) -> str:
    """Passages without a vector in stable order, and how far the whole is."""
    return f" SELECT p.passage_id, t.total, t.embedded FROM passages p LEFT JOIN {VECTORS} v ON v.passage_id = p.passage_id CROSS JOIN (SELECT count(*) AS total, count(w.passage_id) AS embedded FROM passages q LEFT JOIN {VECTORS} w ON w.passage_id = q.passage_id) AS t WHERE v.passage_id IS NULL ORDER BY p.created, p.passage_id LIMIT 100"


@archived
def independent_sources(d: Dialect) -> str:
    """Public sources of each claim's evidence that depend on no other and that no other depends on: two anti joins, each on one column."""
    active = "(SELECT {0} AS source_id FROM dependencies WHERE status <> 'rejected')"
    return f""", ev AS (SELECT DISTINCT e.claim_id, s.source_id FROM evidence e LEFT JOIN statements st ON st.statement_id = e.statement_id LEFT JOIN passages pa ON pa.passage_id = e.passage_id JOIN sources s ON s.source_id = coalesce(st.source_id, pa.source_id) WHERE s.visibility = 'public'),
    alone AS (SELECT ev.* FROM ev WHERE NOT EXISTS (SELECT 1 FROM {active.format('source_id')} AS x WHERE x.source_id = ev.source_id) AND NOT EXISTS (SELECT 1 FROM {active.format('depends_on')} AS y WHERE y.source_id = ev.source_id))
    SELECT ev.claim_id, count(*) AS sources, count(alone.source_id) AS independent FROM ev LEFT JOIN alone ON alone.claim_id = ev.claim_id AND alone.source_id = ev.source_id GROUP BY ev.claim_id"""


@archived
def stance_rollup(d: Dialect) -> str:
    """Evidence of each claim by stance, with its distinct sources; counter-evidence counts against it."""
    return """, e AS (SELECT claim_id, relation, statement_id, passage_id FROM evidence UNION ALL SELECT claim_id, 'counter', statement_id, passage_id FROM counter_evidence)
    SELECT e.claim_id, count(*) FILTER (WHERE relation = 'supports') AS support, count(*) FILTER (WHERE relation IN ('refutes', 'counter')) AS counter, count(*) FILTER (WHERE e.statement_id IS NULL) AS context, count(DISTINCT coalesce(st.source_id, pa.source_id)) AS sources
    FROM e LEFT JOIN statements st ON st.statement_id = e.statement_id LEFT JOIN passages pa ON pa.passage_id = e.passage_id GROUP BY e.claim_id"""


@archived
def period_labels(d: Dialect) -> str:
    """Both bounds, one, or none, and how sure."""
    return """ SELECT person_id, CASE WHEN birth_from IS NOT NULL AND birth_to IS NOT NULL THEN birth_from || ' — ' || birth_to WHEN birth_from IS NOT NULL THEN 'من ' || birth_from WHEN birth_to IS NOT NULL THEN 'حتى ' || birth_to ELSE 'غير محددة' END || CASE identity_status WHEN 'confirmed' THEN '' ELSE ' (' || identity_status || ')' END AS period FROM people"""


@archived
def event_chronology_findings(d: Dialect) -> str:
    """A stay that ends before birth begins, or begins after death ends; a missing bound proves nothing. Years are 365 days here."""
    return """, e AS (SELECT a.association_id, a.entity_id AS person_id, a.year_from, a.year_to, p.birth_from, p.death_to FROM associations a JOIN people p ON p.person_id = a.entity_id WHERE a.entity_type = 'person')
    SELECT 'event_before_birth' AS kind, association_id, person_id FROM e WHERE (year_to - 1700) * 365 < birth_from UNION ALL SELECT 'event_after_death', association_id, person_id FROM e WHERE (year_from - 1700) * 365 > death_to"""


KIN = "(SELECT subject_id AS child_id, object_id AS parent_id, claim_id FROM claims WHERE predicate = 'father_of' UNION ALL SELECT object_id, subject_id, claim_id FROM claims WHERE predicate = 'parent_of')"


@archived
def multi_parent_findings(d: Dialect) -> str:
    """Children with two parents or more over claims (the subject of father_of is the child) and published edges."""
    return f""", k AS (SELECT child_id, parent_id FROM {KIN} AS c UNION ALL SELECT e.child_id, e.parent_id FROM edges e JOIN versions v ON v.version_id = e.version_id WHERE v.state = 'published' AND e.predicate = 'parent_of')
    SELECT child_id, count(DISTINCT parent_id) AS parents, {d.joined(d.distinct_list('parent_id'))} AS parent_ids FROM k GROUP BY child_id HAVING count(DISTINCT parent_id) >= 2"""


@archived
def parent_chronology_findings(d: Dialect) -> str:
    """A parent born after the child's birth ends, or dead before it begins; missing bounds prove nothing."""
    return f""", k AS (SELECT DISTINCT c.child_id, c.parent_id, p.birth_from AS pb, p.death_from AS pd, q.birth_from AS cf, q.birth_to AS ct FROM {KIN} AS c JOIN people p ON p.person_id = c.parent_id JOIN people q ON q.person_id = c.child_id)
    SELECT 'parent_born_after_child' AS kind, parent_id, child_id FROM k WHERE pb > ct UNION ALL SELECT 'parent_died_too_early', parent_id, child_id FROM k WHERE pd < cf"""


@archived
def duplicate_identity(d: Dialect) -> str:
    """People of one tree who share a name or an alias."""
    return f""", v AS (SELECT person_id, normalized AS value FROM people UNION SELECT person_id, value FROM aliases), t AS (SELECT DISTINCT n.person_id, x.tree_id FROM nodes n JOIN versions x ON x.version_id = n.version_id)
    SELECT t.tree_id, v.value, count(DISTINCT v.person_id) AS people, {d.joined(d.distinct_list('v.person_id'))} AS person_ids FROM v JOIN t ON t.person_id = v.person_id WHERE trim(v.value) <> '' GROUP BY t.tree_id, v.value HAVING count(DISTINCT v.person_id) >= 2"""


@archived
def best_path_of_version(d: Dialect) -> str:
    """Of each version, the ways from a child to a grandparent that are as short as the shortest."""
    return """, p AS (SELECT a.version_id, a.child_id, a.parent_id AS ancestor, 1 AS hops FROM edges a UNION ALL SELECT a.version_id, a.child_id, b.parent_id, 2 FROM edges a JOIN edges b ON b.version_id = a.version_id AND b.child_id = a.parent_id AND b.edge_id <> a.edge_id)
    SELECT version_id, child_id, ancestor, hops FROM (SELECT p.*, min(hops) OVER (PARTITION BY version_id, ancestor) AS least FROM p) AS x WHERE hops = least"""


@archived
def reading_order(d: Dialect) -> str:
    """Words of a page from top to bottom, then left to right; the id settles the rest."""
    return " SELECT p_partkey AS word_id, CAST(floor(p_partkey / 80) AS BIGINT) AS page, CAST(row_number() OVER (PARTITION BY floor(p_partkey / 80) ORDER BY p_size % 12, p_partkey * 37 % 101, p_partkey) AS INT) AS place FROM part"


@archived
def job_states(d: Dialect) -> str:
    """Jobs whose lease ran out go back with a delay of 2 to the attempts (ten at most); those with no attempts left are dead letters; run_at decides what may be claimed."""
    return """, j AS (SELECT o_orderkey AS job_id, o_custkey % 6 AS attempts, 4 AS most, o_orderpriority AS priority, o_orderkey % 97 AS run_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'waiting' END AS state, o_orderkey % 50 AS leased_until FROM orders)
    SELECT job_id, CASE WHEN state = 'running' AND leased_until < 25 AND attempts >= most THEN 'dead_letter' WHEN state = 'running' AND leased_until < 25 THEN 'waiting' ELSE state END AS next_state, CAST(CASE WHEN state = 'running' AND leased_until < 25 AND attempts < most THEN 25 + pow(2, least(attempts, 10)) ELSE run_at END AS BIGINT) AS next_run_at, state = 'waiting' AND run_at <= 25 AS claimable FROM j"""

"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts become templates: numbers, names (capitalised words inside a sentence) and units after a number are
typed placeholders, case and punctuation go. Windows of ``window`` tokens are hash-joined with those of the
benchmark, as templates (every window with at least ``min_literals`` literal tokens; others are templates of
anything) and as plain lower-cased words (so that other case or punctuation, which make a word a name or
not, hide nothing). A match names a diagonal: an item laid beside a document at one offset. Each diagonal is
then read as a whole, token by token. Two tokens agree if their words are equal or both are slots of one type.

A document is contaminated by an item if there is a stretch of at least ``min_run`` tokens (all tokens of a
shorter item) on one diagonal
- whose words are equal (``exact``), or
- whose tokens agree, whose slots map one to one between item and document, and which has at least
  ``min_literals`` literal tokens, on a diagonal that a template window found (``reparameterised``).
Where slots contradict one another the diagonal is cut, and what is consistent on either side counts for itself.
Items with fewer than ``min_run`` tokens are met with a window of their own length, so a very short item
contaminates each text that has its words in a row.

Equal words take a run of ``min_run``, so documents' plain windows are taken at every
(min_run - window + 1)th token only: such a run always has one of these. Hashes of 64 bits stand for windows.

Null and empty texts match nothing; rows with null ids are left out. Rows that share an id are judged text by
text: contaminated() names the id if one of its texts is, clean() takes out that text alone. Repeated rows give
the same result once. An empty table on either side contaminates nothing. Texts are read whole, however long;
other columns are not read, so they clash with nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.shared import written

NUM, NAME, UNIT = "\x01", "\x02", "\x03"
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "t", "ml", "l", "s", "sec", "min", "h", "hours", "hour", "minutes", "minute", "days", "day", "years", "year", "miles", "mile", "feet", "foot", "inches", "inch", "pounds", "lb", "oz", "dollars", "dollar", "euros", "euro", "eur", "usd", "cents", "percent", "degrees")
#: (pattern, replacement) in order; the same in Java's and RE2's dialects.
MARKS = (
    (f"(^|[^\\p{{L}}\\p{{N}}{NAME}])(\\p{{Lu}}\\p{{Ll}}+)", (1, NAME, 2)),
    (f"(^|[.!?:\n])([^\\p{{L}}\\p{{N}}{NAME}]*){NAME}", (1, "", 2)),
    ("(^|[^\\p{L}\\p{N}])(\\p{Nd}+)", (1, NUM, 2)),
)
STRIP = f"[^\\p{{L}}\\p{{N}}{NUM}{NAME}]+"
UNIT_AFTER = f"({NUM}[^ ]+ )((?:{'|'.join(UNITS)})(?: |$))"
SLOTS = (1, 2, 3)  # the marks as numbers, which stand for their slots in templates


def marked(text: Column) -> Column:
    """The text's tokens, space by space, slots with their type's mark before the value; units are not marked yet."""
    for pattern, (a, mark, b) in MARKS:
        text = F.regexp_replace(text, pattern, f"${a}{mark}${b}")
    return F.trim(F.lower(F.regexp_replace(text, STRIP, " ")))


def with_units(tokens: Column) -> Column:
    """marked() with units; texts without a number are left as they are."""
    return F.when(F.contains(tokens, F.lit(NUM)), F.regexp_replace(tokens, UNIT_AFTER, f"$1{UNIT}$2")).otherwise(tokens)


def _tokens(table: DataFrame, key: str, window: int) -> DataFrame:
    """id, text_key (a hash of the text), words (marked), plain, template: a hash for each token, as a word and as a template; grams: of each template window. Every row with a key and a token."""
    # said of the text and not of its tokens, or marked() would be computed once more to filter by
    some = F.col(key).isNotNull() & F.col("text").rlike(f"[\\p{{L}}\\p{{N}}{NUM}{NAME}{UNIT}]")
    rows = table.where(some).select(F.col(key).alias("id"), F.xxhash64("text").alias("text_key"), marked(F.col("text")).alias("t"))
    rows = rows.withColumn("t", with_units(F.col("t")))
    words = rows.select("id", "text_key", F.split("t", " ").alias("words"), F.split(_plain(F.col("t")), " ").alias("w"))
    template = F.transform("words", lambda m: F.when(_is_slot(m), F.ascii(m).cast("long")).otherwise(F.xxhash64(m)))
    return _grams(words.select("id", "text_key", "words", F.transform("w", lambda w: F.xxhash64(w)).alias("plain"), template.alias("template")), window)


def _grams(rows: DataFrame, window: int) -> DataFrame:
    """rows with ``grams``: the hash of each template window. Windows of a power of two are put together by halves, a step a column, so that each is made once."""
    if window & (window - 1):
        return rows.withColumn("grams", _windows("template", window))
    half = 1
    rows = rows.withColumn("grams", F.col("template"))
    while half < window:
        kept = F.greatest(F.lit(0), F.size("grams") - half)
        rows = rows.withColumn("grams", F.zip_with(F.slice("grams", F.lit(1), kept), F.slice("grams", F.lit(half + 1), kept), lambda a, b: F.xxhash64(a, b)))
        half *= 2
    return rows


def _plain(x: Column) -> Column:
    return F.translate(x, NUM + NAME + UNIT, "")


def _is_slot(x: Column) -> Column:
    return F.substring(x, 1, 1).isin(NUM, NAME, UNIT)


def _windows(tokens: str, length: int, step: int = 1) -> Column:
    """Hash of each window of ``length`` tokens, from every ``step``th place on; null if there are too few. Templates and plain words never meet."""
    starts = F.when(F.size(tokens) >= length, F.sequence(F.lit(1), F.size(tokens) - length + 1, F.lit(step)))  # a sequence to 0 would count down
    return F.transform(starts, lambda i: F.xxhash64(F.lit(tokens), F.slice(tokens, i, length)))


def _placed(windows: Column) -> Column:
    """Windows from every place on, with their places from 0."""
    return F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("pos")))


def _all_windows(parts: list[tuple[str, int, int]]) -> tuple[Column, Column]:
    """The windows of several kinds (tokens, length, step) in one array, and the place of its ``i``th."""
    empty = F.array().cast("array<long>")
    place, before = None, F.lit(0)
    for tokens, length, step in parts:
        count = F.greatest(F.lit(0), F.floor((F.col("n_words") - length) / step).cast("int") + 1)
        here = (F.col("i") - before) * step
        place = F.when(F.col("i") < before + count, here) if place is None else place.when(F.col("i") < before + count, here)
        before = before + count
    return F.concat(*[F.col("grams") if p[0] == "grams" else F.coalesce(_windows(*p), empty) for p in parts]), place


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_run: int = 13, min_literals: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, item_id, run_tokens (the longest stretch), kind of each contaminated pair."""
    found = _found(docs, benchmark, window, min_run, min_literals, broadcast_bytes)
    return found.groupBy(F.col("id").alias("doc_id"), "item_id").agg(F.max("run_tokens").cast("long").alias("run_tokens"), F.when(F.bool_or("exact"), "exact").otherwise("reparameterised").alias("kind"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int = 8, min_run: int = 13, min_literals: int = 5, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """id, text_key, item_id, run_tokens, exact of each contaminated text and diagonal."""
    items = written(_tokens(benchmark, "item_id", window).dropDuplicates(["id", "text_key"]).select(F.col("id").alias("item_id"), F.col("text_key").alias("item_key"), "words", "plain", "template", "grams", F.size("words").alias("n")), "items")
    facts = items.agg(F.collect_set(F.when(F.col("n") < min_run, F.col("n"))).alias("short"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.length(F.concat_ws(" ", "words"))), F.lit(0)).alias("chars")).first()
    short = sorted(facts["short"])  # at most min_run - 1 lengths
    plain = F.when(F.col("n") >= min_run, _placed(_windows("plain", window)))
    template = F.when(F.col("n") >= window, _placed(F.col("grams")))
    for n in short:
        plain = F.when(F.col("n") == n, _placed(_windows("plain", n))).otherwise(plain)
        template = F.when(F.col("n") == n, _placed(_windows("template", n))).otherwise(template) if n < window else template
    literals = lambda w: F.size(F.filter(F.slice("template", w["pos"] + 1, window), lambda x: ~x.isin(*SLOTS))) >= min_literals
    kind = lambda windows, by: items.select("item_id", "item_key", "n", F.explode_outer(windows).alias("w"), F.lit(by).alias("by_template")).where("w IS NOT NULL").select("item_id", "item_key", "n", F.col("w.h").alias("h"), F.col("w.pos").alias("ipos"), "by_template")
    seeds = written(kind(plain, False).union(kind(F.filter(template, literals), True)).distinct(), "benchmark_windows")

    # explode with outer and filter afterwards: for a plain explode, Spark infers a filter on the windows and
    # pushes it below, where all of marked() would be computed again for every window
    words = _tokens(docs, "doc_id", window)
    kinds = [("grams", window, 1), ("plain", window, max(1, min_run - window + 1)), *[("plain", n, 1) for n in short], *[("template", n, 1) for n in short if n < window]]
    hashes, place = _all_windows(kinds)
    cut = words.select("id", "text_key", "words", F.size("words").alias("n_words"), hashes.alias("hashes"))
    cut = cut.select("id", "text_key", "words", "n_words", F.posexplode_outer("hashes").alias("i", "h")).where("h IS NOT NULL")
    cut = cut.select("id", "text_key", "words", "h", place.alias("pos"))
    diagonal = ["id", "text_key", "item_id", "item_key", "n", "offset"]
    beside = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", F.col("offset") + i)).alias("beside")
    if 64 * seeds.count() <= broadcast_bytes:
        # the benchmark's windows were counted, at 64 bytes each: they fit in every task, and the documents' are not shuffled
        met = cut.join(F.broadcast(seeds), "h").withColumn("offset", F.col("pos") - F.col("ipos")).select(*diagonal, "by_template", beside)
        lines = met.groupBy(*diagonal).agg(F.max("by_template").alias("by_template"), F.first("beside").alias("beside"))
    else:
        met = cut.select("id", "text_key", "h", "pos").join(seeds, "h").withColumn("offset", F.col("pos") - F.col("ipos"))
        lines = met.groupBy(*diagonal).agg(F.max("by_template").alias("by_template"))
        lines = lines.join(words.select("id", "text_key", "words").dropDuplicates(["id", "text_key"]), ["id", "text_key"]).select(*diagonal, "by_template", beside)
    lines = written(lines, "diagonals")
    texts = items.select("item_id", "item_key", F.col("words").alias("item"))
    both = lines.join(F.broadcast(texts) if facts["chars"] + 16 * facts["tokens"] <= broadcast_bytes else texts, ["item_id", "item_key"])
    return _read(both, min_run, min_literals)


def _read(lines: DataFrame, min_run: int, min_literals: int) -> DataFrame:
    """Each diagonal token by token: ``item`` and ``beside`` are marked words, null where the document has none."""

    def token(a: Column, b: Column) -> Column:
        equal = F.coalesce(_plain(a) == _plain(b), F.lit(False))
        alike = F.coalesce(_is_slot(a) & (F.substring(a, 1, 1) == F.substring(b, 1, 1)), F.lit(False))
        slot = F.coalesce(_is_slot(a) | _is_slot(b), F.lit(False))
        return F.struct(_plain(a).alias("x"), _plain(b).alias("y"), equal.alias("equal"), (equal | alike).alias("agrees"), slot.alias("slot"))

    lines = lines.withColumn("z", F.zip_with("item", "beside", token))
    lines = lines.withColumn("z", F.transform("z", lambda t, i: t.withField("i", i)))
    # the slots that agree are few: each looks for the last one before it that contradicts it
    lines = lines.withColumn("slots", F.filter("z", lambda t: t["slot"] & t["agrees"]))
    against = lambda t: F.array_max(F.transform(F.filter("slots", lambda q: (q["i"] < t["i"]) & ((q["x"] == t["x"]) != (q["y"] == t["y"]))), lambda q: q["i"]))
    none = F.lit(-1)
    lines = lines.withColumn("stop", F.transform("z", lambda t: F.when(~t["agrees"], t["i"]).when(t["slot"], F.coalesce(against(t), none)).otherwise(none)))
    lines = lines.withColumn("differs", F.transform("z", lambda t: F.when(t["equal"], none).otherwise(t["i"])))
    lines = lines.withColumn("since", F.transform("stop", lambda c, j: F.array_max(F.slice("stop", 1, j + 1)))).withColumn("same", F.transform("differs", lambda c, j: j - F.array_max(F.slice("differs", 1, j + 1))))
    need = F.least(F.lit(min_run), F.col("n"))
    literal = lambda b, j: F.size(F.filter(F.slice("z", b + 2, j - b), lambda t: ~t["slot"]))
    # a slice is never empty where it is asked for: stretches of the length needed alone are looked into
    held = F.array_max(F.transform("since", lambda b, j: F.when((j - b >= need) & (literal(b, F.greatest(j, b + 1)) >= min_literals), j - b)))
    lines = lines.withColumn("same", F.array_max("same")).withColumn("held", F.when(F.col("by_template"), held))
    lines = lines.withColumn("exact", F.col("same") >= need).where("exact OR held IS NOT NULL")
    return lines.select("id", "text_key", "item_id", F.greatest(F.when(F.col("exact"), F.col("same")), "held").alias("run_tokens"), "exact")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Rows of docs whose text no item contaminates, all columns. The verdict is the text's, so it holds for rows that share an id, or have none, one by one."""
    by_text = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    bad = _found(by_text, benchmark, **how).select("text_key").distinct()
    return docs.join(bad, F.xxhash64(docs["text"]) == bad["text_key"], "left_anti").select(docs.columns)


def sql(window: int = 8, min_run: int = 13, min_literals: int = 5) -> str:
    """contaminated() over ``documents`` and ``benchmark`` in DuckDB SQL: a row for each token of a diagonal."""
    def q(x: str) -> str:
        for c in (NUM, NAME, UNIT, "\n"):
            x = x.replace(c, f"\\x{ord(c):02x}")
        return x.replace("'", "''")

    def put(x: str) -> str:
        return "'" + x.replace(NUM, "' || chr(1) || '").replace(NAME, "' || chr(2) || '").replace(UNIT, "' || chr(3) || '") + "'"

    t = "text"
    for pattern, (a, mark, b) in MARKS:
        t = f"regexp_replace({t}, '{q(pattern)}', {put(f'\\{a}{mark}\\{b}')}, 'g')"
    t = f"trim(lower(regexp_replace({t}, '{q(STRIP)}', ' ', 'g')))"
    t = f"regexp_replace({t}, '{q(UNIT_AFTER)}', {put(f'\\1{UNIT}\\2')}, 'g')"
    marks = "chr(1) || chr(2) || chr(3)"
    words = f"""SELECT row_number() OVER () AS k, id, w, len(w) AS n, list_transform(w, lambda x: translate(x, {marks}, '')) AS p,
      list_transform(w, lambda x: CASE WHEN x[1:1] IN (chr(1), chr(2), chr(3)) THEN x[1:1] ELSE x END) AS m
      FROM (SELECT id, string_split(t, ' ') AS w FROM (SELECT id, {t} AS t FROM (SELECT DISTINCT %s AS id, text FROM %s WHERE text IS NOT NULL AND %s IS NOT NULL)) WHERE t <> '')"""
    cut = "SELECT k, s, array_to_string({what}[s:s+{n}-1], ' ') AS h FROM (SELECT k, {what}, unnest(range(1, n - {n} + 2)) AS s FROM {table} WHERE {where})"
    literal = f"len(list_filter(m[p:p+{{n}}-1], lambda x: x NOT IN (chr(1), chr(2), chr(3)))) >= {min_literals}"
    parts, doc_parts = [], []
    for n in range(1, min_run):
        parts.append(f"SELECT k, 1 AS s, false AS t, {n} AS l, array_to_string(p, ' ') AS h FROM b WHERE n = {n}")
        doc_parts.append(f"SELECT k, s, false AS t, {n} AS l, h FROM ({cut.format(what='p', n=n, table='d', where=f'n >= {n} AND EXISTS (SELECT 1 FROM b WHERE b.n = {n})')})")
        if n < window:
            parts.append(f"SELECT k, 1 AS s, true AS t, {n} AS l, array_to_string(m, ' ') AS h FROM b WHERE n = {n} AND len(list_filter(m, lambda x: x NOT IN (chr(1), chr(2), chr(3)))) >= {min_literals}")
            doc_parts.append(f"SELECT k, s, true AS t, {n} AS l, h FROM ({cut.format(what='m', n=n, table='d', where=f'n >= {n} AND EXISTS (SELECT 1 FROM b WHERE b.n = {n})')})")
    parts.append(f"SELECT k, s, false AS t, {window} AS l, h FROM ({cut.format(what='p', n=window, table='b', where=f'n >= {min_run}')})")
    parts.append(f"SELECT k, p AS s, true AS t, {window} AS l, array_to_string(m[p:p+{window}-1], ' ') AS h FROM (SELECT k, m, unnest(range(1, n - {window} + 2)) AS p FROM b WHERE n >= {window}) WHERE {literal.format(n=window)}")
    doc_parts += [f"SELECT k, s, {'true' if what == 'm' else 'false'} AS t, {window} AS l, h FROM ({cut.format(what=what, n=window, table='d', where=f'n >= {window}')})" for what in "pm"]
    return f"""
WITH b AS MATERIALIZED ({words % ("item_id", "benchmark", "item_id")}), d AS MATERIALIZED ({words % ("doc_id", "documents", "doc_id")}),
i AS ({" UNION ALL ".join(parts)}), c AS ({" UNION ALL ".join(doc_parts)}),
g AS (SELECT c.k AS dk, i.k AS bk, c.s - i.s AS o, bool_or(t) AS t FROM c JOIN i USING (t, l, h) GROUP BY ALL),
z AS (SELECT g.*, n, j, x, y, u, v, coalesce(x = y, false) AS e, coalesce(u[1:1] IN (chr(1), chr(2), chr(3)) AND u[1:1] = v[1:1], false) AS a,
             coalesce(u[1:1] IN (chr(1), chr(2), chr(3)) OR v[1:1] IN (chr(1), chr(2), chr(3)), false) AS s
      FROM (SELECT g.*, b.n AS n, j, b.w[j + 1] AS u, b.p[j + 1] AS x, CASE WHEN o + j >= 0 THEN d.w[o + j + 1] END AS v, CASE WHEN o + j >= 0 THEN d.p[o + j + 1] END AS y
            FROM g JOIN b ON b.k = bk JOIN d ON d.k = dk, unnest(range(b.n)) AS r(j)) AS g),
f AS (SELECT l.dk, l.bk, l.o, l.j, max(f.j) AS stop FROM z l JOIN z f ON f.dk = l.dk AND f.bk = l.bk AND f.o = l.o AND f.j < l.j
      WHERE l.s AND f.s AND (l.e OR l.a) AND (f.e OR f.a) AND (f.x = l.x) <> (f.y = l.y) GROUP BY ALL),
w AS (SELECT z.*, max(CASE WHEN NOT (e OR a) THEN j ELSE coalesce(stop, -1) END) OVER p AS since, max(CASE WHEN e THEN -1 ELSE j END) OVER p AS eb,
             CAST(sum(CASE WHEN s THEN 0 ELSE 1 END) OVER p AS BIGINT) AS lits
      FROM z LEFT JOIN f USING (dk, bk, o, j) WINDOW p AS (PARTITION BY dk, bk, o ORDER BY j)),
r AS (SELECT w.dk, w.bk, w.j - w.eb AS same, w.n, CASE WHEN w.t AND w.j - w.since >= least({min_run}, w.n) AND w.lits - coalesce(q.lits, 0) >= {min_literals} THEN w.j - w.since END AS held
      FROM w LEFT JOIN w q ON q.dk = w.dk AND q.bk = w.bk AND q.o = w.o AND q.j = w.since)
SELECT d.id AS doc_id, b.id AS item_id, CAST(max(greatest(CASE WHEN same >= least({min_run}, r.n) THEN same END, held)) AS BIGINT) AS run_tokens,
       CASE WHEN bool_or(same >= least({min_run}, r.n)) THEN 'exact' ELSE 'reparameterised' END AS kind
FROM r JOIN d ON d.k = dk JOIN b ON b.k = bk WHERE same >= least({min_run}, r.n) OR held IS NOT NULL GROUP BY d.id, b.id
"""

"""Secret scans with SQL functions only: known forms by pattern, unknown ones by sliding-window entropy.

Base spans are the matches of three patterns. The method adds spans of kind
``entropy``: candidate strings are runs of at least ``WINDOW`` key characters, and a
candidate is taken if some window of it is as mixed as random characters of its class
(hexadecimal or base 64). A window's Shannon entropy is log2(n) - sum(c log2 c) / n over
its character counts c; sliding by one character changes two counts, and the sum is
kept in whole millionths, so the increments are exact. Candidates that are on the allow
list, and those inside a base span, are suppressed.

Positions count code points, ends are exclusive. Matches are placed by running sums of
the lengths of the stretches between them (``split``) and of their own. The sums go by
blocks, blocks of blocks and so on, so work grows with the number of matches and not with
its square, and no pattern repeats a group, so the stack does not grow with the text.

Defined results: a null or empty text has no span; its base digest is that of the empty
string. Repeated rows give repeated results, null ids are kept. Texts of any length are
scanned whole. All columns of the input pass through whatever their names are; only
columns that are named like the results of ``scan`` are replaced by them. An empty table
gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns and the least lengths of their matches.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"  # AKIA[A-Z0-9]+ of 20 or more: a shorter run has no longer match inside
HEX = r"[0-9a-f]{24,}"  # [0-9a-f]+ of 24 or more, likewise
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Characters of a window, and the least entropy in bits for hexadecimal and other candidates.
WINDOW, HEX_BITS, OTHER_BITS = 20, 3.2, 3.85
#: Candidates that are no secrets: words and phrases without digits, numbers, UUIDs.
ALLOWED = (
    r"^[A-Za-z+/_=-]*$",
    r"^[0-9+/_=-]*$",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)
#: Nor are dates and paths of short parts: candidates whose every part between separators is of this form.
SEPARATORS, ALLOWED_PART = r"[+/_=-]+", r"^[A-Za-z]{0,12}[0-9]{0,4}$"
#: c log2 c in millionths, for the counts that a window can hold.
PARTS = [round(1e6 * c * math.log2(c)) if c else 0 for c in range(WINDOW + 2)]
#: Entries of a block of a running sum, levels of blocks, and characters of a stretch that texts are cut from.
RUN, LEVELS, STRETCH = 64, 3, 4_096


def most_sum(bits: float) -> int:
    """The largest sum of c log2 c, in millionths, with which a window's entropy is at least ``bits``."""
    return math.floor(1e6 * WINDOW * (math.log2(WINDOW) - bits))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _running(xs: str, op: str, level: int = LEVELS) -> str:
    """SQL for the running totals of the array of whole numbers ``xs`` (a name) under ``op`` (of ``x`` and ``y``; 0 is neutral)."""

    def both(x: str, y: str) -> str:
        return op.format(x=x, y=y)

    if not level:
        return f"transform({xs}, (v0, i0) -> aggregate(slice({xs}, 1, i0 + 1), 0, (a0, x0) -> {both('a0', 'x0')}))"
    k = level
    block = f"""aggregate(slice({xs}, b{k} * {RUN} + 1, {RUN}), named_struct('at', 0, 'out', cast(array() AS array<int>)),
        (a{k}, x{k}) -> named_struct('at', {both(f"a{k}.at", f"x{k}")}, 'out', array_append(a{k}.out, {both(f"a{k}.at", f"x{k}")})), a{k} -> a{k}.out)"""
    shifted = f"flatten(transform(local{k}, (l{k}, j{k}) -> if(j{k} = 0, l{k}, transform(l{k}, x{k} -> {both(f'x{k}', f'before{k}[j{k} - 1]')}))))"
    joined = _let(f"totals{k}", f"transform(local{k}, l{k} -> element_at(l{k}, -1))", _let(f"before{k}", _running(f"totals{k}", op, level - 1), shifted))
    blocks = f"transform(sequence(0, (size({xs}) - 1) div {RUN}), b{k} -> {block})"
    return f"if(size({xs}) = 0, {xs}, {_let(f'local{k}', blocks, f'if(size(local{k}) = 1, local{k}[0], {joined})')})"


SPAN = "struct<start:int,rank:int,kind:string,stop:int,m:string,g:string>"


def _spans(text: str, pattern: str, kind: str, rank: int, keep_if: str = "true", group: int = 0) -> str:
    """SQL for the array of spans of a pattern; ``keep_if`` may read ``m`` (the match) and ``g`` (the group)."""
    p = _quoted(pattern)
    every = f"regexp_extract_all({text}, {p}, 0)"
    found = f"""filter(transform(ms, (m, i) -> named_struct('start', stops[i] - sizes[i], 'rank', {rank}, 'kind', '{kind}', 'stop', stops[i], 'm', m, 'g', {"gs[i]" if group else "m"})), x -> {keep_if})"""
    if group:
        found = _let("gs", f"regexp_extract_all({text}, {p}, {group})", found)
    steps = f"zip_with(slice(split({text}, {p}, -1), 1, size(ms)), sizes, (gap, size) -> char_length(gap) + size)"
    placed = _let("steps", steps, _let("stops", _running("steps", "{x} + {y}"), found))
    return f"CASE WHEN {text} RLIKE {p} THEN {_let('ms', every, _let('sizes', 'transform(ms, m -> char_length(m))', placed))} ELSE cast(array() AS array<{SPAN}>) END"


def _least_sum(candidate: str) -> str:
    """SQL for the least sum of c log2 c over the windows of a candidate, by incremental counts."""
    places = f"transform(filter(split({candidate}, ''), c -> c <> ''), c -> instr('{ALPHABET}', c))"
    parts = "array(" + ",".join(f"{p}L" for p in PARTS) + ")"
    return f"""aggregate(
        transform({places}, (p, i) -> named_struct('p', p, 'i', i)),
        named_struct('n', array_repeat(0, {len(ALPHABET) + 1}), 'sum', 0L, 'least', 9223372036854775807L, 'held', cast(array() AS array<int>)),
        (a, x) -> named_struct(
            'n', transform(a.n, (v, k) -> v + if(k = x.p, 1, 0) - if(x.i >= {WINDOW} AND k = a.held[0], 1, 0)),
            'sum', a.sum + {parts}[a.n[x.p] + 1] - {parts}[a.n[x.p]]
                + if(x.i >= {WINDOW}, {parts}[a.n[a.held[0]] + if(a.held[0] = x.p, 1, 0) - 1] - {parts}[a.n[a.held[0]] + if(a.held[0] = x.p, 1, 0)], 0L),
            'least', if(x.i >= {WINDOW} - 1, least(a.least, a.sum + {parts}[a.n[x.p] + 1] - {parts}[a.n[x.p]]
                + if(x.i >= {WINDOW}, {parts}[a.n[a.held[0]] + if(a.held[0] = x.p, 1, 0) - 1] - {parts}[a.n[a.held[0]] + if(a.held[0] = x.p, 1, 0)], 0L)), a.least),
            'held', array_append(if(x.i >= {WINDOW}, slice(a.held, 2, {WINDOW}), a.held), x.p)),
        a -> a.least)"""


def _found(docs: DataFrame, text: str) -> DataFrame:
    """``row`` (the columns of ``docs``), ``text`` (null: empty), ``spans`` (all, by start, then kind) and ``reach`` (the furthest stop up to each)."""
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    allowed = " OR ".join([f"x.m RLIKE {_quoted(p)}" for p in ALLOWED] + [f"forall(split(x.m, {_quoted(SEPARATORS)}), part -> part RLIKE {_quoted(ALLOWED_PART)})"])
    least = f"if(x.m RLIKE '^[0-9a-fA-F]+$', {most_sum(HEX_BITS)}L, {most_sum(OTHER_BITS)}L)"
    every = f"""array_sort(concat(
        {_spans("text", ASSIGN, "assign", 0, f"char_length(x.g) >= {ASSIGN_LEAST}", 2)},
        {_spans("text", ACCESS, "access", 1)},
        {_spans("text", HEX, "hex", 2)},
        {_spans("text", CANDIDATE, "entropy", 3, f"NOT ({allowed}) AND {_least_sum('x.m')} <= {least}")}))"""
    furthest = _let("ends", "transform({}, x -> if({}, x.stop, 0))", _running("ends", "greatest({x}, {y})"))
    held = held.withColumn("every", F.expr(every))
    inside = _let("reach", furthest.format("every", "x.rank < 3"), "filter(every, (x, i) -> x.rank < 3 OR x.stop > reach[i])")
    held = held.withColumn("spans", F.expr(f"if(size(every) < 2, every, {inside})")).drop("every")
    return held.withColumn("reach", F.expr(furthest.format("spans", "true")))


def scan(docs: DataFrame, text: str = "text", base: str = "_base", added: str = "_added") -> DataFrame:
    """``docs`` with the columns ``base`` and ``added``: arrays of spans (start, rank, kind, stop, m, g) in order of start, then kind."""
    found = _found(docs, text).select("row", F.expr("filter(spans, x -> x.rank < 3)").alias("base"), F.expr("filter(spans, x -> x.rank = 3)").alias("added"))
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in (base, added)], F.col("base").alias(base), F.col("added").alias(added))


def joined(spans: str | Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")


def _cut(start: str, stop: str) -> str:
    """SQL for the characters of a text from ``start`` to before ``stop``, by its ``parts`` of STRETCH characters."""
    parts = f"array_join(slice(parts, {start} div {STRETCH} + 1, {stop} div {STRETCH} - {start} div {STRETCH} + 1), '')"
    return f"substring({parts}, {start} % {STRETCH} + 1, {stop} - {start})"


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span (base and added, overlapping ones as one) replaced by ``mark`` in ``text``."""
    found = _found(docs, text)
    before = "if(i = 0, 0, reach[i - 1])"
    pieces = f"transform(spans, (x, i) -> if(x.start >= {before}, concat({_cut(before, 'x.start')}, {_quoted(mark)}), ''))"
    whole = _let("parts", f"regexp_extract_all(text, '(?s).{{1,{STRETCH}}}', 0)", f"concat(array_join({pieces}, ''), {_cut('element_at(reach, -1)', 'char_length(text)')})")
    cut = F.expr(f"CASE WHEN size(spans) > 0 THEN {whole} ELSE row.`{text}` END")
    return found.withColumn("text", cut).select(*[F.col("text").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def op10_secrets(spark, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    every = F.array_sort(F.concat("_base", "_added"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("_base").cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_spans(kind: str, rank: int, pattern: str, where: str, group: int = 0) -> str:
    p = _sql_text(pattern)
    return f"""SELECT doc_id, row_no, '{kind}' AS kind, {rank} AS rank, m, g,
        list_sum(list_transform(gaps[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda s: length(s))), 0) AS start
      FROM (SELECT doc_id, row_no, gaps, ms, unnest(ms) AS m, unnest(gs) AS g, unnest(range(1, len(ms) + 1)) AS i
            FROM (SELECT doc_id, row_no, string_split_regex(t, {p}) AS gaps, regexp_extract_all(t, {p}, 0) AS ms, regexp_extract_all(t, {p}, {group}) AS gs FROM docs WHERE regexp_matches(t, {p})))
      WHERE {where}"""


_PARTS_SQL = "[" + ",".join(str(p) for p in PARTS) + "]"
OP10_SQL = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS row_no, coalesce(text, '') AS t FROM documents),
base AS (
  {_sql_spans("assign", 0, ASSIGN, f"length(g) >= {ASSIGN_LEAST}", 2)}
  UNION ALL {_sql_spans("access", 1, ACCESS, "true")}
  UNION ALL {_sql_spans("hex", 2, HEX, "true")}),
candidates AS ({_sql_spans("entropy", 3, CANDIDATE, " AND ".join([f"NOT regexp_matches(m, {_sql_text(p)})" for p in ALLOWED] + [f"len(list_filter(string_split_regex(m, {_sql_text(SEPARATORS)}), lambda part: NOT regexp_matches(part, {_sql_text(ALLOWED_PART)}))) > 0"]))}),
windows AS (
  SELECT row_no, start, m, substr(m, CAST(k AS INTEGER), {WINDOW}) AS w
  FROM (SELECT row_no, start, m, unnest(range(1, length(m) - {WINDOW} + 2)) AS k FROM candidates)),
sums AS (
  SELECT row_no, start, m, list_sum(list_transform(map_values(list_histogram(string_split(w, ''))), lambda c: {_PARTS_SQL}[CAST(c AS INTEGER) + 1])) AS total FROM windows),
mixed AS (
  SELECT row_no, start, m FROM sums GROUP BY row_no, start, m
  HAVING min(total) <= CASE WHEN regexp_matches(m, '^[0-9a-fA-F]+$') THEN {most_sum(HEX_BITS)} ELSE {most_sum(OTHER_BITS)} END),
added AS (
  SELECT c.* FROM candidates c SEMI JOIN mixed x ON c.row_no = x.row_no AND c.start = x.start
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.row_no = c.row_no AND b.start <= c.start AND c.start + length(c.m) <= b.start + length(b.m))),
shown AS (
  SELECT row_no, kind, rank, start, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT) AS span FROM (SELECT * FROM base UNION ALL SELECT * FROM added)),
per_doc AS (
  SELECT row_no, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
         coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank < 3), '') AS base_spans, string_agg(span, ',' ORDER BY start, rank) AS spans
  FROM shown GROUP BY row_no)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs d LEFT JOIN per_doc p ON d.row_no = p.row_no
"""

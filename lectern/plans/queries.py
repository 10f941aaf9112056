"""The registered queries, each with its SQL where SQL can express it.

Every query runs over its whole tables. Names follow the operators of the survey."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udf as U
from ..functions.spread import spread
from ..operators import align, confidence, edits, fidelity, guards, identity, linking, planning, rules
from ..operators.policies import PlanPolicy
from ..sources import ocr_xml, rewrite
from . import correction, relational
from .store import written
from .views import (
    SQL_BROKEN, SQL_CHAIN_LINKS, SQL_LINES, SQL_LINKED, SQL_NOISY, SQL_PLANTED, broken, chain_links, in_page, lines, linked, noisy, planted, table,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col
# Python's white space and break marks for RE2.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
MK = r"[\-\x{ac}\x{2e17}\x{ad}\x{2010}\x{2011}]"


def toks(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda t: t <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- scans and text functions ------------------------------------------------------------------


@query(f"WITH {SQL_LINES} SELECT page_id, line_id, ord, text FROM lines")
def scan_lines(spark, d):
    return lines(spark, d).select("page_id", "line_id", "ord", "text")


@query(f"WITH {SQL_LINES} SELECT page_id, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM lines GROUP BY 1")
def page_totals(spark, d):
    return planning.page_totals(lines(spark, d))


@query(r"""SELECT page_id, lower(regexp_extract(html, '(?i)charset=["'']?([A-Za-z0-9_-]+)', 1)) AS declared,
  'sha256:' || sha256(coalesce(html, '')) AS digest,
  lower(regexp_extract(html, '(?i)charset=["'']?([A-Za-z0-9_-]+)', 1)) IN ('iso-8859-1', 'latin1', 'windows-1252', 'us-ascii')
    AND NOT regexp_full_match(coalesce(html, ''), '(?s)[\x00-\x7f]*') AS mislabelled FROM pages""")
def encoding_gate(spark, d):
    html = F.coalesce("html", F.lit(""))
    declared = F.lower(F.regexp_extract(html, "(?i)charset=[\"']?([A-Za-z0-9_-]+)", 1))
    latin = declared.isin("iso-8859-1", "latin1", "windows-1252", "us-ascii")
    utf8 = F.is_valid_utf8(html) & html.rlike(r"[^\x00-\x7f]")
    return table(spark, d, "pages").select("page_id", declared.alias("declared"), T.source_digest(html.cast("binary")).alias("digest"),
                                           (latin & utf8).alias("mislabelled"))


@query(f"""WITH {SQL_LINES} SELECT line_id,
  regexp_replace(nfc_normalize(text), '[\\x00-\\x1f\\x7f-\\x{{9f}}\\x{{ad}}\\x{{200b}}-\\x{{200d}}\\x{{feff}}]', '', 'g') AS cleaned FROM lines""")
def clean_content(spark, d):
    return lines(spark, d).select("line_id", T.clean_content(U.nfc(C("text"))).alias("cleaned"))


@query(f"WITH {SQL_LINES} SELECT line_id, nfc_normalize({SQL_NOISY}) AS nfc, length(nfc_normalize({SQL_NOISY})) AS n FROM lines")
def nfc_text(spark, d):
    return lines(spark, d).select("line_id", U.nfc(noisy(C("text"))).alias("nfc")).withColumn("n", F.length("nfc").cast("long"))


@query(f"WITH {SQL_LINES} SELECT line_id, CAST(len({toks('text')}) AS INTEGER) AS n_tokens, {toks('text')}[1] AS first, {toks('text')}[-1] AS last FROM lines")
def py_token_counts(spark, d):
    x = C("text")
    return lines(spark, d).select("line_id", T.token_count(x).alias("n_tokens"), T.first_token(x).alias("first"), T.last_token(x).alias("last"))


@query(f"""WITH {SQL_BROKEN} SELECT line_id, regexp_matches(text, '{MK}{WS}*$') AS ends, regexp_replace(text, '{MK}+$', '') AS stripped,
  nullif(regexp_extract(text, '\\p{{L}}({MK}){WS}*$', 1), '') AS mark FROM broken""")
def break_marks(spark, d):
    x = C("text")
    return broken(spark, d).select("line_id", T.ends_with_break_mark(x).alias("ends"), T.strip_trailing_break_marks(x).alias("stripped"),
                                   T.trailing_hyphen_char(x).alias("mark"))


@query(f"""WITH {SQL_BROKEN} SELECT line_id,
  CASE WHEN regexp_matches(text, '-$') THEN regexp_replace(text, '-$', '-') ELSE regexp_replace(text, '-$', '') || '¬' END AS kept FROM broken""")
def preserve_break_char(spark, d):
    other = F.concat(F.regexp_replace("text", "-$", ""), F.lit("¬"))
    return broken(spark, d).select("line_id", T.preserve_break_char(C("text"), other).alias("kept"))


@query(f"WITH {SQL_LINES} SELECT line_id, substr(sha256(text), 1, 16) AS digest FROM lines")
def line_digest(spark, d):
    return lines(spark, d).select("line_id", T.line_digest(C("text")).alias("digest"))


@query("SELECT doc_id, 'sha256:' || sha256(coalesce(text, '')) AS digest FROM documents")
def source_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", T.source_digest(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


_SCORE = f"""(SELECT CASE WHEN len(w) = 0 THEN 0.0 ELSE len(list_filter(w, lambda t: regexp_matches(t, '\\p{{L}}\\p{{N}}|\\p{{N}}\\p{{L}}'))) / len(w) END
  FROM (SELECT list_filter(list_transform({toks('text')}, lambda t: regexp_replace(t, '^[.,;:!?()\\[\\]{{}}«»"''—–\\-…]+|[.,;:!?()\\[\\]{{}}«»"''—–\\-…]+$', '', 'g')),
    lambda t: regexp_matches(t, '[\\p{{L}}\\p{{N}}]')) AS w))"""


@query(f"WITH {SQL_LINES} SELECT line_id, {_SCORE} AS score FROM lines")
def qe_score(spark, d):
    return lines(spark, d).select("line_id", T.quality_score(C("text")).alias("score"))


@query(f"""WITH {SQL_LINES}, scored AS (SELECT lang, {_SCORE} AS score FROM lines)
SELECT lang, CASE WHEN score <= 0.0 THEN 'skip' WHEN score >= 0.3 THEN 'escalate' ELSE 'llm' END AS tier, count(*) AS n FROM scored GROUP BY 1, 2""")
def qe_route_hist(spark, d):
    tier = T.route(T.quality_score(C("text")), 0.0, 0.3)
    return lines(spark, d).select("lang", tier.alias("tier")).groupBy("lang", "tier").agg(F.count("*").alias("n"))


@query("""SELECT event_id, 'call ' || event_id || ' failed: {"api_key": "****", "user": ' || user_id || ', token=****&page=2} Authorization: Bearer **** sk-AbCd**** x-auth-token: **** end' AS message FROM events""")
def sanitize_errors(spark, d):
    """Secrets of every shape planted in a message; the SQL says what should be left, not how it is found."""
    n, user = C("event_id").cast("string"), C("user_id").cast("string")
    message = F.concat(F.lit("call "), n, F.lit(' failed: {"api_key": "K'), n, F.lit('-s3cret", "user": '), user, F.lit(", token=t"), n, F.lit("&page=2} Authorization: Bearer abc."), n,
                       F.lit("/+= sk-AbCd"), n, F.lit("xyz x-auth-token: t,"), user, F.lit(" end"))
    return table(spark, d, "events").select("event_id", T.sanitize_error(message).alias("message"))


_POINTS = "concat(c_custkey % 97, ',', c_custkey % 89, ' ', c_custkey % 101, ',', c_nationkey, ' bad,x ', c_nationkey * 3, ',', c_custkey % 53)"


@query("""SELECT c_custkey, least(c_custkey % 97, c_custkey % 101, c_nationkey * 3) AS hpos, least(c_custkey % 89, c_nationkey, c_custkey % 53) AS vpos,
  greatest(c_custkey % 97, c_custkey % 101, c_nationkey * 3) - least(c_custkey % 97, c_custkey % 101, c_nationkey * 3) AS width,
  greatest(c_custkey % 89, c_nationkey, c_custkey % 53) - least(c_custkey % 89, c_nationkey, c_custkey % 53) AS height FROM customer""")
def polygon_bbox(spark, d):
    box = T.polygon_bbox(F.expr(_POINTS))
    return table(spark, d, "customer").select("c_custkey", box.alias("b")).select(
        "c_custkey", *[C(f"b.{x}").cast("long").alias(x) for x in ("hpos", "vpos", "width", "height")])


@query("""SELECT c_custkey, greatest(0, x - 4) AS "left", greatest(0, y - 4) AS top, least(90, x + 24) AS "right", least(60, y + 14) AS bottom
FROM (SELECT c_custkey, c_custkey % 97 AS x, c_custkey % 89 AS y FROM customer) WHERE least(90, x + 24) > greatest(0, x - 4) AND least(60, y + 14) > greatest(0, y - 4)""")
def crop_boxes(spark, d):
    box = F.struct((C("c_custkey") % 97).alias("hpos"), (C("c_custkey") % 89).alias("vpos"), F.lit(20).alias("width"), F.lit(10).alias("height"))
    crop = T.clamp_box(box, F.lit(90), F.lit(60), 4)
    return table(spark, d, "customer").select("c_custkey", crop.alias("b")).where("b is not null").select(
        "c_custkey", *[C(f"b.{x}").cast("long").alias(x) for x in ("left", "top", "right", "bottom")])


# --- the rules producer ------------------------------------------------------------------------


@query(f"WITH {SQL_LINES} SELECT line_id, replace(replace(replace({SQL_NOISY}, 'ſ', 's'), 'ﬁ', 'fi'), 'ﬂ', 'fl') AS corrected, "
       f"CAST(length(regexp_replace({SQL_NOISY}, '[^ſﬁﬂ]', '', 'g')) AS INTEGER) AS n_spans FROM lines")  # fmt: skip
def rules_correct(spark, d):
    return rules.correct_with_rules(lines(spark, d).withColumn("text", noisy(C("text")))).select("line_id", "corrected", "n_spans")


@query(f"""WITH {SQL_LINES}, chars AS (
  SELECT line_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS start FROM (SELECT line_id, string_split({SQL_NOISY}, '') AS l FROM lines))
SELECT line_id, CAST(start AS INTEGER) AS start, CASE c WHEN 'ſ' THEN 's' WHEN 'ﬁ' THEN 'fi' ELSE 'fl' END AS text FROM chars WHERE c IN ('ſ', 'ﬁ', 'ﬂ')""")
def rules_spans(spark, d):
    found = rules.literal_spans(noisy(C("text")), rules.default_rules())
    return lines(spark, d).select("line_id", F.inline(found)).select("line_id", "start", "text")


_LEXICON = ["pfie", "pfiege", "enbepfie", "einpfie", "enpfie", "verpfie", "enerpfie", "ofingbleer", "ofinerin"]  # words of the tables


@query(f"""WITH {SQL_LINES}, t AS (SELECT line_id, string_split({SQL_NOISY}, ' ') AS w FROM lines)
SELECT line_id, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) - length(replace(x, 'ﬁ', '')) = 1 AND NOT contains(x, 'ſt')
    AND trim(lower(replace(x, 'ﬁ', 'fi')), ' .,;:!?''"()[]«»—–-') IN ({", ".join(f"'{x}'" for x in _LEXICON)}) THEN replace(x, 'ﬁ', 'fi') ELSE replace(x, 'ſt', 'st') END), ' ') AS corrected FROM t""")
def rules_regex(spark, d):
    """A pattern, and a rule that is guarded by a lexicon: a word with one ligature is changed if the new word is known."""
    rows = lines(spark, d).withColumn("text", noisy(C("text")))
    table_ = [rules.Rule("(?:ſ)(t)", r"s\1", regex=True, name="long s"), rules.Rule("ﬁ", "fi", guarded=True, name="ligature")]
    return rules.correct_with_rules(rows, table_, set(_LEXICON)).select("line_id", "corrected")


# --- identity ----------------------------------------------------------------------------------


@query("SELECT text, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return identity.duplicates(table(spark, d, "documents"), "text")


@query("SELECT doc_id FROM documents WHERE doc_id % 10 < 2")
def missing_ids(spark, d):
    """Ids that are empty or null by turns."""
    name = F.when(C("doc_id") % 10 == 0, F.lit("")).when(C("doc_id") % 10 > 1, C("doc_id").cast("string"))
    return identity.missing(table(spark, d, "documents").withColumn("name", name), "name").select("doc_id")


@query("""WITH p AS (SELECT doc_id % 300 AS page_id, source FROM documents),
n AS (SELECT page_id, count(DISTINCT source) AS files FROM p GROUP BY 1)
SELECT CASE WHEN files > 1 THEN source || '::' || page_id ELSE CAST(page_id AS VARCHAR) END AS page_id, count(*) AS n FROM p JOIN n USING (page_id) GROUP BY 1""")
def disambiguate_pages(spark, d):
    p = table(spark, d, "documents").select((C("doc_id") % 300).cast("string").alias("page_id"), C("source").alias("source_file"))
    return identity.disambiguate_pages(p).groupBy("page_id").agg(F.count("*").alias("n"))


# --- hyphens -----------------------------------------------------------------------------------


@query(f"WITH {SQL_LINKED} SELECT line_id, role0 AS role FROM roles")
def hyphen_roles(spark, d):
    return linking.heuristic_roles(broken(spark, d)).select("line_id", "role")


@query(f"WITH {SQL_LINKED} SELECT line_id, role, next_line, prev_line FROM linked WHERE next_line IS NOT NULL OR prev_line IS NOT NULL")
def hyphen_pairs(spark, d):
    return linked(spark, d).where("next_line is not null or prev_line is not null").select("line_id", "role", "next_line", "prev_line")


@query(f"WITH {SQL_CHAIN_LINKS} SELECT line_id, role FROM linked WHERE (role IN ('PART1', 'BOTH') AND next_line IS NULL) OR (role IN ('PART2', 'BOTH') AND prev_line IS NULL)")
def unpaired_breaks(spark, d):
    return linking.unpaired_breaks(chain_links(spark, d)).select("line_id", "role")


_UNITS = SQL_LINKED + """,
started AS (SELECT *, sum(CASE WHEN prev_line IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord) AS unit_no
  FROM linked WHERE next_line IS NOT NULL OR prev_line IS NOT NULL),
units AS (SELECT page_id, line_id, ord, text, first_value(line_id) OVER u AS unit_id, row_number() OVER u - 1 AS member,
  count(*) OVER (PARTITION BY page_id, unit_no) AS size FROM started WINDOW u AS (PARTITION BY page_id, unit_no ORDER BY ord))"""


@query(f"WITH {_UNITS} SELECT line_id, unit_id, CAST(member AS INTEGER) AS member, size FROM units")
def hyphen_units(spark, d):
    return linking.units(linked(spark, d), doc="page_id").select("line_id", "unit_id", "member", "size")


_CHAINS = SQL_CHAIN_LINKS + _UNITS[len(SQL_LINKED):]


@query(f"WITH {SQL_CHAIN_LINKS} SELECT line_id, role, next_line, prev_line FROM linked")
def chain_roles(spark, d):
    """Roles of all lines where words run over three lines: BOTH in the middle."""
    return chain_links(spark, d).select("line_id", "role", "next_line", "prev_line")


@query(f"WITH {_CHAINS} SELECT size, count(*) // size AS n FROM units GROUP BY size")
def unit_sizes(spark, d):
    return linking.units(chain_links(spark, d), doc="page_id").where("member = 0").groupBy("size").agg(F.count("*").alias("n"))


@query(f"WITH {_CHAINS} SELECT line_id, CASE WHEN size <= 2 THEN unit_id ELSE unit_id || '#' || (member // 2) END AS unit_id_final, member > 0 AND member % 2 = 0 AS split FROM units")
def unit_splits(spark, d):
    """Units of three and more cut after every second line."""
    return linking.split_units(linking.units(chain_links(spark, d), doc="page_id"), 2).select("line_id", "unit_id_final", "split")


@query(f"""WITH {_UNITS}, flagged AS (SELECT line_id, unit_id, ord % 7 = 3 AS hit FROM units)
SELECT line_id, bool_or(hit) OVER (PARTITION BY unit_id) AS revert FROM flagged""")
def unit_closure(spark, d):
    u = linking.units(linked(spark, d), doc="page_id").withColumn("revert", C("ord") % 7 == 3)
    return linking.close_over_units(u, doc="page_id").select("line_id", "revert")


# --- planning ----------------------------------------------------------------------------------


@query(f"""WITH {SQL_LINES}, b AS (SELECT page_id, ord // 20 AS g, count(*) AS n, sum(length(text)) AS c FROM lines GROUP BY 1, 2)
SELECT page_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(c) AS BIGINT) AS n_chars,
  CASE WHEN sum(c) <= 2000 AND sum(n) <= 80 THEN 'page' WHEN bool_and(c <= 2000 AND n <= 80) THEN 'block' ELSE 'window' END AS granularity FROM b GROUP BY 1""")
def chunk_page_or_block(spark, d):
    rows = lines(spark, d).withColumn("group_id", F.floor(C("ord") / 20))
    return planning.granularity(rows, PlanPolicy(max_chars=2000))


@query(f"""WITH {SQL_LINES}, w AS (
  SELECT page_id, ord, unnest(range(greatest(0, CAST(floor((ord - 12) / 11.0) AS BIGINT) + 1), ord // 11 + 1)) AS window_ix FROM lines)
SELECT page_id, CAST(window_ix AS INTEGER) AS window_ix, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n FROM w GROUP BY 1, 2""")
def chunk_windows_fixed(spark, d):
    return planning.fixed_windows(lines(spark, d)).groupBy("page_id", "window_ix").agg(
        F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_CHAINS},
l AS (SELECT b.page_id, b.line_id, length(b.text) AS c, u.unit_id, row_number() OVER (PARTITION BY b.page_id ORDER BY b.ord) - 1 AS i FROM broken b LEFT JOIN units u USING (line_id)),
e AS (SELECT *, CASE WHEN unit_id IS NULL THEN i ELSE min(i) OVER (PARTITION BY page_id, unit_id) END AS head,
  CASE WHEN unit_id IS NULL THEN i ELSE max(i) OVER (PARTITION BY page_id, unit_id) END AS tail FROM l),
p AS (SELECT page_id, count(*) AS n, list(c ORDER BY i) AS c, list(tail ORDER BY i) AS tails FROM e GROUP BY 1),
w(page_id, k, a, b, core) AS (
  SELECT page_id, -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM p
  UNION ALL
  SELECT page_id, k + 1, s, least(greatest(core2, tails[core2] + 1), n, s + greatest(80, core2 - s + 10)), core2
  FROM (SELECT page_id, k, s, n, tails, s + greatest(1, len(list_filter(range(1, least(s + 12, n) - s + 1), lambda j: list_sum(c[s + 1:s + j]) <= 300))) AS core2
    FROM (SELECT w.page_id, k, n, c, tails, CASE WHEN k < 0 THEN 0 ELSE greatest(a + 1, CASE WHEN core < least(a + 12, n) THEN core ELSE a + 12 END - 1) END AS s FROM w JOIN p USING (page_id))
    WHERE s < n)),
held AS (SELECT e.page_id, e.line_id, e.unit_id, e.i, e.head, max(k) AS any_k, max(b) AS any_b, max(k) FILTER (a <= head AND tail < b) AS whole_k
  FROM e JOIN w ON e.page_id = w.page_id AND k >= 0 AND a <= i AND i < b GROUP BY ALL),
owned AS (SELECT h.page_id, CASE WHEN h.whole_k IS NOT NULL THEN h.whole_k WHEN h.i < f.any_b THEN f.any_k ELSE h.any_k END AS k
  FROM held h LEFT JOIN (SELECT page_id, unit_id, any_k, any_b FROM held WHERE i = head AND unit_id IS NOT NULL) f ON h.page_id = f.page_id AND h.unit_id = f.unit_id),
counted AS (SELECT page_id, k, count(*) AS n FROM owned GROUP BY 1, 2)
SELECT w.page_id, k AS chunk_ix, CAST(b - a AS INTEGER) AS n_lines, CAST(coalesce(n, 0) AS INTEGER) AS n_targets FROM w LEFT JOIN counted USING (page_id, k) WHERE k >= 0""")
def chunk_windows(spark, d):
    """Windows with a budget that keep units whole; every line is the target of one."""
    return planning.plan_windows(linking.with_units(chain_links(spark, d), doc="page_id"), PlanPolicy(max_chars=300)).select(
        "page_id", "chunk_ix", F.size("line_ids").alias("n_lines"), F.size("target_ids").alias("n_targets"))


@query(f"""WITH {_UNITS}, keyed AS (SELECT b.page_id, coalesce(u.unit_id, 'line:' || b.line_id) AS unit, b.line_id FROM broken b LEFT JOIN units u USING (line_id))
SELECT page_id, unit, count(*) AS n FROM keyed GROUP BY 1, 2""")
def chunk_units(spark, d):
    planned = planning.plan_units(linking.with_units(linked(spark, d), doc="page_id"))
    return planned.groupBy("page_id", "unit").agg(F.sum(F.size("line_ids")).alias("n"))


@query(f"WITH {SQL_LINES} SELECT line_id, lag(text) OVER w AS prev_text, lead(text) OVER w AS next_text FROM lines WINDOW w AS (PARTITION BY page_id ORDER BY ord)")
def enrich_neighbours(spark, d):
    rows = linking.pair_fields(lines(spark, d).withColumn("role", F.lit("NONE")), in_page())
    return rows.select("line_id", "prev_text", "next_text")


# --- edit scripts ------------------------------------------------------------------------------


def _targets(spark, d):
    return lines(spark, d).select("page_id", "line_id", "text", (C("ord") % 5 != 4).alias("is_target"), F.lit("NONE").alias("role"), "ord")


def _ops(spark, d):
    """For the first word of each line: a span by match; for every third line a whole-line op, some of them bad."""
    rows = _targets(spark, d)
    null = lambda t: F.lit(None).cast(t)
    word = F.regexp_extract("text", "^[A-Za-z]+", 0)
    span = rows.where(C("ord") % 3 != 0).where(word != "").select(
        "page_id", "line_id", F.lit(0).alias("op_ix"), F.lit("replace_span").alias("op"), F.upper(word).alias("text"),
        null("int").alias("start"), null("int").alias("end"), word.alias("match"), null("int").alias("occurrence"), null("string").alias("digest"))
    whole = rows.where(C("ord") % 3 == 0).select(
        "page_id", "line_id", F.lit(0).alias("op_ix"), F.lit("replace_line").alias("op"),
        F.when(C("ord") % 2 == 0, F.concat("text", F.lit("!"))).otherwise(F.lit(" ")).alias("text"), null("int").alias("start"),
        null("int").alias("end"), null("string").alias("match"), null("int").alias("occurrence"),
        F.when(C("ord") % 4 == 0, T.line_digest(C("text"))).when(C("ord") % 4 == 2, F.lit("0000")).alias("digest"))
    stray = rows.where("ord = 0").select(
        "page_id", F.concat("line_id", F.lit("x")).alias("line_id"), F.lit(0).alias("op_ix"), F.lit("replace_line").alias("op"), F.lit("y").alias("text"),
        null("int").alias("start"), null("int").alias("end"), null("string").alias("match"), null("int").alias("occurrence"), null("string").alias("digest"))
    return span.unionByName(whole).unionByName(stray)


_OCC = "(length(text) - length(replace(text, w, ''))) // length(w)"
_JUDGED = SQL_LINES + """,
t AS (SELECT *, ord % 5 <> 4 AS is_target, regexp_extract(text, '^[A-Za-z]+') AS w FROM lines),
ops AS (
  SELECT line_id, 'replace_span' AS op, text, upper(w) AS new, CASE WHEN NOT is_target THEN 'e1_context_line'
    WHEN list_sum(list_transform(range(1, length(text) + 1), lambda i: CASE WHEN substr(text, i, length(w)) = w THEN 1 ELSE 0 END)) > 1 THEN 'anchor_ambiguous' END AS reason,
    upper(w) || substr(text, length(w) + 1) AS result
  FROM t WHERE ord % 3 <> 0 AND w <> ''
  UNION ALL
  SELECT line_id, 'replace_line', text, NULL, CASE WHEN NOT is_target THEN 'e1_context_line' WHEN ord % 4 = 2 THEN 'precondition_source_digest'
    WHEN ord % 2 = 1 THEN 'e3_empty' END, text || '!' FROM t WHERE ord % 3 = 0
  UNION ALL SELECT line_id || 'x', 'replace_line', NULL, NULL, 'e1_unknown_line', NULL FROM t WHERE ord = 0)"""


@query(f"WITH {_JUDGED} SELECT line_id, result FROM ops WHERE reason IS NULL")
def edit_apply(spark, d):
    return edits.apply_script(_ops(spark, d), _targets(spark, d))[0].select("line_id", "result")


@query(f"WITH {_JUDGED} SELECT op, reason, count(*) AS n FROM ops WHERE reason IS NOT NULL GROUP BY 1, 2")
def edit_rejections(spark, d):
    return edits.apply_script(_ops(spark, d), _targets(spark, d))[1].groupBy("op", "reason").agg(F.count("*").alias("n"))


# --- guards ------------------------------------------------------------------------------------


def _pairs(spark, d):
    """Pairs of linked lines, also of words over three lines, and proposals by turns: the same; the second's words in the first; the
    second grown by words; another first word in the second; no mark in the first."""
    rows = chain_links(spark, d)
    # a link leads to the next line with text, so its text is a ``lead``, as in ``link_lines``
    w = Window.partitionBy("page_id", "filled").orderBy("ord")
    rows = rows.withColumn("filled", F.coalesce(T.py_strip(C("text")) != "", F.lit(False))).withColumn("ocr2", F.lead("text").over(w))
    pairs = rows.where("next_line is not null").withColumnRenamed("text", "ocr1")
    turn, bare = F.floor(C("ord") / 2) % 5, F.regexp_replace("ocr1", "-$", "")
    return pairs.select("line_id", "ord", "ocr1", "ocr2", F.when(turn == 1, F.concat(bare, "ocr2")).when(turn == 4, bare).otherwise(C("ocr1")).alias("new1"),
                        F.when(turn == 1, T.last_token(C("ocr2"))).when(turn == 2, F.concat("ocr2", F.lit(" et la"))).when(turn == 3, F.concat(F.lit("zz"), "ocr2")).otherwise(
                            C("ocr2")).alias("new2"), F.lit(False).alias("explicit"), F.lit(None).cast("string").alias("subs"))


_PAIRS = SQL_CHAIN_LINKS + f""",
pairs0 AS (SELECT a.line_id, a.ord, a.text AS ocr1, b.text AS ocr2, a.ord // 2 % 5 AS turn FROM linked a JOIN linked b ON a.next_line = b.line_id),
pairs AS (SELECT *, CASE turn WHEN 1 THEN regexp_replace(ocr1, '-$', '') || ocr2 WHEN 4 THEN regexp_replace(ocr1, '-$', '') ELSE ocr1 END AS new1,
  CASE turn WHEN 1 THEN {toks('ocr2')}[-1] WHEN 2 THEN ocr2 || ' et la' WHEN 3 THEN 'zz' || ocr2 ELSE ocr2 END AS new2 FROM pairs0),
counted AS (SELECT *, len({toks('ocr1')}) AS n1, len({toks('new1')}) AS m1, len({toks('ocr2')}) AS n2, len({toks('new2')}) AS m2 FROM pairs)"""


@query(f"""WITH {_PAIRS} SELECT line_id, CASE WHEN m1 > n1 + 2 THEN 'part1_drift' WHEN n2 >= 2 AND m2 < n2 * 0.4 THEN 'part2_drift' END AS reason FROM counted""")
def stage_a_drift(spark, d):
    reason = guards.stage_a_drift(C("ocr1"), C("new1"), C("ocr2"), C("new2"))
    return _pairs(spark, d).select("line_id", reason.alias("reason"))


@query(f"""WITH {_PAIRS}, bare AS (SELECT *, rtrim(regexp_replace(ocr1, '{MK}+$', '')) AS b, rtrim(regexp_replace(new1, '{MK}+$', ''), '.') AS nb FROM counted)
SELECT line_id, len({toks('nb')}) > len({toks('b')}) + 1
  OR length(regexp_replace({toks('nb')}[-1], '{MK}+$', '')) > length(regexp_replace({toks('b')}[-1], '{MK}+$', '')) + 3
  OR length(nb) > length(b) * 1.4 + 8 AS migrated FROM bare""")
def stage_b_part1(spark, d):
    return _pairs(spark, d).select("line_id", guards.part1_migrated(C("ocr1"), C("new1")).alias("migrated"))


@query(f"WITH {_PAIRS} SELECT line_id, (n2 > 0 AND m2 < n2 * 0.4) OR m2 > n2 + greatest(3, CAST(floor(n2 * 0.4) AS BIGINT)) AS migrated FROM counted")
def stage_b_part2(spark, d):
    return _pairs(spark, d).select("line_id", guards.part2_migrated(C("ocr2"), C("new2")).alias("migrated"))


@query(f"""WITH {_PAIRS}, bare AS (SELECT *, rtrim(regexp_replace(ocr1, '{MK}+$', '')) AS b, rtrim(regexp_replace(new1, '{MK}+$', ''), '.') AS nb,
  lower({toks('ocr2')}[1]) AS f, lower({toks('new2')}[1]) AS g FROM counted)
SELECT line_id, CASE WHEN len({toks('nb')}) > len({toks('b')}) + 1 OR length(regexp_replace({toks('nb')}[-1], '{MK}+$', '')) > length(regexp_replace({toks('b')}[-1], '{MK}+$', '')) + 3
    OR length(nb) > length(b) * 1.4 + 8 THEN 'part1_migrated'
  WHEN (n2 > 0 AND m2 < n2 * 0.4) OR m2 > n2 + greatest(3, CAST(floor(n2 * 0.4) AS BIGINT)) THEN 'part2_migrated'
  WHEN NOT regexp_matches(new1, '{MK}{WS}*$') THEN 'break_mark_lost'
  WHEN m1 = 0 OR m2 = 0 THEN 'empty_side' WHEN m2 > n2 THEN 'part2_words_grew'
  WHEN f <> g AND NOT (length(f) >= 2 AND length(g) >= 2 AND f[1:2] = g[1:2] AND length(g) / greatest(length(f), 1) BETWEEN 0.5 AND 2.0) THEN 'boundary_word' END AS reason FROM bare""")
def stage_b_reconcile(spark, d):
    return guards.reconcile_pairs(_pairs(spark, d)).select("line_id", "reason")


def _proposed(spark, d):
    """Lines with a proposal: some take the next line's text, some the next line in, most lose their noise."""
    rows = lines(spark, d).withColumn("original", C("text")).withColumn("text", noisy(C("text")))
    rows = linking.pair_fields(rows.withColumn("role", F.lit("NONE")), in_page())
    new = F.when((C("ord") % 11 == 3) & C("next_text").isNotNull(), C("next_text")).when(
        (C("ord") % 11 == 7) & C("next_text").isNotNull(), F.concat("text", F.lit(" "), "next_text")).otherwise(C("original"))
    return rows.withColumn("corrected", new)


_SIM = """CASE kind WHEN 'same' THEN 1.0 WHEN 'next' THEN 0.0 WHEN 'both' THEN 2.0 * n / (2 * n + 1 + nn) WHEN 'before' THEN 2.0 * n / (2 * n + 1 + pn) ELSE 2.0 * n / (2 * n + 1) END"""


@query(f"""WITH {SQL_PLANTED}, s AS (SELECT *, {_SIM} AS sim FROM planted)
SELECT line_id, CASE WHEN kind = 'same' THEN NULL WHEN sim < 0.35 THEN 'too_different_from_source'
  WHEN kind = 'before' AND sim + 0.15 < 1 AND 2.0 * pn / (2 * pn + 1 + n) > sim + 0.15 THEN 'closer_to_previous_line'
  WHEN kind = 'both' AND sim + 0.15 < 1 AND 2.0 * nn / (2 * nn + 1 + n) > sim + 0.15 THEN 'closer_to_next_line'
  WHEN kind = 'both' AND n + 1 + nn > greatest(n, 1) * 1.2 THEN 'absorbs_next_line'
  WHEN kind = 'before' AND nn IS NOT NULL AND n + 1 + pn > greatest(n, 1) * 1.2 AND 2.0 * n / (2 * n + 2 + pn + nn) > 0.8 THEN 'absorbs_next_line'
  WHEN kind = 'before' AND n + 1 + pn > greatest(n, 1) * 1.2 THEN 'absorbs_previous_line' END AS reason, sim AS source_similarity FROM s""")
def stage_c_accept(spark, d):
    return guards.check_lines(planted(spark, d)).select("line_id", "reason", "source_similarity")


@query(f"""WITH {SQL_PLANTED}, s AS (SELECT *, lead(kind) OVER w AS kind2, lead(nn) OVER w AS nnn FROM planted WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
h AS (SELECT *, (kind = 'next' AND kind2 = 'both' AND 2.0 * nn / (2 * nn + 1 + nnn) >= 0.85) OR (kind = 'next' AND kind2 = 'same') OR (kind = 'both' AND kind2 = 'before') AS hit FROM s)
SELECT line_id FROM (SELECT line_id, coalesce(hit, false) OR coalesce(lag(hit) OVER w, false) AS found FROM h WINDOW w AS (PARTITION BY page_id ORDER BY ord)) WHERE found""")
def adjacent_duplicates(spark, d):
    return guards.adjacent_duplicates(planted(spark, d), segment="page_id").where("duplicate").select("line_id")


@query(f"""WITH {SQL_PLANTED}, c AS (
  SELECT *, CASE kind WHEN 'next' THEN nxt WHEN 'both' THEN nxt WHEN 'mark' THEN text || '~' ELSE text END AS last_new,
    CASE kind WHEN 'next' THEN nxt WHEN 'before' THEN prv WHEN 'mark' THEN text || '~' ELSE text END AS first_new FROM planted),
p AS (SELECT *, lead(first_new) OVER w AS b_new, lead(kind) OVER w AS kind2, lag(text) OVER w AS _ FROM c WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
seam AS (SELECT *, CASE
    WHEN nxt IS NOT NULL AND ((kind IN ('next', 'both') AND 2.0 * nn / (2 * nn + n) > 0.8 AND 2.0 * nn / (2 * nn + n) > 0.15)
      OR (kind = 'mark' AND 2.0 * n / (2 * n + nn + 1) > 0.8 AND 2.0 * n / (2 * n + nn + 1) > 2.0 * n / (2 * n + 1) + 0.15)
      OR (lower(last_new) <> lower(text) AND lower(b_new) <> lower(nxt) AND (lower(last_new) = lower(nxt) OR lower(b_new) = lower(text)))) THEN 'boundary_migration_forward'
    WHEN nxt IS NOT NULL AND kind2 = 'before' AND 2.0 * n / (2 * n + nn) > 0.8 THEN 'boundary_migration_backward' END AS here FROM p)
SELECT line_id, migration FROM (SELECT line_id, coalesce(here, lag(here) OVER w) AS migration FROM seam WINDOW w AS (PARTITION BY page_id ORDER BY ord)) WHERE migration IS NOT NULL""")
def boundary_migration(spark, d):
    return guards.boundary_migration(planted(spark, d), segment="page_id").where("migration is not null").select("line_id", "migration")


_DECIDED = _UNITS + """,
judged AS (SELECT b.*, u.unit_id, CASE WHEN b.ord % 13 = 4 THEN 'too_different_from_source: x' END AS reason, b.text || ' .' AS corrected
  FROM broken b LEFT JOIN units u USING (line_id)),
decided AS (SELECT *, CASE WHEN unit_id IS NULL THEN reason IS NOT NULL ELSE bool_or(reason IS NOT NULL) OVER (PARTITION BY page_id, unit_id) END AS fell FROM judged)"""


def _decided(spark, d):
    rows = linking.with_units(linked(spark, d), doc="page_id").withColumn("corrected", F.concat("text", F.lit(" ."))).withColumn(
        "reason", F.when(C("ord") % 13 == 4, "too_different_from_source: x"))
    return guards.decide(rows, doc="page_id")


@query(f"""WITH {_DECIDED} SELECT line_id, CASE WHEN fell THEN text ELSE corrected END AS final_text, CASE WHEN fell THEN 'fallback' ELSE 'corrected' END AS status,
  CASE WHEN fell THEN coalesce(reason, 'hyphen_unit_fallback') END AS fallback_reason FROM decided""")
def decisions(spark, d):
    return _decided(spark, d).select("line_id", "final_text", "status", "fallback_reason")


@query(f"WITH {_DECIDED} SELECT split_part(coalesce(reason, 'hyphen_unit_fallback'), ':', 1) AS reason, count(*) AS n FROM decided WHERE fell GROUP BY 1")
def fallback_hist(spark, d):
    return guards.fallback_counts(_decided(spark, d))


@query(f"""WITH {_DECIDED} SELECT line_id, substr(sha256(text), 1, 16) AS digest, corrected AS text FROM decided WHERE NOT fell""")
def final_edit_script(spark, d):
    rows = _decided(spark, d).withColumn("source_text", C("text"))
    return edits.final_script(rows).select("line_id", "digest", "text")


# --- similarity, alignment, confidence ---------------------------------------------------------


@query(f"""WITH {SQL_LINES}, n AS (SELECT line_id, text, lead(text) OVER (PARTITION BY page_id ORDER BY ord) AS nxt FROM lines),
t AS (SELECT line_id, {toks('text')} AS a, {toks('nxt')} AS b FROM n WHERE nxt IS NOT NULL)
SELECT line_id, CASE WHEN abs(len(a) - len(b)) > 2 THEN 0.0 WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 1.0
  ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS jaccard FROM t""")
def token_jaccard(spark, d):
    rows = lines(spark, d).withColumn("nxt", F.lead("text").over(in_page())).where("nxt is not null")
    return rows.select("line_id", T.token_jaccard(C("text"), C("nxt")).alias("jaccard"))


@query(f"""WITH {SQL_LINES}, n AS (SELECT line_id, text, lead(text) OVER (PARTITION BY page_id ORDER BY ord) AS nxt FROM lines)
SELECT line_id, CASE WHEN regexp_full_match(text || nxt, '[\\x00-\\x7f]*') THEN
  CASE WHEN greatest(length(text), length(nxt)) = 0 THEN 1.0 ELSE 1.0 - levenshtein(text, nxt) / greatest(length(text), length(nxt)) END END AS similarity FROM n""")
def char_similarity_ascii(spark, d):
    rows = spread(lines(spark, d), "page_id").withColumn("nxt", F.lead("text").over(in_page()))
    ascii_ = F.concat("text", "nxt").rlike(r"^[\x00-\x7f]*$")
    return rows.select("line_id", U.line_likeness(F.when(ascii_, C("text")), C("nxt")).alias("similarity"))


@query()
def char_similarity(spark, d):
    """All neighbouring lines, in code points; DuckDB counts bytes, so SQL can check only ASCII (``char_similarity_ascii``)."""
    rows = spread(lines(spark, d), "page_id").withColumn("nxt", F.lead("text").over(in_page()))
    return rows.select("line_id", U.line_likeness(F.when(C("nxt").isNotNull(), C("text")), C("nxt")).alias("similarity"))


# A token with noise: its letters, its changes, its similarity to the token without noise.
_NOISED = SQL_LINES + f""",
tok AS (SELECT line_id, unnest({toks('text')}) AS t FROM lines),
noised AS (SELECT line_id, t, length(t) AS n, (length(t) - length(replace(t, 'fi', ''))) // 2 AS fi,
  (length(replace(t, 'fi', '')) - length(replace(replace(t, 'fi', ''), 'fl', ''))) // 2 AS fl, (length(t) - length(replace(t, 'st', ''))) // 2 AS st FROM tok),
alike AS (SELECT *, 1.0 - (2 * (fi + fl) + st) / n AS s FROM noised)"""


@query(f"""WITH {_NOISED}, per AS (SELECT line_id, count(*) AS n, count(*) FILTER (s <= 1e-12) AS gaps, sum(s) AS total FROM alike GROUP BY 1)
SELECT line_id, CAST(coalesce(n + gaps, 0) AS INTEGER) AS pairs, coalesce(round(total / n, 6), 0.0) AS score, false AS move_suspected, false AS band_exhausted FROM lines LEFT JOIN per USING (line_id)""")
def token_alignment(spark, d):
    a = align.align_tokens(noisy(C("text")), C("text"))
    return lines(spark, d).select("line_id", a.alias("a")).select(
        "line_id", F.size("a.pairs").alias("pairs"), F.round("a.score", 6).alias("score"), "a.move_suspected", "a.band_exhausted")


@query(f"WITH {SQL_LINES} SELECT page_id, CAST(ord AS BIGINT) AS ord, CASE WHEN ord % 9 <> 8 THEN CAST(ord AS BIGINT) END AS returned_ord, false AS band_exhausted FROM lines")
def page_alignment(spark, d):
    """Every page against itself with noise and every ninth line missing; a mark of its own at both ends of a line tells lines apart."""
    mark = F.concat(F.lit("k"), C("ord").cast("string"))
    rows = lines(spark, d).select("page_id", "ord", F.concat_ws(" ", mark, F.concat(F.lit("m"), mark), F.concat(F.lit("n"), mark), "text").alias("text"))
    return align.align_pages(rows, rows.where("ord % 9 <> 8").withColumn("text", noisy(C("text"))))


@query(f"""WITH {SQL_LINES} SELECT line_id, least(CASE WHEN ord % 3 = 0 THEN NULL ELSE (ord % 10) / 10.0 END, CASE WHEN ord % 2 = 0 THEN NULL ELSE 0.75 END, 1.0) AS decision FROM lines""")
def confidence_min(spark, d):
    rows = lines(spark, d).select("line_id", C("text").alias("source_text"), C("text").alias("final_text"),
        F.when(C("ord") % 3 != 0, (C("ord") % 10) / 10.0).alias("ocr_confidence"), F.when(C("ord") % 2 != 0, F.lit(0.75)).alias("producer_confidence"))
    return confidence.line_confidence(rows).select("line_id", C("confidence.decision").alias("decision"))


@query(f"""WITH {_NOISED}, scored AS (SELECT *, CASE WHEN fi + fl + st = 0 THEN NULL WHEN s <= 1e-12 THEN 0.7 WHEN fi + fl + st = 1 THEN greatest(s, 0.95) ELSE s END AS event,
    CASE WHEN fi + fl + st > 0 AND s <= 1e-12 THEN 2 ELSE 1 END AS k FROM alike),
per AS (SELECT line_id, sum(s) / count(*) AS alignment, sum(event) / sum(k) FILTER (event IS NOT NULL) AS scorer FROM scored GROUP BY 1)
SELECT line_id, CASE WHEN text = {SQL_NOISY} THEN 1.0 ELSE round(least(alignment, coalesce(scorer, 1.0)), 6) END AS decision FROM lines LEFT JOIN per USING (line_id)""")
def confidence_scores(spark, d):
    """Confidence of corrections that undo the noise."""
    rows = lines(spark, d).select("line_id", noisy(C("text")).alias("source_text"), C("text").alias("final_text"),
        F.lit(None).cast("double").alias("ocr_confidence"), F.lit(None).cast("double").alias("producer_confidence"))
    return confidence.line_confidence(rows).select("line_id", F.round("confidence.decision", 6).alias("decision"))


# --- fidelity, losses, reports -----------------------------------------------------------------

_SAID = "CASE ord % 4 WHEN 0 THEN text WHEN 1 THEN replace(text, ' ', '  ') WHEN 2 THEN replace(text, ' ', chr(160)) ELSE text || ' x' END"


@query(f"""WITH {SQL_LINES}, said AS (SELECT ord, text, {_SAID} AS extracted FROM lines),
c AS (SELECT CASE WHEN text = extracted THEN 'exact' WHEN {toks('text')} = {toks('extracted')} THEN
  CASE WHEN ord % 4 = 2 AND len({toks('text')}) > 1 AND contains(trim(text), ' ') THEN 'normalized' ELSE 'token_equivalent' END ELSE 'withheld' END AS fidelity FROM said)
SELECT fidelity, count(*) AS n FROM c GROUP BY 1""")
def fidelity_hist(spark, d):
    said = F.expr(_SAID.replace("chr(160)", "' '"))
    rows = lines(spark, d).withColumn("fidelity", fidelity.classify(C("text"), said))
    return fidelity.histogram(rows)


@query("""SELECT 'STYLE_dropped' AS loss, count(*) FILTER (l_linenumber % 2 = 0) AS n FROM lineitem HAVING n > 0
UNION ALL SELECT 'confidence_invalidated', count(*) FILTER (l_linenumber % 3 = 0) AS n FROM lineitem HAVING n > 0
UNION ALL SELECT 'VENDOR_dropped', count(*) FILTER (l_linenumber % 5 = 0) AS n FROM lineitem HAVING n > 0""")
def loss_totals(spark, d):
    on = lambda k, name: F.when(C("l_linenumber") % k == 0, F.lit(name))
    names = F.array_compact(F.array(F.lit("CONTENT"), on(2, "STYLE"), on(3, "WC"), on(5, "VENDOR"), F.lit("STYLEREFS")))
    before = F.array(F.map_from_arrays(names, F.transform(names, lambda x: F.lit("v"))))
    after = F.array(F.create_map(F.lit("CONTENT"), F.lit("v"), F.lit("STYLEREFS"), F.lit("v")))
    return fidelity.loss_totals(table(spark, d, "lineitem").select(fidelity.attribute_losses(before, after).alias("losses")))


@query(f"""WITH {SQL_LINES} SELECT lang, source, CASE WHEN text = {SQL_NOISY} THEN 'untouched' ELSE 'corrected' END AS status, count(*) AS n,
  CAST(sum(length(text)) AS BIGINT) AS chars FROM lines GROUP BY ROLLUP (lang, source, CASE WHEN text = {SQL_NOISY} THEN 'untouched' ELSE 'corrected' END)""")
def report_rollup(spark, d):
    status = F.when(C("text") == noisy(C("text")), "untouched").otherwise("corrected")
    return lines(spark, d).withColumn("status", status).rollup("lang", "source", "status").agg(
        F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


# --- page XML ----------------------------------------------------------------------------------


def _xml(spark, d, fmt: str):
    """Documents as ALTO or PAGE files: path, content. A text is escaped as a whole and its blanks become markup, so no word is looked at by itself."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f]", " ").alias("text"))
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        docs = docs.withColumn("text", F.replace("text", F.lit(c), F.lit(entity)))
    rows = F.split("text", "\n", -1)
    if fmt == "alto":
        first, then, last = '<String HPOS="0" VPOS="0" WIDTH="9" HEIGHT="9" WC="0.5" CONTENT="', '<SP WIDTH="3"/>', '"/>'
        opened = lambda i: F.concat(F.lit('<TextLine ID="L'), i.cast("string"), F.lit('" HPOS="0" VPOS="0" WIDTH="900" HEIGHT="20">'))
        head = '<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page ID="P'
        mid, tail = '" WIDTH="1000" HEIGHT="1000"><PrintSpace><TextBlock ID="B">', "</TextBlock></PrintSpace></Page></Layout></alto>"
    else:
        first, then, last = "<Word><TextEquiv><Unicode>", "", "</Unicode></TextEquiv></Word>"
        opened = lambda i: F.concat(F.lit('<TextLine id="L'), i.cast("string"), F.lit('"><Coords points="0,0 9,9"/>'))
        head = '<?xml version="1.0" encoding="UTF-8"?><PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"><Page imageFilename="P'
        mid, tail = '" imageWidth="9" imageHeight="9"><TextRegion id="R">', "</TextRegion></Page></PcGts>"

    def line(x, i):
        words = F.regexp_replace(T.py_strip(x), f"{T.SPACE}+", last + then + first)
        return F.concat(opened(i), F.when(words == "", "").otherwise(F.concat(F.lit(first), words, F.lit(last))), F.lit("</TextLine>"))

    body = F.array_join(F.transform(rows, line), "")
    return docs.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".xml")).alias("path"), F.concat(
        F.lit(head), C("doc_id").cast("string"), F.lit(mid), body, F.lit(tail)).cast("binary").alias("content"))


_XML_SQL = f"""WITH docs AS (SELECT doc_id, regexp_replace(text, '[\\x00-\\x09\\x0b-\\x1f]', ' ', 'g') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM docs)
SELECT 'P' || doc_id AS page_id, 'L' || ord AS line_id, CAST(ord AS INTEGER) AS ord, nfc_normalize(array_to_string({toks('text')}, ' ')) AS text FROM l"""


@query(_XML_SQL)
def alto_scan(spark, d):
    return ocr_xml.lines_of(_xml(spark, d, "alto"), "failfast", ("page_id", "line_id", "ord", "text"))


@query(_XML_SQL)
def page_scan(spark, d):
    return ocr_xml.lines_of(_xml(spark, d, "page"), "failfast", ("page_id", "line_id", "ord", "text"))


def _rewritten(spark, d, fmt):
    files = _xml(spark, d, fmt)
    found = ocr_xml.lines_of(files, "failfast", ("source_file", "page_id", "line_id", "ord", "text"))
    new = F.when(C("ord") % 3 == 0, F.replace("text", F.lit("e"), F.lit("é"))).when((C("ord") % 3 == 1) & (C("text") != ""), F.concat("text", F.lit(" ok"))).otherwise(C("text"))
    done = rewrite.rewrite_files(files, found.withColumn("final_text", new), "rules")
    return done.select("source_file", "delivered", F.inline("lines")).select("source_file", "line_id", "delivered", "path", C("extracted").alias("text"))


_REWRITE_SQL = f"""WITH x AS ({_XML_SQL})
SELECT 'doc-' || substr(page_id, 2) || '.xml' AS source_file, line_id, true AS delivered, CASE ord % 3 WHEN 0 THEN replace(text, 'e', 'é')
  WHEN 1 THEN CASE WHEN text <> '' THEN text || ' ok' ELSE text END ELSE text END AS text FROM x"""


@query(_REWRITE_SQL)
def alto_rewrite(spark, d):
    return _rewritten(spark, d, "alto").drop("path")


@query(_REWRITE_SQL)
def page_rewrite(spark, d):
    return _rewritten(spark, d, "page").drop("path")


@query(f"""WITH x AS ({_XML_SQL}), c AS (SELECT CASE WHEN ord % 3 = 0 AND contains(text, 'e') THEN 'fast' WHEN ord % 3 = 1 AND text <> '' THEN 'slow' ELSE 'untouched' END AS path FROM x)
SELECT path, count(*) AS n FROM c GROUP BY 1""")
def rewrite_paths(spark, d):
    return _rewritten(spark, d, "alto").groupBy("path").agg(F.count("*").alias("n"))


# --- whole runs over files with marks of broken words ------------------------------------------


def _marked(spark, d):
    """``chained`` lines as ALTO files: several pages of twenty lines, several blocks of seven, margins, and in every second document
    HYP and SUBS. Words over more than two lines name a whole word that their halves do not give."""
    w = Window.partitionBy("page_id").orderBy("ord")
    rows = linking.with_units(chain_links(spark, d), doc="page_id").withColumn("text", F.regexp_replace("text", r"[\x00-\x1f]", "")).withColumn("rank", F.row_number().over(w) - 1)
    bare = T.strip_trailing_break_marks(T.last_token(C("text")))
    word = F.when(C("next_line").isNotNull() & (C("page_id") % 2 == 0), F.concat(bare, T.first_token(F.lead("text").over(w)), F.when(C("size") > 2, "x").otherwise("")))
    rows = rows.withColumn("ends", word).withColumn("begins", F.lag("ends").over(w))
    esc = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    subs = lambda kind, x: F.when(x.isNotNull(), F.concat(F.lit(f' SUBS_TYPE="{kind}" SUBS_CONTENT="'), esc(x), F.lit('"'))).otherwise("")
    hyphen = (C("page_id") % 2 == 0) & C("role").isin("PART1", "BOTH")
    tokens = T.py_tokens(F.when(hyphen, T.strip_trailing_break_marks(C("text"))).otherwise(C("text")))
    mark = F.regexp_extract("text", f"({MK})$", 1)
    n = F.size(tokens)
    each = F.transform(tokens, lambda t, i: F.concat(F.lit('<String CONTENT="'), esc(t), F.lit('" WC="0.5"'), F.when(i == 0, subs("HypPart2", C("begins"))).otherwise(""),
        F.when((i == n - 1) & ((n > 1) | C("begins").isNull()), subs("HypPart1", C("ends"))).otherwise(""), F.lit("/>")))
    line = F.concat(F.lit('<TextLine ID="L'), C("rank"), F.lit('" HPOS="0" VPOS="'), (C("rank") % 20) * 20, F.lit('" WIDTH="500" HEIGHT="10">'), F.array_join(each, '<SP WIDTH="3"/>'),
                    F.when(hyphen, F.concat(F.lit('<HYP CONTENT="'), mark, F.lit('"/>'))).otherwise(""), F.lit("</TextLine>"))
    rows = rows.select("page_id", "rank", (F.floor(C("rank") / 20)).alias("page"), F.floor(C("rank") / 7).alias("block"), line.alias("xml"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, "xml"))), lambda x: x["xml"]), "")
    blocks = rows.groupBy("page_id", "page", "block").agg(F.concat(F.lit('<TextBlock ID="B'), C("block"), F.lit('">'), ordered("rank"), F.lit("</TextBlock>")).alias("xml"))
    pages = blocks.groupBy("page_id", "page").agg(F.concat(
        F.lit('<Page ID="P'), C("page"), F.lit('" WIDTH="900" HEIGHT="900"><TopMargin><TextBlock ID="M'), C("page"), F.lit('"><TextLine ID="T'), C("page"),
        F.lit('"><String CONTENT="g"/></TextLine></TextBlock></TopMargin><PrintSpace>'), ordered("block"), F.lit("</PrintSpace></Page>")).alias("xml"))
    head = '<?xml version="1.0" encoding="UTF-8"?><alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout>'
    return pages.groupBy("page_id").agg(F.concat(F.lit(head), ordered("page"), F.lit("</Layout></alto>")).cast("binary").alias("content")).select(
        F.concat(F.lit("doc-"), "page_id", F.lit(".xml")).alias("path"), "content")


def _run(spark, d):
    """All marked files, each a document, corrected by one rule."""
    files = written(_marked(spark, d))
    parsed = written(ocr_xml.lines_of(files, "failfast").withColumn("doc_id", C("source_file")))
    return correction.rewritten(files, parsed, rule_list=[rules.Rule("g", "ġ")])


_RUN_SQL = SQL_CHAIN_LINKS + f""",
started AS (SELECT *, sum(CASE WHEN prev_line IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY ord) AS unit_no
  FROM linked WHERE next_line IS NOT NULL OR prev_line IS NOT NULL),
whole AS (SELECT line_id, unit_no AS no, count(*) OVER (PARTITION BY page_id, unit_no) AS size, row_number() OVER (PARTITION BY page_id, unit_no ORDER BY ord) - 1 AS member FROM started),
sized AS (SELECT line_id, size, CASE WHEN size > 80 AND member > 0 AND member % 80 = 0 AND member = size - 1 THEN NULL ELSE no || '#' || (member // 80) END AS unit_no,
  size > 80 AND member % 80 = 79 AND member < size - 1 AS tail, size > 80 AND member > 0 AND member % 80 = 0 AS head FROM whole),
flat AS (SELECT l.page_id, l.line_id, l.ord, CASE WHEN tail THEN CASE role WHEN 'BOTH' THEN 'PART2' ELSE 'NONE' END WHEN head THEN CASE role WHEN 'BOTH' THEN 'PART1' ELSE 'NONE' END ELSE role END AS role,
  CASE WHEN NOT coalesce(tail, false) THEN l.next_line END AS next_line, CASE WHEN NOT coalesce(head, false) THEN l.prev_line END AS prev_line, unit_no, size, nfc_normalize(array_to_string({toks("regexp_replace(text, '[\x00-\x1f]', '', 'g')")}, ' ')) AS text,
  row_number() OVER (PARTITION BY page_id ORDER BY l.ord) - 1 AS rank FROM linked l LEFT JOIN sized USING (line_id)),
worded AS (SELECT *, replace(text, 'g', 'ġ') AS new, page_id % 2 = 0 AS told, lead(text) OVER w AS nxt,
  CASE WHEN next_line IS NOT NULL THEN regexp_replace({toks('text')}[-1], '{MK}+$', '') || {toks('lead(text) OVER w')}[1] END AS word FROM flat WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
paired AS (SELECT *, {toks('nxt')}[1] AS f, CASE WHEN next_line IS NULL THEN NULL
    WHEN told AND size <= 2 AND NOT contains(word, 'g') THEN 'coherent'
    WHEN (contains(text, 'g') OR contains(nxt, 'g')) AND (told OR (contains({toks('nxt')}[1], 'g') AND (length({toks('nxt')}[1]) < 2 OR contains({toks('nxt')}[1][1:2], 'g')))) THEN 'fallback'
    ELSE 'neutralised' END AS outcome FROM worded),
fallen AS (SELECT *, lag(outcome) OVER w AS before, lag(word) OVER w AS begins FROM paired WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
decided AS (SELECT *, coalesce(outcome = 'fallback', false) OR (prev_line IS NOT NULL AND before = 'fallback') AS own,
  CASE WHEN unit_no IS NULL THEN false ELSE bool_or(coalesce(outcome = 'fallback', false)) OVER (PARTITION BY page_id, unit_no) END AS fell FROM fallen),
ended AS (SELECT *, CASE WHEN fell THEN text ELSE new END AS final,
  CASE WHEN told AND prev_line IS NOT NULL AND before = 'coherent' THEN begins END AS begin_word, CASE WHEN told AND outcome = 'coherent' THEN word END AS end_word,
  told AND ((prev_line IS NOT NULL AND before <> 'coherent') OR (next_line IS NOT NULL AND outcome <> 'coherent' AND (prev_line IS NULL OR len({toks('text')}) > 1))) AS unmarked FROM decided),
run AS (SELECT 'doc-' || page_id || '.xml' AS doc_id, 'P' || (rank // 20) AS page_id, 'L' || rank AS line_id, role, text, final, outcome, next_line, prev_line, begin_word, end_word,
  CASE WHEN fell THEN 'fallback' ELSE 'corrected' END AS status, CASE WHEN own THEN 'hyphen_pair_fallback' WHEN fell THEN 'hyphen_unit_fallback' END AS code,
  CASE WHEN final <> text THEN 'fast' WHEN unmarked THEN 'subs_only' ELSE 'untouched' END AS path FROM ended)"""


@query(f"WITH {_RUN_SQL} SELECT doc_id, line_id, path, final AS text, begin_word, end_word FROM run")
def subs_rewrite(spark, d):
    """What the rewritten files say: texts, and the whole words that broken ends are marked with."""
    done = _run(spark, d)
    said = done.files.select("source_file", F.inline("lines")).select(C("source_file").alias("doc_id"), "line_id", "path")
    read = ocr_xml.lines_of(done.files.select(C("source_file").alias("path"), "content"), "failfast", ("source_file", "line_id", "text", "tokens"))
    words = F.filter("tokens", lambda t: t["kind"] == "String")
    first, last = F.try_element_at(words, F.lit(1)), F.try_element_at(words, F.lit(-1))
    return said.join(read.select(C("source_file").alias("doc_id"), "line_id", "text", F.when(first["subs_type"] == "HypPart2", first["subs_content"]).alias("begin_word"),
        F.when(last["subs_type"] == "HypPart1", last["subs_content"]).alias("end_word")), ["doc_id", "line_id"])


@query(f"WITH {_RUN_SQL} SELECT doc_id, page_id, line_id, role, status, code, final AS final_text, path, 'exact' AS fidelity FROM run")
def line_outcomes(spark, d):
    """Every line's way from its source through the decision to the file."""
    return _run(spark, d).outcomes.select(
        "doc_id", "page_id", "line_id", C("hyphen_role").alias("role"), "decision.status", C("decision.reason.code").alias("code"), "decision.final_text",
        C("projection.rewriter_path").alias("path"), "projection.fidelity")


@query(f"""WITH {_RUN_SQL}, pages AS (SELECT DISTINCT doc_id, page_id FROM run)
SELECT 'document_parsed' AS type, count(DISTINCT doc_id) AS n, count(*) AS total FROM run
UNION ALL SELECT 'page_started', count(*), (SELECT count(*) FROM run) FROM pages
UNION ALL SELECT 'page_completed', count(*), (SELECT count(*) FROM run WHERE status = 'corrected' AND final <> text) FROM pages
UNION ALL SELECT 'hyphen_partner_missing', count(*), 0 FROM run WHERE (role IN ('PART1', 'BOTH') AND next_line IS NULL) OR (role IN ('PART2', 'BOTH') AND prev_line IS NULL)
UNION ALL SELECT 'reconcile_stats', count(DISTINCT outcome), count(outcome) FROM run
UNION ALL SELECT 'rewriter_stats', count(DISTINCT doc_id), (SELECT count(*) FROM run WHERE path = 'subs_only') FROM run""")
def run_events(spark, d):
    """Events of a run by type, with the total of what they count."""
    value = lambda k: F.element_at("payload", k).cast("long")
    total = F.coalesce(value("total_lines"), F.when(C("type") == "page_started", value("line_count")), value("corrections"), value("n"), value("subs_only"), F.lit(0))
    return _run(spark, d).events.withColumn("total", total).groupBy("type").agg(F.count("*").alias("n"), F.sum("total").alias("total"))


# --- ordinary relational queries ---------------------------------------------------------------

QUERIES |= relational.QUERIES
SQL |= relational.SQL

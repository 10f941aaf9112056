"""Views of the driver's tables as lines of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spread import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; a table of fewer splits than cores is spread over them (large ones are read as they lie)."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in ("documents", "pages") and rows.rdd.getNumPartitions() < cores:
        return rows.repartition(cores)
    return rows


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a page, its lines are separated by newlines: page_id, line_id, ord, text, lang, source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return docs.select(F.col("doc_id").alias("page_id"), "lang", "source", F.posexplode(F.split("text", "\n", -1)).alias("ord", "text")).select(
        "page_id", F.concat_ws("_", "page_id", "ord").alias("line_id"), "ord", "text", "lang", "source")


def noisy(text):
    """Ligatures and long s as early print has them; the default rules undo them."""
    out = F.replace(text, F.lit("fi"), F.lit("ﬁ"))
    return F.replace(F.replace(out, F.lit("fl"), F.lit("ﬂ")), F.lit("st"), F.lit("ſt"))


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten words in which some long words are broken with a hyphen: page_id, ord, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    words, n = _words(docs), F.size("words")
    cut = lambda r: F.get("words", r * 10 + 9).rlike("^[A-Za-z]{8,}$") & ((F.col("doc_id") + r) % 3 == 0)
    half = lambda w: F.floor(F.length(w) / 2).cast("int")
    last, before = lambda r: F.get("words", r * 10 + 9), lambda r: F.get("words", r * 10 - 1)
    text = lambda r: F.concat_ws(" ", F.when(cut(r - 1), F.substr(before(r), half(before(r)) + 1)), F.slice("words", r * 10 + 1, 9),
                                 F.when(cut(r), F.concat(F.substr(last(r), F.lit(1), half(last(r))), F.lit("-"))).otherwise(last(r)))
    over = (n > 0) & (n % 10 == 0) & F.coalesce(cut(F.floor(n / 10).cast("int") - 1), F.lit(False))  # the last line's broken word goes on in a line of its own
    made = F.transform(_rows(F.ceil(n / 10).cast("int") + over.cast("int")), lambda r: F.struct(r.alias("ord"), text(r).alias("text")))
    return words.select(F.col("doc_id").alias("page_id"), F.inline(made)).select(
        "page_id", F.concat_ws("_", "page_id", "ord").alias("line_id"), "ord", "text")


def _words(docs: DataFrame) -> DataFrame:
    """doc_id and the words of a document as an array, so that lines are made in place, without a shuffle of words."""
    return docs.select("doc_id", F.coalesce(F.filter(F.split("text", " "), lambda x: x != ""), F.array().cast("array<string>")).alias("words"))


def _rows(n):
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


SQL_LINES = """lines AS (
  SELECT page_id, concat_ws('_', page_id, ord) AS line_id, CAST(ord AS INTEGER) AS ord, text, lang, source FROM (
    SELECT doc_id AS page_id, lang, source, unnest(string_split(text, chr(10))) AS text,
      generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ord FROM documents))"""
SQL_NOISY = "replace(replace(replace(text, 'fi', 'ﬁ'), 'fl', 'ﬂ'), 'st', 'ſt')"
SQL_BROKEN = """words AS (
  SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos
  FROM (SELECT doc_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS l FROM documents)),
cuts AS (
  SELECT doc_id, pos, tok, pos // 10 AS ph,
    pos % 10 = 9 AND regexp_full_match(tok, '[A-Za-z]{8,}') AND (doc_id + pos // 10) % 3 = 0 AS cut FROM words),
pieces AS (
  SELECT doc_id, ph AS ord, pos AS p, CASE WHEN cut THEN substr(tok, 1, length(tok) // 2) || '-' ELSE tok END AS t FROM cuts
  UNION ALL SELECT doc_id, ph + 1, pos, substr(tok, length(tok) // 2 + 1) FROM cuts WHERE cut),
broken AS (
  SELECT doc_id AS page_id, concat_ws('_', doc_id, ord) AS line_id, CAST(ord AS INTEGER) AS ord, string_agg(t, ' ' ORDER BY p) AS text
  FROM pieces GROUP BY doc_id, ord)"""


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``broken`` with roles and links."""
    from ..operators import linking

    roles = linking.heuristic_roles(broken(spark, sf_dir))
    return linking.link_lines(roles, doc="page_id")


SQL_LINKED = SQL_BROKEN + r""",
marked AS (SELECT *, regexp_matches(text, '\p{L}[\-\x{ac}\x{2e17}\x{ad}\x{2010}\x{2011}][\t-\r\x1c-\x20\x{85}\x{a0}\x{2028}\x{2029}]*$') AS mark FROM broken),
roles AS (
  SELECT *, CASE WHEN mark AND coalesce(lag(mark) OVER w, false) THEN 'BOTH' WHEN mark THEN 'PART1' ELSE 'NONE' END AS role0
  FROM marked WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
linked AS (
  SELECT page_id, line_id, ord, text,
    CASE WHEN lag(role0) OVER w IN ('PART1', 'BOTH') THEN CASE WHEN role0 IN ('PART1', 'BOTH') THEN 'BOTH' ELSE 'PART2' END ELSE role0 END AS role,
    CASE WHEN role0 IN ('PART1', 'BOTH') THEN lead(line_id) OVER w END AS next_line,
    CASE WHEN lag(role0) OVER w IN ('PART1', 'BOTH') THEN lag(line_id) OVER w END AS prev_line
  FROM roles WINDOW w AS (PARTITION BY page_id ORDER BY ord))"""


def in_page(by: str = "ord"):
    return Window.partitionBy("page_id").orderBy(by)


ALPHABETS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "αβγδεζηθικλμνξοπρστυφχψωςϕϑ"]


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as one word each, in three alphabets by turns, with a proposal for each: page_id, line_id, ord, text, prev_text, next_text, corrected.

    Lines less than three apart share no character, so the similarity of any two texts made of them has a closed form, which SQL can say.
    By turns a proposal is the line, the next line, the line with the next, the line before with the line, the line with a mark."""
    w = in_page()
    bare = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    own = F.when(F.col("ord") % 3 == 0, bare).when(F.col("ord") % 3 == 1, F.upper(bare)).otherwise(F.translate(bare, ALPHABETS[0], ALPHABETS[2]))
    rows = spread(lines(spark, sf_dir).where(bare != ""), "page_id").withColumn("ord", F.row_number().over(w) - 1)
    rows = rows.select("page_id", F.concat_ws("_", "page_id", "ord").alias("line_id"), "ord", own.alias("text"))
    rows = rows.withColumn("prev_text", F.lag("text").over(w)).withColumn("next_text", F.lead("text").over(w))
    turn, blank = F.col("ord") % 5, F.lit(" ")
    new = F.when((turn == 1) & F.col("next_text").isNotNull(), F.col("next_text")).when(
        (turn == 2) & F.col("next_text").isNotNull(), F.concat("text", blank, "next_text")).when(
        (turn == 3) & F.col("prev_text").isNotNull(), F.concat("prev_text", blank, "text")).when(turn == 4, F.concat("text", F.lit("~"))).otherwise(F.col("text"))
    return rows.withColumn("corrected", new)


SQL_PLANTED = SQL_LINES + f""",
bare AS (SELECT page_id, regexp_replace(lower(text), '[^a-z]', '', 'g') AS x, row_number() OVER (PARTITION BY page_id ORDER BY ord) - 1 AS ord
  FROM lines WHERE regexp_matches(lower(text), '[a-z]')),
own AS (SELECT page_id, concat_ws('_', page_id, ord) AS line_id, ord,
  CASE ord % 3 WHEN 0 THEN x WHEN 1 THEN upper(x) ELSE translate(x, '{ALPHABETS[0]}', '{ALPHABETS[2]}') END AS text FROM bare),
near AS (SELECT *, lag(text) OVER w AS prv, lead(text) OVER w AS nxt FROM own WINDOW w AS (PARTITION BY page_id ORDER BY ord)),
planted AS (SELECT *, CASE WHEN ord % 5 = 1 AND nxt IS NOT NULL THEN 'next' WHEN ord % 5 = 2 AND nxt IS NOT NULL THEN 'both'
    WHEN ord % 5 = 3 AND prv IS NOT NULL THEN 'before' WHEN ord % 5 = 4 THEN 'mark' ELSE 'same' END AS kind,
  length(text) AS n, length(nxt) AS nn, length(prv) AS pn FROM near)"""


def chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of five words in which long last words are broken, the longest over three lines, and every seventh page ends in a
    broken word that nothing continues: page_id, line_id, ord, text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    words, n = _words(docs), F.size("words")
    last, before = lambda r: F.get("words", r * 5 + 4), lambda r: F.get("words", r * 5 - 1)
    long_, longest = lambda w: w.rlike("^[A-Za-z]{7,}$"), lambda w: w.rlike("^[A-Za-z]{9,}$")
    lone = F.col("doc_id") % 7 == 0
    text = lambda r: F.concat_ws(" ", F.when(lone & (r == 500_000), "un-"), F.when(longest(before(r)), F.substr(before(r), F.lit(7))).when(long_(before(r)), F.substr(before(r), F.lit(4))),
                                 F.slice("words", r * 5 + 1, 4), F.when(long_(last(r)), F.concat(F.substr(last(r), F.lit(1), F.lit(3)), F.lit("-"))).otherwise(last(r)))
    middle = lambda r: F.when(longest(last(r)), F.struct((r * 2 + 1).alias("ord"), F.concat(F.substr(last(r), F.lit(4), F.lit(3)), F.lit("-")).alias("text")))
    over = (n > 0) & (n % 5 == 0) & F.coalesce(long_(F.get("words", n - 1)), F.lit(False))  # the last line's broken word goes on in a line of its own
    count = F.ceil(n / 5).cast("int") + over.cast("int")
    made = F.flatten(F.transform(_rows(count), lambda r: F.array_compact(F.array(F.struct((r * 2).alias("ord"), text(r).alias("text")), middle(r)))))
    tail = F.when(lone & (count <= 500_000), F.array(F.struct(F.lit(1_000_000).alias("ord"), F.lit("un-").alias("text"))))
    both = F.concat(made, F.coalesce(tail, F.array().cast("array<struct<ord:int,text:string>>")))
    return words.select(F.col("doc_id").alias("page_id"), F.inline(both)).select(
        "page_id", F.concat_ws("_", "page_id", "ord").alias("line_id"), "ord", "text")


SQL_CHAINED = SQL_BROKEN.split("cuts AS (")[0] + """
pieces AS (
  SELECT doc_id, pos // 5 * 2 AS ord, pos AS p, CASE WHEN pos % 5 = 4 AND regexp_full_match(tok, '[A-Za-z]{7,}') THEN substr(tok, 1, 3) || '-' ELSE tok END AS t FROM words
  UNION ALL SELECT doc_id, pos // 5 * 2 + 1, pos, substr(tok, 4, 3) || '-' FROM words WHERE pos % 5 = 4 AND regexp_full_match(tok, '[A-Za-z]{9,}')
  UNION ALL SELECT doc_id, pos // 5 * 2 + 2, pos, substr(tok, CASE WHEN length(tok) >= 9 THEN 7 ELSE 4 END) FROM words WHERE pos % 5 = 4 AND regexp_full_match(tok, '[A-Za-z]{7,}')
  UNION ALL SELECT doc_id, 1000000, 0, 'un-' FROM documents WHERE doc_id % 7 = 0),
broken AS (
  SELECT doc_id AS page_id, concat_ws('_', doc_id, ord) AS line_id, CAST(ord AS INTEGER) AS ord, string_agg(t, ' ' ORDER BY p) AS text
  FROM pieces GROUP BY doc_id, ord)"""
SQL_CHAIN_LINKS = SQL_CHAINED + SQL_LINKED[len(SQL_BROKEN):]


def chain_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``chained`` with roles and links."""
    from ..operators import linking

    return linking.link_lines(linking.heuristic_roles(chained(spark, sf_dir)), doc="page_id")

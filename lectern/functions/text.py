"""Text functions as native column expressions.

They follow Python's string semantics, not Java's: white space is what ``str.split()`` splits on,
letters are Unicode letters, and lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that mark a broken word at the end of a line.
BREAK_MARKS = "-\u00ac\u2e17\u00ad\u2010\u2011"
# Characters without a width that have no place in a line.
INVISIBLES = "\u00ad\u200b\u200c\u200d\ufeff\n\r\t"
# Punctuation that quality estimation strips from a token.
PUNCTUATION = ".,;:!?()[]{}«»\"'—–-…"

_MARKS = r"[\-\x{ac}\x{2e17}\x{ad}\x{2010}\x{2011}]"
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# Names whose value is a secret, schemes of authorization, beginnings of keys, headers.
SECRET_NAMES = ["api_key", "api-key", "apikey", "password", "passwd", "secret", "token"]
SECRET_SCHEMES = ["bearer", "basic"]
SECRET_BEGINNINGS = ["sk-", "key-"]
SECRET_HEADERS = ["x-api-key", "x-auth-token", "x-access-token"]
# Fixed value: how many characters of a key stay, and what stands for the rest.
KEY_HINT, MASK = 4, "****"


def secret_shapes() -> list[str]:
    """Patterns of secrets; what the first group holds is kept, the rest is masked.

    A scheme is followed by its credentials; a key keeps its beginning and a hint; a name, in JSON or in a query string, may have quotes around
    itself and its value, which ends at a quote, a blank or a delimiter; a header's value ends at a blank."""
    any_of = lambda words: "(?:" + "|".join(words) + ")"
    quote, value = "[\"']?", "[^\\s\"'&,}\\]]+"
    return [
        f"(?i)({any_of(SECRET_SCHEMES)}\\s+)[^\\s\"',;}}]+",
        f"({any_of(SECRET_BEGINNINGS)}[A-Za-z0-9_-]{{{KEY_HINT}}})[^\\s\"',;}}]+",
        f"(?i)({any_of(SECRET_HEADERS)}\\s*[=:]\\s*)\\S+",
        f"(?i)({any_of(SECRET_NAMES)}{quote}\\s*[=:]\\s*{quote}){value}",
    ]


def py_strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def py_rstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+$", "")


def py_tokens(text: Column) -> Column:
    """``str.split()``: the maximal runs of characters that are no white space."""
    return F.filter(F.split(text, f"{SPACE}+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    return F.size(py_tokens(text))


def first_token(text: Column) -> Column:
    return F.try_element_at(py_tokens(text), F.lit(1))


def last_token(text: Column) -> Column:
    return F.try_element_at(py_tokens(text), F.lit(-1))


def has_line_separator(text: Column) -> Column:
    return text.rlike(r"[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")


def strip_invisibles(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{ad}\x{200b}-\x{200d}\x{feff}\n\r\t]", "")


def clean_content(text: Column) -> Column:
    """Invisible and control characters removed; the text must be NFC (see ``udf.nfc``)."""
    return F.regexp_replace(text, r"[\x{00}-\x{1f}\x{7f}-\x{9f}\x{ad}\x{200b}-\x{200d}\x{feff}]", "")


def ends_with_break_mark(text: Column) -> Column:
    return text.rlike(f"{_MARKS}{SPACE}*$")


def strip_trailing_break_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"{_MARKS}+$", "")


def drop_break_mark(text: Column) -> Column:
    """One trailing mark removed (it is markup of its own in ALTO)."""
    return F.regexp_replace(py_rstrip(text), f"{_MARKS}$", "")


def trailing_hyphen_char(text: Column) -> Column:
    """The mark that ends the last word, if a letter stands before it; else null."""
    return F.nullif(F.regexp_extract(text, rf"\p{{L}}({_MARKS}){SPACE}*$", 1), F.lit(""))


def preserve_break_char(source: Column, corrected: Column) -> Column:
    """The correction with the source's own break mark, if both end in one."""
    mark = F.regexp_extract(source, f"({_MARKS}){SPACE}*$", 1)
    own = F.regexp_extract(corrected, f"({_MARKS}){SPACE}*$", 1)
    space = F.regexp_extract(corrected, f"({SPACE}*)$", 1)
    kept = F.substr(corrected, F.lit(1), F.length(corrected) - F.length(space) - 1)
    return F.when((mark != "") & (own != "") & (mark != own), F.concat(kept, mark, space)).otherwise(corrected)


def line_digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def source_digest(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def sanitize_error(message: Column, api_key: str | None = None) -> Column:
    """Secrets masked: the exact key first, then every known shape."""
    if api_key and len(api_key) > 8:
        message = F.replace(message, F.lit(api_key), F.lit(api_key[:4] + "****"))
    for shape in secret_shapes():
        message = F.regexp_replace(message, shape, "$1" + MASK)
    return message


def int_tolerant(raw: Column, default: int = 0) -> Column:
    """An integer attribute: truncates decimals, anything else is the default."""
    number = raw.try_cast("double")
    fits = number.between(-2147483648.0, 2147483647.0)
    return F.coalesce(F.when(fits, number.cast("int")), F.lit(default))


def int_strict(raw: Column, default: int = 0) -> Column:
    """Like ``int_tolerant`` for missing values; garbage raises."""
    empty = raw.isNull() | (raw == "")
    number = F.when(empty, F.lit(float(default))).otherwise(raw.cast("double"))
    bad = F.isnan(number) | (F.abs(number) > 2147483647.0)
    return F.when(bad, F.raise_error(F.concat(F.lit("not an integer: "), raw)).cast("int")).otherwise(number.cast("int"))


def polygon_bbox(points: Column) -> Column:
    """``"x,y x,y"`` -> (hpos, vpos, width, height); malformed pairs are skipped, none gives zeros."""
    pairs = F.filter(F.split(points, f"{SPACE}+"), lambda p: p.rlike(r"^[+-]?[0-9]+(\.[0-9]*)?,[+-]?[0-9]+(\.[0-9]*)?$"))
    xs = F.transform(pairs, lambda p: F.split(p, ",")[0].cast("double").cast("int"))
    ys = F.transform(pairs, lambda p: F.split(p, ",")[1].cast("double").cast("int"))
    zero = F.lit(0)
    return F.struct(
        F.coalesce(F.array_min(xs), zero).alias("hpos"), F.coalesce(F.array_min(ys), zero).alias("vpos"),
        F.coalesce(F.array_max(xs) - F.array_min(xs), zero).alias("width"),
        F.coalesce(F.array_max(ys) - F.array_min(ys), zero).alias("height"),
    )


def clamp_box(box: Column, width: Column, height: Column, margin: int = 0) -> Column:
    """A crop of the page around a box, clamped to the page; null if nothing is left."""
    left, top = F.greatest(box["hpos"] - margin, F.lit(0)), F.greatest(box["vpos"] - margin, F.lit(0))
    right = F.least(box["hpos"] + box["width"] + margin, width)
    bottom = F.least(box["vpos"] + box["height"] + margin, height)
    out = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))
    return F.when((right > left) & (bottom > top), out)


def char_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longer)


def token_jaccard(a: Column, b: Column, slack: int = 2) -> Column:
    """Token-set Jaccard; 0 if the numbers of tokens differ by more than ``slack``."""
    x, y = py_tokens(a), py_tokens(b)
    union = F.size(F.array_union(x, y))
    far = F.abs(F.size(x) - F.size(y)) > slack
    return F.when(far, 0.0).when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def changed_chars(a: Column, b: Column) -> Column:
    """The window that differs after cutting the common ends: an upper bound of the edit distance."""
    n = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << k) for k in range(23, -1, -1)])
    # equal ends are monotone in their length, so its bits are found one by one, the highest that the texts have first
    first = lambda x, k: F.substr(x, F.lit(1), k)
    last = lambda x, k: F.substr(x, F.length(x) - k + 1)
    same = lambda end, most: F.aggregate(F.filter(steps, lambda k: k <= most), F.lit(0), lambda p, k: F.when(
        (p + k <= most) & (end(a, p + k) == end(b, p + k)), p + k).otherwise(p))
    head = same(first, n)
    tail = same(last, n - head)
    return F.when(a == b, 0).otherwise(F.greatest(F.length(a), F.length(b)) - head - tail)


def quality_score(text: Column, lexicon: set[str] = frozenset()) -> Column:
    """The share of word tokens that look broken (0 without a word token): a digit next to a letter, or, with a lexicon,
    a word that it does not hold. Old spellings are no sign of damage, so the lexicon should be of the text's own time."""
    strip = "[" + "".join("\\" + c if c in "\\[]-^" else c for c in PUNCTUATION) + "]+"
    core = F.transform(py_tokens(text), lambda t: F.regexp_replace(t, f"^{strip}|{strip}$", ""))
    tokens = F.filter(core, lambda t: t.rlike(r"[\p{L}\p{N}]"))
    odd = lambda t: t.rlike(r"\p{L}\p{N}|\p{N}\p{L}")
    if lexicon:
        known = sorted({w.casefold() for w in lexicon})
        own = odd
        odd = lambda t: own(t) | (~t.rlike(r"^\p{N}+$") & ~F.lower(t).isin(known))
    found = F.filter(tokens, odd)
    return F.when(F.size(tokens) == 0, 0.0).otherwise(F.size(found) / F.size(tokens))


def route(score: Column, low: float | None, high: float | None) -> Column:
    """``skip`` up to ``low``, ``escalate`` from ``high`` on, else ``llm``."""
    out = F.lit("llm")
    if high is not None:
        out = F.when(score >= high, "escalate").otherwise(out)
    if low is not None:
        out = F.when(score <= low, "skip").otherwise(out)
    return out


def break_tokens(text: Column) -> Column:
    """Alternating word and space tokens; no-break spaces stay inside words."""
    space = r"[\t-\r\x1c-\x20\x{85}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200a}\x{2028}\x{2029}\x{205f}\x{3000}]"
    return F.regexp_extract_all(text, F.lit(f"{space}+|[^{space[1:-1]}]+"), F.lit(0))

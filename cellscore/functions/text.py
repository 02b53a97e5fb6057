"""Answers, tokens and coordinates as column expressions (row-local, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters stripped from answer words, and before tokens.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»„‚‹›…–—·•¡¿「」『』。、，．：；！？"
TOKEN_PREFIX = " \t\r\n\u00a0Ġ▁Ċ\"'`*“‘"
THINK_TAGS = "think|thinking|reasoning"
ANSWER_TEXT_MAX = 200
ERROR_TEXT_MAX = 500
MIN_LOGPROB = -745.0

_P = "".join("\\" + ch if ch in "\\^]-[&~#" else ch for ch in PUNCTUATION)
# All Unicode white space (written out: a pattern with Unicode classes is several times slower).
_W = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# What separates words (any Unicode white space) and what marks thinking.
FIRST_WORD = rf"^[{_W}{_P}]*([^{_W}{_P}](?:[^{_W}]*[^{_W}{_P}])?)"
FINAL_MARK = r"(?is)^.*<\|channel\|>\s*final\s*<\|message\|>"
ANY_MARK = r"(?i)<\|[a-z_]+\|>"
UP_TO_CLOSE = rf"(?is)^.*</\s*(?:{THINK_TAGS})\s*>"
HAS_CLOSE = rf"(?i)</\s*(?:{THINK_TAGS})\s*>"
HAS_OPEN = rf"(?i)<\s*(?:{THINK_TAGS})\s*>"


def strip_thinking(text: Column) -> Column:
    """Text after any thinking block; NULL when the text ends inside one."""
    final = text.rlike(FINAL_MARK)
    t = F.when(final, F.regexp_replace(F.regexp_replace(text, FINAL_MARK, ""), ANY_MARK, " ")).otherwise(text)
    return F.when(t.rlike(HAS_CLOSE), F.regexp_replace(t, UP_TO_CLOSE, "")).when(~t.rlike(HAS_OPEN), t)


def parse_answer(text: Column) -> Column:
    """'land', 'water' or NULL: the first word that is more than punctuation decides."""
    word = F.lower(F.regexp_extract(strip_thinking(text), FIRST_WORD, 1))
    return F.when(word.isin("land", "water"), word)


def token_class(token: Column) -> Column:
    """Which answer a first token starts: at least two letters of it, or the word and punctuation."""
    t = F.lower(F.ltrim(token, F.lit(TOKEN_PREFIX)))
    tail = rf"[{_W}{_P}]*"
    return F.when(t.rlike(rf"^(la|lan|land{tail})\z"), F.lit("land")).when(
        t.rlike(rf"^(wa|wat|wate|water{tail})\z"), F.lit("water")
    )


def surface(piece: Column) -> Column:
    """Vocabulary piece as text: space and newline markers replaced."""
    return F.translate(piece, "Ġ▁Ċ", "  \n")


def _degrees(n: Column) -> Column:
    """A count of 1/10000 degrees: whole degrees, and what is left without trailing zeros."""
    rest = F.rtrim(F.lpad((n % 10_000).cast("string"), 4, "0"), F.lit("0"))
    return F.concat(F.floor(n / 10_000), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(F.lit("")), F.lit("°"))


def _sixtieths(n: Column) -> Column:
    """A count of seconds of arc: degrees, minutes, seconds."""
    return F.format_string("%d°%02d'%02d\"", F.floor(n / 3600), F.floor(n / 60) % 60, n % 60)


# Styles with a letter for the side: steps in a degree, and the text of a count of steps. Axes: letters, and the degrees
# at which (besides 0) there is no side.
LETTERED = {"hemisphere": (10_000, _degrees), "dms": (3_600, _sixtieths)}
AXES = {"lat": ("N", "S", 0), "lon": ("E", "W", 180)}


def lettered(x: Column, axis: str, style: str) -> Column:
    steps, show = LETTERED[style]
    plus, minus, seam = AXES[axis]
    n = F.rint(F.abs(x) * steps).cast("bigint")
    side = F.when(n.isin(0, seam * steps), F.lit("")).when(x > 0, F.lit(" " + plus)).otherwise(F.lit(" " + minus))
    return F.concat(show(n), side)


def signed_decimal(x: Column) -> Column:
    """-12.0, 12.5, 0.0: at least one and at most four decimals, ties to even."""
    n = F.rint(F.abs(x) * 10_000).cast("bigint")
    rest = F.rtrim(F.lpad((n % 10_000).cast("string"), 4, "0"), F.lit("0"))
    sign = F.when((x < 0) & (n > 0), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.floor(n / 10_000), F.lit("."), F.when(rest == "", F.lit("0")).otherwise(rest))


def wrapped_lon(lon: Column) -> Column:
    """Longitudes in [-180, 180] as they are, others wrapped into [-180, 180)."""
    return F.when(lon.between(-180, 180), lon).otherwise(F.pmod(lon + 180.0, F.lit(360.0)) - 180.0)


def coordinate(lat: Column, lon: Column, fmt: Column) -> Column:
    """The point in one of the three styles; NULL for a latitude outside [-90, 90]."""
    at = {"lat": lat, "lon": wrapped_lon(lon)}
    pair = F.when(fmt == "signed_decimal", F.concat_ws(", ", *[signed_decimal(x) for x in at.values()]))
    for style in LETTERED:
        pair = pair.when(fmt == style, F.concat_ws(", ", *[lettered(x, axis, style) for axis, x in at.items()]))
    return F.when(lat.between(-90, 90), pair)


# A place in a template: nothing, or a fixed-point format with sign, width and 0 to 6 decimals.
NUMBER = r"(?::([+]?)(0?)([0-9]{0,2})\.([0-6])f)?"


def valid_template(template: Column) -> Column:
    """Whether the place is in it, and every {lat..} and {lon..} can be filled in."""
    known = F.regexp_replace(template, r"\{(lat|lon)" + NUMBER + r"\}", "")
    lat, lon = (template.rlike(r"\{" + axis + NUMBER + r"\}") for axis in ("lat", "lon"))
    return (template.contains("{coord}") | (lat & lon)) & ~known.rlike(r"\{(lat|lon)[:!}]")


def fixed(x: Column, sign: Column, zero: Column, width: Column, digits: Column) -> Column:
    """A number with ``digits`` decimals (ties to even), padded to ``width`` with blanks or, with ``zero``, zeros."""
    d = digits.cast("int")
    text = F.lit(None).cast("string")
    for k in range(7):
        text = F.when(d == k, F.format_string(f"%.{k}f", F.abs(F.bround(x, k)))).otherwise(text)
    mark = F.when(x < 0, F.lit("-")).when(sign == "+", F.lit("+")).otherwise(F.lit(""))
    n = F.coalesce(width.try_cast("int"), F.lit(0))
    gap = F.greatest(F.lit(0), n - F.length(text) - F.length(mark))
    return F.when(zero == "0", F.concat(mark, F.repeat(F.lit("0"), gap), text)).otherwise(F.concat(F.repeat(F.lit(" "), gap), mark, text))


def render_prompt(template: Column, lat: Column, lon: Column, fmt: Column) -> Column:
    """Put the place into a valid template: the text is cut where one stands, and each is filled in by its format."""
    parts = F.split(template, r"\{(?:coord|(?:lat|lon)" + NUMBER + r")\}", -1)
    places = F.regexp_extract_all(template, F.lit(r"\{(?:coord|(?:lat|lon)" + NUMBER + r")\}"), F.lit(0))

    def fill(p: Column) -> Column:
        x = F.when(p.startswith("{lat"), lat).otherwise(lon)
        spec = [F.regexp_extract(p, NUMBER + r"\}", k) for k in range(1, 5)]
        plain = F.when(p.contains(":"), fixed(x, *spec)).otherwise(signed_decimal(x))
        return F.when(p == "{coord}", coordinate(lat, lon, fmt)).when(p.isNotNull(), plain)

    return F.array_join(F.zip_with(parts, places, lambda a, p: F.concat(a, F.coalesce(fill(p), F.lit("")))), "")

"""Parts of a page's markup as expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from fathom.functions.rows import indexes, let, prefix_sums

COMMENT = r"(?s)<!--.*?-->"
SCRIPT = r"(?is)<script\b[^>]*>.*?</script\s*>"
STYLE = r"(?is)<style\b[^>]*>.*?</style\s*>"
TAG = r"</?[A-Za-z!?][^>]*>"
#: A tag with its attributes, whose quotes may hold any character.
ELEMENT = r"""</?[A-Za-z](?:[^>"']|"[^"]*+"|'[^']*+')*+>"""
BREAK = "\x01"
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
HEADING = r"(?is)<h1\b[^>]*>([^<]+)"
META = r"(?is)<meta\b[^>]*>"
META_NAME = r"""(?is)\sname\s*=\s*["']?description["'\s/>]"""
META_CONTENT = r"""(?is)\scontent\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
HREF = r"""(?is)<[a-z][^<>]*?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
ENTITY = r"&#?[A-Za-z0-9]+;|[^&]+|&"
# White space as Python's str.strip sees it.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(
    map(chr, range(0x2000, 0x200B)))


Step = tuple[str, str, list[str]]


def _opens(tag: Column, step: Step) -> Column:
    """The tag begins an element of the step: its name, and all its attributes."""
    _, name, attributes = step
    found = tag.rlike(rf"(?i)^<{name}(?![\w-])")
    for pattern in attributes:
        found = found & tag.rlike(pattern)
    return found


def _matching(tags: Column, step: Step) -> Column:
    return F.filter(indexes(tags), lambda i: _opens(F.get(tags, i), step))


def _ends(tags: Column, name: str, starts: Column) -> Column:
    """Begin and end (number of the closing tag, or of no tag) of the elements ``name`` that begin at ``starts``.

    Tags of the name are counted up and down; an element ends where the count is back at what it was before. One that is never
    closed lasts to the end of the page.
    """
    def change(t: Column) -> Column:
        return F.when(t.rlike(rf"(?i)^<{name}(?![\w-])"), 1).when(t.rlike(rf"(?i)^</{name}(?![\w-])"), -1).otherwise(0)

    def one(before: Column) -> Column:
        def end(i: Column) -> Column:
            return F.get(F.filter(indexes(tags), lambda j: (j > i) & (F.get(before, j + 1) <= F.get(before, i))), F.lit(0))
        return F.transform(starts, lambda i: F.struct(i.alias("begin"), F.coalesce(end(i), F.size(tags)).alias("end")))

    # One more place than there are tags: what the count is after the last.
    return let(prefix_sums(F.concat(F.transform(tags, change), F.array(F.lit(0)))), one)


def has_nested(html: Column, steps: list[Step]) -> Column:
    """The page has elements that stand to each other as ``steps`` say.

    Nearly all pages lack one of the tags; only the others' tags are numbered and paired.
    """
    def spans(tags: Column) -> Column:
        """Elements that fit each step by themselves."""
        return F.array(*[_ends(tags, step[1], _matching(tags, step)) for step in steps])

    def chained(found: Column) -> Column:
        """Whether a last one is left, when each step keeps the elements that stand to one of the step before as it says."""
        after_end = F.array(*[F.lit(how == "next") for how, _, _ in steps])

        def follow(before: Column, k: Column) -> Column:
            return F.filter(F.get(found, k), lambda own: F.exists(before, lambda x: F.when(
                F.get(after_end, k), own["begin"] == x["end"] + 1).otherwise((x["begin"] < own["begin"]) & (own["begin"] < x["end"]))))

        return F.size(F.aggregate(F.sequence(F.lit(1), F.lit(len(steps) - 1)), F.get(found, F.lit(0)), follow)) > 0

    possible = F.lit(True)
    for _, name, attributes in steps:
        possible = possible & html.rlike(rf"(?i)<{name}(?![\w-])")
        for pattern in attributes:
            possible = possible & html.rlike(pattern)
    tags = F.regexp_extract_all(without_noise(html), F.lit(ELEMENT), F.lit(0))
    return F.when(possible, let(let(tags, spans), chained)).otherwise(False)


def without_noise(html: Column) -> Column:
    """Markup without comments, scripts and styles."""
    for pattern in (COMMENT, SCRIPT, STYLE):
        html = F.regexp_replace(html, pattern, "")
    return html


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def decode_entities(text: Column) -> Column:
    """Character references to characters; unknown ones stay."""
    named = F.create_map(*[F.lit(x) for n, c in name2codepoint.items() for x in (n, chr(c))])

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, "^&#([0-9]{1,7});$", 1)
        hexes = F.regexp_extract(p, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1)
        code = F.when(digits != "", digits.try_cast("bigint")).when(
            hexes != "", F.conv(hexes, 16, 10).try_cast("bigint"))
        char = F.when((code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF), _char(code))
        name = F.regexp_extract(p, "^&([A-Za-z0-9]+);$", 1)
        return F.when(~p.startswith("&"), p).otherwise(F.coalesce(char, F.try_element_at(named, name), p))

    pieces = F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def title(clean: Column, url: Column) -> Column:
    """Text of the title, else of the first heading with text, else the URL."""
    def found(pattern: str) -> Column:
        return F.nullif(F.regexp_extract(clean, pattern, 1), F.lit(""))

    return F.coalesce(decode_entities(found(TITLE)), decode_entities(found(HEADING)), url)


def text(clean: Column, heading: Column) -> Column:
    """Text between tags, pieces stripped and joined by a space, without a leading title."""
    pieces = F.split(F.regexp_replace(clean, TAG, BREAK), BREAK)
    pieces = F.filter(F.transform(pieces, lambda p: strip(decode_entities(p))), lambda p: p != "")
    return F.array_join(pieces, " ")


def without_title(body: Column, heading: Column) -> Column:
    rest = F.when(F.startswith(body, heading), F.substring(body, F.length(heading) + 1, F.length(body))).otherwise(body)
    return F.ltrim(rest, F.lit(BLANKS))


def unquote(value: Column) -> Column:
    return decode_entities(F.regexp_replace(value, r"""^["']|["']$""", ""))


def description(clean: Column) -> Column:
    """Content of the description meta tag, empty if there is none."""
    tags = F.filter(F.regexp_extract_all(clean, F.lit(META), F.lit(0)), lambda t: t.rlike(META_NAME))
    value = F.regexp_extract(F.get(tags, F.lit(0)), META_CONTENT, 1)
    return F.coalesce(strip(unquote(value)), F.lit(""))


def hrefs(clean: Column) -> Column:
    """Every href attribute, in order."""
    return F.transform(F.regexp_extract_all(clean, F.lit(HREF), F.lit(1)), unquote)

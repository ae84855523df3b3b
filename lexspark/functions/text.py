"""Text functions as Column expressions: all run inside the JVM."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules_hr as hr


def squeeze(text: Column) -> Column:
    """Runs of white space, no-break spaces included, as one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Character references of HTML by name, from the standard library; '&amp;' is treated apart.
_NAMED = {name.removesuffix(";"): text for name, text in html.entities.html5.items() if name.endswith(";") and name != "amp;"}

#: Names that pages use most: they are looked at before the whole list, which is read from its start.
_USUAL = ("nbsp", "quot", "lt", "gt", "apos", "copy", "middot", "ndash", "mdash", "scaron", "zcaron")


def decode_references(text: Column) -> Column:
    """The text with character references decoded once, by name or number: those of the ampersand last, so what they uncover
    stays as it is. Unknown names and numbers that are no character stay too."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);"), F.lit(1)))
    names = F.from_json(F.lit(json.dumps(_NAMED)), "map<string,string>")

    def meaning(x: Column) -> Column:
        number = F.when(F.rlike(x, F.lit("^#[xX]")), F.conv(F.substr(x, F.lit(3)), 16, 10)).when(x.startswith("#"), F.substr(x, F.lit(2))).cast("int")
        valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        usual = F.when(x == _USUAL[0], _NAMED[_USUAL[0]])
        for name in _USUAL[1:]:
            usual = usual.when(x == name, _NAMED[name])
        return F.when(valid, char).otherwise(usual.otherwise(F.try_element_at(names, x)))

    def step(done: Column, x: Column) -> Column:
        return F.coalesce(F.when(meaning(x) != "&", F.replace(done, F.concat(F.lit("&"), x, F.lit(";")), meaning(x))), done)

    out = F.when(F.size(found) > 0, F.aggregate(found, text, step)).otherwise(text)
    return F.regexp_replace(out, "&(amp|#0*38|#[xX]0*26);", "&")


def clean_html(html: Column) -> Column:
    """The text nodes of a page, joined by blanks: comments, scripts, styles and templates go with what they hold."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->|<![^>]*>", " ")
    for tag in ("script", "style", "template"):
        out = F.regexp_replace(out, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"(?s)</?[A-Za-z][^>]*>", " ")
    return squeeze(decode_references(out))


def is_chapter(text: Column, strict: bool = False) -> Column:
    """A heading of Roman numerals. By default case does not matter, so a paragraph that begins with "i " counts."""
    return F.rlike(text, F.lit(hr.CHAPTER.replace("(?i)", "") if strict else hr.CHAPTER.replace("(?i)", "(?iU)")))


def is_article(text: Column, modern: bool = False) -> Column:
    return F.rlike(text, F.lit((hr.MODERN_ARTICLE if modern else hr.ARTICLE).replace("(?i)", "(?iU)")))


def paragraph_label(text: Column) -> Column:
    """``(N)`` at the start, '' without it."""
    return F.regexp_extract(text, hr.PARAGRAPH, 0)


def sentences(text: Column) -> Column:
    """Pieces between white space that follows ``.``, ``!`` or ``?``; blank ones go."""
    return F.filter(F.transform(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: F.trim(x)), lambda x: x != "")


def legal_sentences(text: Column) -> Column:
    """Sentences of legal prose: a mark ends one only before a capital, and not after a digit, a single letter or an
    abbreviation of the rule pack. Null gives null, a blank text an empty array."""
    words = "|".join(hr.ABBREVIATIONS)
    guard = rf"(?<![0-9][.!?])(?<!(?:^|[ ])(?iu:{words})[.!?])(?<!(?:^|[ ])\S?[.!?])"
    split = F.split(F.regexp_replace(F.trim(text), rf"(?<=[.!?]){guard}\s+(?=[A-ZŠĐČĆŽ])", "\u0001"), "\u0001")
    return F.filter(F.transform(split, lambda x: F.trim(x)), lambda x: x != "")


def parse_date(text: Column) -> Column:
    """The first ``d.m.yyyy`` anywhere in a text; null if there is none or it is no date."""
    return F.try_to_date(F.regexp_extract(text, r"\d{1,2}\.\d{1,2}\.\d{4}", 0), "d.M.yyyy")


def text_hash(text: Column) -> Column:
    return F.left(F.sha2(text, 256), F.lit(12))


def normalize_issue(text: Column) -> Column:
    """``a/b`` and ``nn a/b`` as ``NN a/b``; anything else only trimmed."""
    t = F.trim(text)
    return (
        F.when(F.rlike(t, F.lit(r"^\d{1,3}/\d{4}$")), F.concat(F.lit("NN "), t))
        .when(F.rlike(t, F.lit(r"(?i)^nn\s+\d{1,3}/\d{4}$")), F.concat(F.lit("NN "), F.regexp_extract(t, r"\d{1,3}/\d{4}$", 0)))
        .otherwise(t)
    )


def contains(text: Column, query: Column) -> Column:
    """Whether the text holds the query, whatever the case; false if either is empty or null."""
    return F.coalesce((F.length(text) > 0) & (F.length(query) > 0) & F.contains(F.lower(text), F.lower(query)), F.lit(False))


def eli_path(eli: Column) -> Column:
    """``year/issue/document`` of an identifier, without its leading part."""
    return F.regexp_replace(F.regexp_replace(eli, "^/?eli/sluzbeni/", ""), "^/", "")


def eli_page(eli: Column) -> Column:
    return F.concat(F.lit("/documents/"), F.regexp_replace(eli, "^/", ""))


def eli_data_url(eli: Column) -> Column:
    return F.concat(F.lit("/data/"), F.regexp_replace(eli, "^/", ""), F.lit(".json"))


def strip_numeral(text: Column) -> Column:
    """Without a leading Roman numeral."""
    return F.trim(F.regexp_replace(text, r"^[IVX]+\.?\s+", ""))


def title_case(text: Column) -> Column:
    """Every letter that follows a letter in lower case, every other one in upper case; of a letter that has several
    capitals, such as ß, the first alone."""
    marks = F.regexp_extract_all(text, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))

    def cased(x: Column) -> Column:
        head = F.upper(F.substring(x, 1, 1))
        return F.concat(F.substring(head, 1, 1), F.lower(F.concat(F.substr(head, F.lit(2)), F.substr(x, F.lit(2)))))

    return F.array_join(F.transform(marks, cased), "")


def title_subjects(title: Column) -> Column:
    """What an act's title says it is about: notes in brackets, the kind of act and stop words are left out."""
    plain = F.trim(F.regexp_replace(title, r"\(.*?\)", ""))
    parts = F.transform(F.split(plain, r"(?iU)\s+i\s+|\s*,\s*|\s+te\s+"), lambda p: F.trim(F.regexp_replace(F.trim(p), rf"(?iU)^(?:{hr.ACTS})\s+o\s+", "")))
    kept = F.transform(parts, lambda p: F.array_join(F.filter(F.split(p, r"(?U)\s+"), lambda w: ~F.lower(w).isin(*hr.STOP_WORDS) & (F.length(w) > 2)), " "))
    return F.filter(kept, lambda p: p != "")


def strip_label(text: Column, label: Column) -> Column:
    return F.trim(F.replace(squeeze(text), label, F.lit("")))


def article_pieces(text: Column) -> Column:
    """A flat text cut before every ``Član N.``; each piece with its heading, '' for what precedes the first."""
    cut = F.filter(F.transform(F.split(text, r"(?=Član\s+\d+\.)"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(cut, lambda x: F.struct(F.regexp_extract(x, r"^Član\s+\d+\.[^. ]*", 0).alias("heading"), F.trim(F.regexp_replace(x, r"^Član\s+\d+\.[^. ]*", "")).alias("body")))


def list_items(lines: Column) -> Column:
    """Blocks of lines: numbered lists, dashed items and plain paragraphs, as (kind, items).

    ``N.`` goes on with an open numbered list when it is the next number, or when the list's last item was no number, and opens
    a list otherwise; ``-`` makes a list of its own; blanks after either may be absent. Another line is an item of the open list if it is blank or
    begins with a lower-case letter, and a paragraph otherwise, which closes the list. A fold over the row's array: no shuffle.
    """
    block = "struct<kind:string,items:array<string>,last:double>"
    start = F.array().cast(f"array<{block}>")

    def make(kind: str, item: Column, last: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.array(item).alias("items"), last.cast("double").alias("last"))

    def step(done: Column, line: Column) -> Column:
        n = F.size(done)
        tail = F.try_element_at(done, F.when(n > 0, n).otherwise(F.lit(1)))
        front = F.slice(done, F.lit(1), F.greatest(n - 1, F.lit(0)))
        own = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
        numbered, dashed = F.rlike(own, F.lit(r"^[0-9]+\.(?U:\s*).")), F.rlike(own, F.lit(r"^-(?U:\s*)."))
        number = F.when(numbered, F.regexp_extract(own, r"^([0-9]+)\.", 1)).cast("double")
        body = F.regexp_replace(own, r"^([0-9]+\.|-)(?U:\s*)", "")
        listed = F.coalesce(tail["kind"] != "paragraph", F.lit(False))
        goes_on = numbered & F.coalesce(tail["kind"] == "decimal", F.lit(False)) & ((number == tail["last"] + 1) | (tail["last"] == 0))
        joins = ~numbered & ~dashed & listed & F.rlike(own, F.lit(r"^([a-zäöü]|$)"))
        grown = F.struct(tail["kind"].alias("kind"), F.concat(tail["items"], F.array(F.when(numbered, body).otherwise(own))).alias("items"), F.coalesce(number, F.lit(0.0)).alias("last"))
        return (
            F.when(goes_on | joins, F.concat(front, F.array(grown)))
            .when(numbered, F.concat(done, F.array(make("decimal", body, number))))
            .when(dashed, F.concat(done, F.array(make("disc", body, F.lit(0)))))
            .otherwise(F.concat(done, F.array(make("paragraph", line, F.lit(0)))))
            .cast(f"array<{block}>")
        )

    kept = F.filter(lines, lambda x: x.isNotNull())
    return F.transform(F.aggregate(kept, start, step), lambda b: F.struct(b["kind"].alias("kind"), b["items"].alias("items")))

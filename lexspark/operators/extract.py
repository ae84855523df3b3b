"""Rule-based extraction: lists of phrases and paragraphs, in order and without repetitions, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexspark.functions import rules_hr as hr
from lexspark.functions import text as T


def dedupe(items: Column, longest: int) -> Column:
    """Trimmed items that are not blank, in order; of those whose first 60 characters agree whatever the case, the
    first. Items are cut at `longest` characters. Sorted within the row: no shuffle."""
    kept = F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    keyed = F.array_sort(F.transform(kept, lambda x, i: F.struct(F.lower(F.substring(x, 1, 60)).alias("k"), i.alias("i"), x.alias("v"))))
    # bound to a variable, so that the sorted array is made once and not for each of its elements
    first = F.transform(F.array(keyed), lambda a: F.filter(a, lambda x, i: (i == 0) | (F.get(a, i - 1)["k"] != x["k"])))
    ordered = F.array_sort(F.transform(F.get(first, F.lit(0)), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))))
    return F.transform(ordered, lambda x: F.left(x["v"], F.lit(longest)))


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def holding(items: Column, phrases: str) -> Column:
    return F.filter(items, lambda x: F.rlike(x, F.lit(hr.marked(phrases).replace("(?i)", "(?iU)"))))


def deadlines(text: Column) -> Column:
    """All matches of each pattern, pattern by pattern; patterns that overlap each count."""
    return dedupe(F.flatten(F.array(*[found(text, f"(?iU){p}") for p in hr.DEADLINES])), hr.LENGTHS["deadlines"])


def bodies(text: Column, items: Column) -> Column:
    """Capitalised names in paragraphs that name an institution, then headers in capitals, in title case."""
    named = F.flatten(F.transform(holding(items, hr.INSTITUTIONS), lambda s: F.transform(found(s, rf"(?U)\b(?:{hr.BODY})"), lambda x: F.trim(x))))
    institution = F.lit(hr.marked(hr.INSTITUTIONS).replace("(?i)", "(?iU)"))
    good = F.filter(named, lambda b: F.rlike(b, institution) | F.forall(F.filter(F.split(b, r"\s+"), lambda w: F.length(w) > 2), lambda w: F.rlike(w, F.lit(r"^\p{Lu}"))))
    heads = F.transform(F.filter(found(text, rf"(?U)\b{hr.HEADER}\b"), lambda h: F.rlike(h, institution)), lambda h: T.title_case(F.trim(h)))
    return dedupe(F.concat(good, heads), hr.LENGTHS["responsible_bodies"])


def obligations(items: Column) -> Column:
    return dedupe(holding(items, hr.OBLIGATION), hr.LENGTHS["obligations"])


def scope(items: Column) -> Column:
    return dedupe(holding(items, hr.SCOPE), hr.LENGTHS["scope"])


def sanctions(items: Column) -> Column:
    return dedupe(holding(items, hr.SANCTION), hr.LENGTHS["sanctions"])


def subjects(title: Column, headings: Column, items: Column) -> Column:
    """From the title, then from chapter headings, then from paragraphs that are headings in capitals."""
    capital = F.filter(items, lambda x: F.rlike(x, F.lit(hr.CAPITAL_HEADING)))
    capital = F.transform(capital, lambda x: T.title_case(F.trim(F.regexp_replace(x, r"^[IVXLC]+\.\s+", ""))))
    none = F.array().cast("array<string>")
    return dedupe(F.concat(F.coalesce(T.title_subjects(title), none), F.coalesce(F.transform(headings, T.strip_numeral), none), capital), hr.LENGTHS["subjects"])


def extract(title: Column, text: Column, items: Column, headings: Column) -> Column:
    return F.struct(
        bodies(text, items).alias("responsible_bodies"), obligations(items).alias("obligations"), deadlines(text).alias("deadlines"),
        scope(items).alias("scope"), subjects(title, headings, items).alias("subjects"), sanctions(items).alias("sanctions"),
    )


def panel(info: Column) -> Column:
    """Sections that are not empty: name, the first five items, and how many more there are."""
    names = ("subjects", "responsible_bodies", "obligations", "deadlines", "scope", "sanctions")
    each = F.array(*[F.struct(F.lit(n).alias("section"), F.slice(info[n], 1, 5).alias("items"), F.greatest(F.size(info[n]) - 5, F.lit(0)).alias("more")) for n in names])
    return F.filter(each, lambda s: F.size(s["items"]) > 0)


def has_key_info(info: Column) -> Column:
    """Whether one of the four lists that a page shows as key information holds anything; scope and sanctions don't count."""
    return (F.size(info["responsible_bodies"]) + F.size(info["obligations"]) + F.size(info["deadlines"]) + F.size(info["subjects"])) > 0

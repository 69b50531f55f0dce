"""Scalar functions on text, as columns: no Python runs on the data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without Unicode white space at either end; null stays null."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def embedding_text(title: Column, abstract: Column) -> Column:
    """Title and abstract on lines of their own, stripped. Null counts as the empty text."""
    return strip(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, in order; an empty array for null."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit("[a-zA-Z0-9]+"), F.lit(0))
    return F.transform(found, F.lower)


def tex_clean(c: Column) -> Column:
    """TeX without comments, comment environments, switched-off parts, forced line ends and wide gaps."""
    out = F.regexp_replace(c, r"(?d)%.*\n", "\n")
    out = F.regexp_replace(out, r"(?s)\\begin\{comment\}.*?\\end\{comment\}", "")
    out = F.regexp_replace(out, r"(?s)\\iffalse.*?\\fi", "")
    out = F.regexp_replace(out, r"\n+", "\n")
    out = F.regexp_replace(out, r"\\\\", "")
    return F.regexp_replace(out, r"[ \t\r\f]{3,}", " ")


def is_main_tex(path: Column, content: Column) -> Column:
    """Whether a TeX file begins a document and isn't named as an example, sample or template."""
    return content.rlike(r"\\begin\{document\}") & ~path.rlike("example|sample|template")


def feed_id(c: Column) -> Column:
    """An identifier without the feed's prefix."""
    return F.regexp_replace(c, r"^oai:[a-zA-Z.]+:", "")


def source_url(c: Column) -> Column:
    """Where the source archive of a PDF address is."""
    return F.replace(c, F.lit("/pdf/"), F.lit("/src/"))


def html_url(c: Column) -> Column:
    """Where the HTML page of an abstract's address is."""
    return F.replace(c, F.lit("/abs/"), F.lit("/html/"))


def pdf_url(server: Column, doi: Column, version: Column) -> Column:
    """The address of a preprint's PDF."""
    return F.concat(F.lit("https://www."), server, F.lit(".org/content/"), doi, F.lit("v"), version, F.lit(".full.pdf"))


def split_names(c: Column) -> Column:
    """A field cut at semicolons, each part stripped; the empty field gives one empty name."""
    return F.transform(F.split(c, ";", -1), strip)


def shown_authors(names: Column) -> Column:
    """Up to five names; of more the first three and the last two. Null and no names give the empty text."""
    some = F.coalesce(names, F.array().cast("array<string>"))
    long = F.concat(F.slice(some, 1, 3), F.array(F.lit("...")), F.slice(some, -2, 2))
    return F.array_join(F.when(F.size(some) <= 5, some).otherwise(long), ", ")


def shown_affiliations(names: Column) -> Column:
    """Up to five organisations and a mark for more; null tells that they are unknown."""
    first = F.array_join(F.slice(names, 1, 5), ", ")
    return F.when(names.isNull(), "Unknown Affiliation").when(F.size(names) > 5, F.concat(first, F.lit(", ..."))).otherwise(first)


def shown_score(score: Column) -> Column:
    """The score with one decimal, Unknown for null."""
    return F.when(score.isNull(), "Unknown").otherwise(F.format_string("%.1f", F.bround(score, 1)))


def stars(score: Column) -> Column:
    """Stars from 6 (none) to 8 (five), half a star for each fifth of a point begun; null gives none."""
    halves = F.ceil((score - 6) / F.lit(0.2)).cast("int")
    full, half = F.floor(halves / 2).cast("int"), halves % 2
    some = F.concat(F.repeat(F.lit("★"), full), F.repeat(F.lit("☆"), half))
    return F.when(score.isNull() | (score <= 6), "").when(score >= 8, "★★★★★").otherwise(some)


def listed(answer: Column) -> Column:
    """The first bracketed JSON list of strings in a model's answer, without repetitions; null if there is none."""
    first = F.regexp_extract(answer, r"(?s)\[.*?\]", 0)
    return F.array_distinct(F.from_json(first, "array<string>", {"allowSingleQuotes": "false"}))


def matches_any(title: Column, abstract: Column, keywords: list[str]) -> Column:
    """Whether a keyword, in lower case, is anywhere in the title and abstract."""
    hay = F.lower(F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.contains(hay, F.lit(k))
    return hit


def summary_prompt(title: Column, abstract: Column, full_text: Column, language: str = "English") -> Column:
    """What a model is asked for a summary; without abstract and full text a fixed note instead."""
    def said(label: str, c: Column) -> Column:
        return F.when(F.length(c) > 0, F.concat(F.lit(f"{label}:\n"), c, F.lit("\n\n"))).otherwise("")

    nothing = (F.coalesce(F.length(abstract), F.lit(0)) == 0) & (F.coalesce(F.length(full_text), F.lit(0)) == 0)
    asked = F.concat(F.lit(f"Summarise this paper in one sentence of {language}.\n\n"), said("Title", title), said("Abstract", abstract), said("Text", full_text))
    return F.when(nothing, "No text to summarise.").otherwise(asked)


def affiliation_prompt(full_text: Column) -> Column:
    """What a model is asked for the authors' organisations; null without a full text."""
    return F.when(full_text.isNotNull(), F.concat(F.lit("List the authors' organisations as a JSON array of strings, in the order of the authors.\n\n"), full_text))


def first_text(*tiers: Column) -> Column:
    """The first tier that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in tiers])


def escaped(c: Column) -> Column:
    """Text for HTML."""
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for raw, safe in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out

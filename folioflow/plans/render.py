"""A digest as HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.text import escaped, shown_affiliations, shown_authors, shown_score

EMPTY = "<html><body><p>No papers today. Take a rest!</p></body></html>"


def block(title: Column, authors: Column, affiliations: Column, score: Column, tldr: Column, url: Column, pinned: Column) -> Column:
    """One paper's block; texts are escaped."""
    badge = F.when(pinned, "<b>Pinned</b> ").otherwise("")
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(
        F.lit("<div class='paper'><h3>"), badge, escaped(some(title)), F.lit("</h3><p>"), escaped(shown_authors(authors)), F.lit("</p><p><i>"), escaped(shown_affiliations(affiliations)),
        F.lit("</i></p><p>Relevance: "), shown_score(score), F.lit("</p><p>"), escaped(some(tldr)), F.lit("</p><a href='"), escaped(some(url)), F.lit("'>PDF</a></div>"),
    )


def page(digest: DataFrame) -> DataFrame:
    """One row, html: the blocks by section and position. digest: section, position, block; it is as long as a digest."""
    parts = digest.groupBy().agg(F.array_sort(F.collect_list(F.struct("section", "position", "block"))).alias("all"))

    def part(name: str, label: str) -> Column:
        own = F.filter("all", lambda x: x["section"] == name)
        return F.when(F.size(own) > 0, F.concat(F.lit(f"<h2>{label}</h2>"), F.array_join(F.transform(own, lambda x: x["block"]), ""))).otherwise("")

    html = F.concat(F.lit("<html><body>"), part("pinned", "Pinned"), part("recommended", "Recommended"), F.lit("</body></html>"))
    return parts.select(F.when(F.size("all") > 0, html).otherwise(EMPTY).alias("html"))

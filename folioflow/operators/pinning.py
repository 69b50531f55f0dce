"""Putting keyword matches on top of a ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def resolve_keywords(keywords: object) -> list[str]:
    """Keywords in lower case without blanks around them; empty ones are dropped, None is none."""
    return [k for k in (str(x).strip().lower() for x in keywords or ()) if k]  # type: ignore[attr-defined]


def resolve_cap(value: object, default: int = 20) -> int:
    """How many may be pinned: not below 0, and the default for what is no number."""
    try:
        return max(0, int(value))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


def pin(ranking: DataFrame, match: str, cap: int, n: int, overflow: str = "compat") -> DataFrame:
    """The digest's rows: at most `cap` pinned matches and the first n of the rest.

    ranking: id, score and the boolean column `match`. overflow says what becomes
    of matches beyond the cap: "compat" puts them ahead of all others and shows
    them as pinned, "by_score" lets them compete by score and shows them with the
    rest. Added: pinned, section, position. Ties of score go by id; null scores
    come last. Only the bests of each side are kept before anything is ordered as
    a whole, so no task sees more than cap + n rows of a partition.
    """
    hit = F.coalesce(F.col(match), F.lit(False))
    by_score = [F.desc_nulls_last("score"), F.col("id")]
    first = ranking.where(hit).orderBy(*by_score).limit(cap).withColumn("pinned", F.lit(True))
    taken = first.select("id")
    # Of the matches at most cap + n can be shown, of the others n.
    some = ranking.where(hit).orderBy(*by_score).limit(cap + n).unionByName(ranking.where(~hit).orderBy(*by_score).limit(n))
    rest = some.join(F.broadcast(taken), "id", "left_anti")  # at most `cap` ids
    order = [F.desc(hit), *by_score] if overflow == "compat" else by_score
    rest = rest.orderBy(*order).limit(n).withColumn("pinned", F.lit(False))
    both = first.unionByName(rest)
    shown = F.when(F.col("pinned") | (hit if overflow == "compat" else F.lit(False)), "pinned").otherwise("recommended")
    place = W.orderBy("section", F.desc_nulls_last("score"), "id")  # cap + n rows
    return both.withColumn("section", shown).withColumn("position", F.row_number().over(place))

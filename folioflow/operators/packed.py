"""Several values packed in one field: one row per value, with its position.

The field is split on the quote character. Odd pieces are literals, whose
delimiters are escaped; even pieces are plain text, in which delimiters count.
SQL array folds put the pieces together again, split the result and number the
values. Everything is a column expression; no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The delimiters that never stand inside a name.
STRONG = ";；|/·、\t\n\r"
# Words that a group's name has before "on", "for" or "of".
GROUP_HEADS = (
    "Group|Consortium|Collaboration|Panel|Committee|Commission|Network|Team|Initiative|Investigators|Alliance"
    "|Society|Association|Council|Task Force|Project|Centre|Center|Institute|Federation|Partnership|Board|Forum"
)
# Lower-case words that begin a family part.
PARTICLES = "van|von|der|den|de|del|della|di|da|dos|du|la|le|el|al|bin|ibn|ter|ten|zu|zur"
# Stand-ins for further authors that are not named.
UNNAMED = r"(?:(?:and|&|und|et)\s+)?(?:et\.?\s*al\b\.?|others|other authors|further authors|u\.\s?a\.|\.{3,}|…|n/?a|null|none|-+)"

#: Stands ahead of a character of a literal that delimits nothing there; one that the field itself has becomes ESCAPE + OWN.
ESCAPE, OWN = "\ue000", "e"
#: Stands for an escaped quote of a JSON string while quotes are looked for.
INNER = ESCAPE + "q"


def _strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\ufeff\u200b]+|[\s\ufeff\u200b]+$", "")


def _fold_quotes(field: Column) -> Column:
    """The field with the delimiters of its literals escaped; quotes stay where they are.

    Pieces between quotes count from 0: odd ones are literals, wherever they
    stand. A doubled quote inside a literal is an empty even piece between two
    odd ones. An odd number of quotes is no quoting: the quotes are text.
    """
    pieces = F.split(field, '"')
    escaped = F.transform(pieces, lambda x, i: F.when(i % 2 == 1, F.regexp_replace(x, rf"([{STRONG},&]|\b(?:and|und)\b)", f"{ESCAPE}$1")).otherwise(x))
    folded = F.aggregate(escaped, F.lit(None).cast("string"), lambda acc, x: F.coalesce(F.concat(acc, F.lit('"'), x), x))
    return F.when(field.contains('"') & (F.size(pieces) % 2 == 1), folded).otherwise(field)


def _undone(value: Column) -> Column:
    """A value with its quoting and all escapes undone."""
    quoted = F.regexp_replace(F.regexp_extract(value, r'(?s)^"(.*)"$', 1), '""', '"')
    text = F.when(value.rlike(r'(?s)^".*"$') & (F.length(value) > 1), quoted).otherwise(value)
    plain = F.regexp_replace(F.regexp_replace(text, INNER, '"'), f"{ESCAPE}([^{OWN}])", "$1")
    return F.when(text.contains(ESCAPE), F.regexp_replace(plain, ESCAPE + OWN, ESCAPE)).otherwise(text)


def _full_name(part: Column) -> Column:
    """Whether the part has a given and a family part, not only one of them."""
    word = r"[\p{L}][\p{L}\p{M}'’.\-]*[\p{L}\p{M}]{1}[\p{L}\p{M}'’.\-]*"
    rest = F.regexp_replace(part, rf"(?i)^\s*(?:(?:{PARTICLES})\s+)*", "")
    two = rest.rlike(rf"(?U)\S\s+\S") & rest.rlike(rf"(?U)(?:^|\s)\(?{word}")
    return two | part.rlike(r"^\s*\p{L}\.(?:\s*-?\p{L}\.)*\p{L}[\p{L}\p{M}'’\-]+\.?\s*$")


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _by_commas(segment: Column) -> Column:
    """The names of a piece that commas may delimit: each part a full name, or all of it one name with its family part first."""

    def told(parts: Column, s: Column) -> Column:
        names = F.forall(parts, lambda p: (p == "") | _full_name(p) | p.rlike(rf"(?i)^{UNNAMED}$"))
        return F.when(names, parts).otherwise(F.array(F.regexp_replace(s, r"^[\s,]+|[\s,]+$", "")))

    return F.when(segment.contains(","), _bound(F.transform(F.split(segment, rf"(?<!{ESCAPE}),"), _strip), lambda parts: told(parts, segment))).otherwise(F.array(segment))


_AND = rf"(?U)(?:\s*,)?\s+(?:and|und)\s+|^\s*(?:and|und)\s+|\s*(?:,\s*)?(?<!{ESCAPE})&\s*"
_LEAD = r"^\s*(?:,\s*)?(?:(?:and|und|&)\s+)?"
_HEAD = rf"(?:\p{{Lu}}[\p{{L}}\p{{N}}\-]*\s+){{0,4}}(?:{GROUP_HEADS})\s+(?:on|for|of|in)\s"


def _names(segment: Column) -> Column:
    """The names in a piece that holds no strong delimiter."""

    def with_group(before: Column) -> Column:
        group = F.regexp_replace(F.substring(segment, F.length(before) + F.lit(1), F.length(segment)), _LEAD, "")
        rest = F.flatten(F.transform(F.split(before, _AND), lambda s: F.split(s, rf"(?<!{ESCAPE}),")))
        return F.when(F.length(before) > 0, F.concat(rest, F.array(group))).otherwise(plain)

    plain = F.when(segment.rlike(_AND), F.flatten(F.transform(F.split(segment, _AND), _by_commas))).otherwise(_by_commas(segment))
    grouped = _bound(F.regexp_extract(segment, rf"(?s)^(.*?)(?:,?\s+(?:and|und|&)\s+|,\s*){_HEAD}", 1), with_group)
    return (
        F.when(segment.rlike(r'(?s)^\s*".*"\s*$'), F.array(segment))
        .when(~segment.rlike(rf"(?:{GROUP_HEADS})\s+(?:on|for|of|in)\s"), plain)
        .when(segment.rlike(rf"^\s*(?:(?:and|und|&)\s+)?(?:[Tt]he\s+)?{_HEAD}"), F.array(F.regexp_replace(segment, r"^\s*(?:(?:and|und|&)\s+)?", "")))
        .otherwise(grouped)
    )


def packed_values(field: Column) -> Column:
    """The values of a packed field, in order, as an array of strings.

    Null, an empty field, a field of blanks or of delimiters only: an empty
    array. Stand-ins for unnamed values ("et al.") and blank slots are left
    out and take no number. A value is as typed, with quoting and escapes
    undone and no white space around it. Quoting counts slot by slot: a slot
    that begins and ends with a quote is quoted, in another the quotes are
    text; either way nothing between quotes delimits. Repeated values stay,
    each with its own number. Nothing bounds a field's length or number of
    values, and no character of it is lost.
    """
    own = F.when(field.contains(ESCAPE), F.regexp_replace(field, ESCAPE, ESCAPE + OWN)).otherwise(field)
    is_json = F.regexp_replace(own, r'\\.', "").rlike(r'(?s)^\s*\[\s*(?:"[^"]*"\s*(?:,\s*"[^"]*"\s*)*)?\]\s*$')

    # The quotes inside a JSON string are set apart first; its brackets are none of the text.
    inner = F.regexp_replace(F.regexp_replace(own, r'((?:^|[^\\])(?:\\\\)*)\\"', f"$1{INNER}"), r"^\s*\[|\]\s*$", "")
    plain = F.when(is_json, inner).otherwise(own)

    def slots(folded: Column) -> Column:
        # A comma or "&" delimits quoted slots too; elsewhere it may stand inside a name.
        quoted = folded.rlike(rf'(?s)(?:^|(?<!{ESCAPE})[{STRONG},&])\s*"[^"]*(?:""[^"]*)*"\s*(?:$|[{STRONG},&])')
        hard = F.split(folded, rf"(?<!{ESCAPE})[{STRONG}]")
        soft = F.split(folded, rf'(?<!{ESCAPE})[{STRONG}]|(?<=")\s*(?<!{ESCAPE})[,&]|(?<!{ESCAPE})[,&](?=\s*")')
        return F.when(quoted, soft).otherwise(hard)

    names = F.flatten(F.transform(_bound(_fold_quotes(plain), slots), _names))
    clean = F.transform(
        F.transform(names, lambda s: _strip(F.regexp_replace(s, r"(?iU)[\s,]+et\.?\s*al\b\.?\s*$", ""))),
        lambda s: _strip(F.when(s.contains('"') | s.contains(ESCAPE), _undone(F.when(is_json & s.contains("\\"), F.coalesce(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>")[0], s)).otherwise(s))).otherwise(s)),
    )
    kept = F.filter(clean, lambda s: s.rlike(r"[\p{L}\p{N}]") & ~s.rlike(rf"(?i)^{UNNAMED}$"))
    return F.coalesce(kept, F.array().cast("array<string>"))


def explode_packed(df: DataFrame, field: str, value: str, position: str) -> DataFrame:
    """One row per value of df[field], with the columns `position` and `value`.

    The other columns of df stay; columns of df named like the new ones are
    replaced. Rows whose field holds no value give no row.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in (value, position)]
    packed = packed_values(F.col(f"`{field}`")).alias("__values")
    exploded = df.select(*keep, packed).select(*keep, F.posexplode("__values").alias("__at", value))
    return exploded.select(*keep, (F.col("__at") + 1).cast("int").alias(position), F.col(f"`{value}`"))

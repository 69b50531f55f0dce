"""What a title says, apart from how it was typed: shared by the operators on works."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from typing import NamedTuple

import xxhash

# Words that join the parts of a title and change when it is rearranged.
STOP = frozenset(
    "a across an and at by data enough for from in into is it its of on or over revisited the through to towards toward under using via with".split()
)
# Common short forms of title words.
SHORT = {
    "bayes": "bayesian", "classif": "classification", "nets": "networks", "net": "network", "private": "privacypreserving", "traj": "trajectory",
    "segm": "segmentation", "recog": "recognition", "opt": "optimization", "eval": "evaluation", "repr": "representation", "exp": "experimental",
    "intl": "international", "approx": "approximate", "est": "estimation", "dist": "distributed", "sys": "systems", "algo": "algorithm",
}
# Words and phrases that make a title that of another work about the first.
DERIVED_FIRST = ("rethinking", "erratum", "corrigendum", "retraction")
DERIVED_FIRST_TWO = ("comment on", "comments on", "reply to", "response to", "correction to", "erratum to", "addendum to", "supplement to", "review of")
DERIVED_LAST_TWO = (
    "second edition", "third edition", "fourth edition", "revised edition", "supplementary results", "supplementary material",
    "supplementary materials", "supplementary information", "supplemental material", "extended edition",
)
NUMERALS = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "one": "1", "two": "2", "three": "3"}

_TAG = re.compile(r"[\[(]\s*(?:v\d+|preprint|revised(?: version)?|updated(?: version)?|accepted(?: version)?|arxiv)\s*[\])]|^\W*(?:arxiv|revised|preprint|updated|title)\s*:")
_MARKUP = re.compile(r"\\[a-z]+|[$*_^{}`]|</?[a-z]{1,6}>|&[a-z]+;")
_WORD = re.compile(r"[^\W_]+")
_ISE = re.compile(r"is(ation|ations|ing|ed|e|es|er|ers)$")


class Title(NamedTuple):
    """words: the telling words in order; derived: what kind of work about a work it is, or ''."""

    words: tuple[str, ...]
    derived: str
    cut: bool
    name: str


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, now[j - 1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return row[-1]


def near(a: str, b: str) -> bool:
    """Whether two words may be one word typed with slips."""
    shorter = min(len(a), len(b))
    return distance(a, b, 1 if shorter < 6 else 2) <= (0 if shorter < 3 else 1 if shorter < 6 else 2)


@lru_cache(100_000)
def _word(w: str) -> str:
    w = SHORT.get(w, w)
    return _ISE.sub(r"iz\1", w)


@lru_cache(100_000)
def _derived_first(w: str) -> str:
    return next((d for d in DERIVED_FIRST if near(w, d)), "")


@lru_cache(100_000)
def _derived_first_two(two: str) -> str:
    return next((d for d in DERIVED_FIRST_TWO if near(two, d)), "")


@lru_cache(100_000)
def _derived_last_word(w: str) -> bool:
    return any(near(w, d.split()[1]) for d in DERIVED_LAST_TWO)


@lru_cache(100_000)
def _derived_last_two(last: str) -> str:
    return next((d for d in DERIVED_LAST_TWO if distance(last, d, 2) <= 2), "")


def fold(text: str) -> str:
    """Lower case, without accents, ligatures, markup and repeated blanks."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c))
        text = re.sub(r"[‐-―−]", "-", text)
    return " ".join(_MARKUP.sub("", text.lower()).split())


def title(text: str | None) -> Title:
    """The title, taken apart. Null, empty and blank titles have no words."""
    f = fold(text or "")
    if "[" in f or "(" in f or ":" in f:
        f = _TAG.sub(" ", _TAG.sub(" ", f)).strip()
    cut = f.endswith(("...", "…"))
    if cut:
        f = f.rstrip(".… ")
        tail = f.rpartition(" ")
        f = tail[0] if tail[0] else f  # the last word may be cut itself
        if f.endswith("-"):
            f = f.rpartition(" ")[0]
    name = ""
    head, sep, _ = f.partition(":")
    if not sep or " " in head.strip():
        head, sep, _ = f.partition(" - ")
    if sep and " " not in head.strip():
        name = "".join(_WORD.findall(head))
    raw = _WORD.findall(f.replace("'", "").replace("-", ""))
    derived = ""
    if raw:
        first, two, last = raw[0], " ".join(raw[:2]), " ".join(raw[-2:])
        known = _derived_first(first) if len(first) > 6 else ""
        if known:
            derived, raw = known, raw[1:]
        elif len(raw) > 3 and raw[1] in ("on", "to", "of") and _derived_first_two(two):
            derived, raw = _derived_first_two(two), raw[2:]
        if len(raw) > 3:
            if _derived_last_word(raw[-1]):
                if known := _derived_last_two(last):
                    derived, raw = derived + "|" + known, raw[:-2]
            elif (raw[-1] in NUMERALS or raw[-1].isdigit()) and len(raw[-2]) > 2 and near(raw[-2], "part"):
                derived, raw = derived + "|part" + NUMERALS.get(raw[-1], raw[-1]), raw[:-2]
    words = tuple(_word(w) for w in raw if w not in STOP)
    return Title(words, derived, cut, name if name and words and words[0] == _word(name) else "")


@lru_cache(100_000)
def _joining(w: str) -> bool:
    """Whether the word is a joining word typed with slips."""
    return len(w) > 3 and any(len(s) > 2 and s[0] == w[0] and near(w, s) for s in STOP)


@lru_cache(100_000)
def code(word: str) -> int:
    """32 bits of a word's letters without order and repetition, which most slips leave alone."""
    return xxhash.xxh32_intdigest("".join(sorted(set(word))))


def same_words(a: Title, b: Title) -> bool:
    """Whether two titles have the same words but for slips, order, a system's name and a cut tail."""
    if a.derived != b.derived or not a.words or not b.words:
        return False
    left, right = list(a.words), list(b.words)
    for w in a.words:
        if w in right:
            left.remove(w)
            right.remove(w)
    for w in list(left):
        found = min(((distance(w, x, 2), x) for x in right if near(w, x)), default=None)
        if found:
            left.remove(w)
            right.remove(found[1])
    left = [w for w in left if not _joining(w)]
    right = [w for w in right if not _joining(w)]
    if left and right:  # compounds typed apart or together
        one, other = "".join(left), "".join(right)
        if near(one, other):
            left, right = [], []
    common = len(a.words) - len(left)
    if left == [a.name] and not b.name:
        left = []
    if right == [b.name] and not a.name:
        right = []
    if a.name and b.name and left == [a.name] and right == [b.name]:
        return False
    if b.cut and left and common >= 5:
        left = [] if len(b.words) - len(right) == common and not right else left
    if a.cut and right and common >= 5:
        right = [] if not left else right
    return not left and not right and common >= 4

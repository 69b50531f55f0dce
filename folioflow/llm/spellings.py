"""Linking the spellings of one person or organisation by merge and rematch.

Every distinct spelling starts as a profile of its own. Profiles meet in blocks
(the beginning, the end and the letters of the telling word); within a block
those that can only be one entity are merged. A merged profile has the union of
its members' spellings, given names and initials, so it may match what none of
its members matched: it enters the blocks again, until no further merge occurs.

Short forms (initials, acronyms, abbreviations) are merged only where one
entity alone can be meant.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.lineage import cut
from folioflow.llm.components import components
from folioflow.llm.titles import distance, fold

# Words of a family part and of forms of address.
PARTICLES = frozenset("van von der den de del della di da dos du la le el al bin ibn ter ten zu zur".split())
ADDRESS = frozenset("dr prof professor mr mrs ms mx sir dame md phd".split())
SUFFIX = frozenset("jr sr ii iii iv".split())
# Short forms of given names.
SHORT_GIVEN = {
    "abby": "abigail", "alex": "alexander", "sasha": "alexander", "bart": "bartholomew", "ben": "benedikt", "bella": "isabella", "bert": "albert", "betty": "elisabeth", "lisa": "elisabeth", "liz": "elisabeth", "bill": "william", "will": "william",
    "bimbo": "abimbola", "bob": "robert", "rob": "robert", "chris": "christopher", "dan": "daniel", "dave": "david", "dora": "dorothea", "thea": "dorothea", "ed": "edward", "ella": "eleanora", "nora": "eleanora", "fifi": "josephine", "jo": "josephine",
    "giulia": "giuliana", "ibo": "ibrahim", "jim": "james", "jon": "jonathan", "kat": "katarina", "katya": "katarina", "kate": "katherine", "klaus": "nikolas", "nick": "nikolas", "maggie": "margaret", "peggy": "margaret", "matt": "matthias", "max": "maximilian",
    "mike": "michael", "mina": "wilhelmina", "nadia": "nadezhda", "nanda": "fernanda", "nele": "cornelia", "pippa": "philippa", "sam": "samuel", "steve": "steven", "sue": "susan", "teo": "teodor", "tess": "theresa", "tom": "thomas", "tony": "anthony",
    "vasya": "vasilisa", "vicky": "victoria", "zack": "zacharias", "zhenya": "yevgenia",
}

SHORT_GIVEN |= {
    "al": "albert", "andy": "andrew", "drew": "andrew", "annie": "anne", "beth": "elizabeth", "becky": "rebecca", "cathy": "catherine", "charlie": "charles", "chuck": "charles", "cindy": "cynthia", "debbie": "deborah", "dick": "richard",
    "don": "donald", "doug": "douglas", "eddie": "edward", "fran": "frances", "frank": "francis", "fred": "frederick", "gene": "eugene", "geoff": "geoffrey", "greg": "gregory", "hank": "henry", "harry": "henry", "jack": "john", "jeff": "jeffrey",
    "jenny": "jennifer", "jerry": "gerald", "joe": "joseph", "ken": "kenneth", "larry": "lawrence", "len": "leonard", "mick": "michael", "molly": "mary", "ned": "edward", "pat": "patricia", "pete": "peter", "phil": "philip", "ray": "raymond",
    "ron": "ronald", "sally": "sarah", "sandy": "alexander", "stan": "stanley", "ted": "theodore", "terry": "terence", "tim": "timothy", "val": "valerie", "walt": "walter", "wes": "wesley",
}
LONG_GIVEN: dict[str, set[str]] = {}
for _short, _long in SHORT_GIVEN.items():
    LONG_GIVEN.setdefault(_long, set()).add(_short)

# Words of organisations' names in other languages and short forms.
ORG_WORDS = {
    "univ": "university", "uni": "university", "u": "university", "universitat": "university", "universite": "university", "universidad": "university", "universita": "university", "universidade": "university", "universiteit": "university",
    "hosp": "hospital", "hopital": "hospital", "krankenhaus": "hospital", "inst": "institute", "institut": "institute", "instituto": "institute", "tech": "technology", "technol": "technology", "technologie": "technology", "natl": "national", "nat": "national",
    "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "res": "research", "st": "state", "dept": "department", "sch": "school", "fac": "faculty", "ctr": "center", "centre": "center", "acad": "academy", "coll": "college", "sci": "science",
    "universitatsklinikum": "university hospital", "klinikum": "hospital", "uh": "university hospital", "it": "institute technology",
}
ORG_DROP = frozenset("the of for and at in der die das fur de la le du des di gmbh ltd llc inc corp co ag kg bv plc sa srl limited company formerly campus main".split())
UNIT = re.compile(r"^\s*(?:department|dept\.?|school|faculty|clinic|division|section|chair|laboratory|lab|institute|centre|center|college|group|unit)\s+(?:of|for)\s+[^,]*,\s*(?=\S)", re.I)
#: Words that many organisations' names are made of; all others tell places and proper names.
ORG_GENERIC = frozenset("university state institute technology hospital national laboratory marine research analytics academy college center science school department medical general federal royal".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’`-][^\W\d_]+)*\.?")


class Person(NamedTuple):
    """What a spelling says: family (folded, with particles), given words, initials in order, short given names."""

    family: str
    given: tuple[str, ...]
    nicks: tuple[str, ...]


def _initials(word: str) -> list[str]:
    return [p for p in re.split(r"[.\-\s]+", word) if p]


def person(name: str, is_given: Callable[[str], bool]) -> Person | None:
    """A name taken apart. is_given: whether a word occurs as a given name more often than as a family name."""
    nicks = tuple(fold(n).strip() for n in re.findall(r"[(\"“]\s*([^()\"“”]+?)\s*[)\"”]", name))
    plain = re.sub(r"[(\"“][^()\"“”]*[)\"”]", " ", name)
    plain = re.sub(r"(?<=[^\W\d_])\.(?=[^\W\d_])", ". ", plain)
    parts = [p.strip() for p in plain.split(",")]
    parts = [p for p in parts if p and fold(p).strip(". ") not in SUFFIX]
    if not parts:
        return None
    if len(parts) >= 2:
        family, given = parts[0].split(), " ".join(parts[1:]).split()
    else:
        words = [w for w in parts[0].split() if fold(w).strip(".") not in ADDRESS]
        while len(words) > 1 and fold(words[-1]).strip(".") in SUFFIX:
            words.pop()
        if not words:
            return None
        low = [fold(w).strip(".") for w in words]
        short = [len(re.sub(r"[^\w]", "", w)) <= 1 or bool(re.fullmatch(r"(?:\w\.-?)+\w?\.?", w)) or (len(w) == 2 and w.isupper() and "." not in w and len(words) == 2) for w in words]
        start = next((i for i, w in enumerate(low) if w in PARTICLES and i + 1 < len(words)), None)
        if len(words) == 1:
            family, given = words, []
        elif start is not None and start > 0:
            family, given = words[start:], words[:start]
        elif start == 0:
            at = next(i for i, w in enumerate(low) if w not in PARTICLES)
            family, given = words[: at + 1], words[at + 1 :]
        elif any(short) and not short[0] and short[-1]:
            at = next(i for i, s in enumerate(short) if s)
            family, given = words[:at], words[at:]
        elif words[0].isupper() and not short[0] and len(words[0]) > 3 and not words[-1].isupper():
            family, given = words[:1], words[1:]
        elif not short[0] and not is_given(low[0]) and is_given(low[-1]):
            family, given = words[:1], words[1:]
        else:
            family, given = words[-1:], words[:-1]
    fam = re.sub(r"[\s'’`.]+", "", fold(" ".join(family)))
    giv = tuple(g for g in (fold(w).strip(".'’") for w in given) if g and g not in ADDRESS and g not in SUFFIX)
    giv = tuple(x for g in giv for x in ([".".join(_initials(g))] if re.fullmatch(r"(?:\w[.\-]*)+", g) and all(len(i) == 1 for i in _initials(g)) else [g]))
    return Person(fam, giv, nicks) if fam else None


def organisation(name: str) -> frozenset[str]:
    """The telling words of an organisation's name, units and legal forms left out."""
    plain = re.sub(r"\([^)]*\)", " ", name)
    unit = UNIT.match(plain)
    if unit and len(_WORD.findall(plain[unit.end() :])) >= 2:
        plain = plain[unit.end() :]
    text = re.sub(r"(?<=\b\w)\.(?=\w\b)", "", fold(plain).replace("'", ""))
    words = [w for w in re.findall(r"[^\W\d_]+", text)]
    out: list[str] = []
    for w in words:
        for x in ORG_WORDS.get(w, w).split():
            if x not in ORG_DROP:
                out.append(x)
    if "state" in out and "university" not in out and len(out) == 2:
        out.append("university")
    return frozenset(out)


def _near(a: str, b: str) -> bool:
    if a == b:
        return True
    if len(a) == len(b) >= 3 and a[0] == b[0] and sorted(a) == sorted(b):
        return True
    most = 2 if min(len(a), len(b)) >= 8 else 1
    return min(len(a), len(b)) >= 4 and distance(a, b, most) <= most


def _shortened(w: str, most: int) -> set[str]:
    """The word with up to `most` letters left out."""
    out = {w}
    for _ in range(most):
        out |= {x[:i] + x[i + 1 :] for x in out for i in range(len(x))}
    return out


def near_words(words: Iterable[str]) -> dict[str, set[str]]:
    """For each word the others that may be the same one typed with slips.

    Words are brought together by what is left of them without one or two
    letters, so that nothing is compared that can't be near.
    """
    by: dict[str, list[str]] = {}
    near: dict[str, set[str]] = {}
    for w in sorted(set(words)):
        if len(w) > 40:  # of a long word pieces are taken: with at most two slips one of beginning, middle and end stays whole
            mid = len(w) // 2 - 5
            for v in (w[:10], w[-10:], *(w[i : i + 10] for i in range(mid - 3, mid + 4))):
                by.setdefault(f"{v}/", []).append(w)
            continue
        for v in _shortened(w, 2 if len(w) >= 8 else 1):
            by.setdefault(v, []).append(w)
    for group in by.values():
        for i, w in enumerate(group):
            for x in group[i + 1 :]:
                if x != w and x not in near.get(w, ()) and _near(w, x):
                    near.setdefault(w, set()).add(x)
                    near.setdefault(x, set()).add(w)
    return near


class Profile(NamedTuple):
    """A merged entity so far. families; firsts: full first given names; initials: first initials of short forms; middles; nicks."""

    root: int
    families: frozenset[str]
    firsts: frozenset[str]
    initials: frozenset[str]
    middles: frozenset[str]
    nicks: frozenset[str]
    seen: int


def person_profile(root: int, spellings: list[tuple[Person, int]]) -> Profile:
    families, firsts, initials, middles, nicks, n = set(), set(), set(), set(), set(), 0
    for p, count in spellings:
        n += count
        families.add(p.family)
        nicks.update(p.nicks)
        if p.given:
            first = p.given[0]
            single = all(len(i) == 1 for i in _initials(first))
            more = [m for m in p.given[1:] if len(m) > 1 and "." not in m]
            if single:
                initials.add(first)
                middles.update(m[0] for m in p.given[1:])
            elif len(p.given) == 2 and more and "-" not in first:  # two names in full, with or without a hyphen
                firsts.add(f"{first}-{more[0]}")
            else:
                firsts.add(first)
                middles.update(m[0] for m in p.given[1:])
    return Profile(root, frozenset(families), frozenset(firsts), frozenset(initials), frozenset(middles), frozenset(nicks), n)


def _same_given(a: str, b: str) -> bool:
    if a == b or SHORT_GIVEN.get(a) == b or SHORT_GIVEN.get(b) == a:
        return True
    x, y = a.split("-"), b.split("-")
    if len(x) != len(y):  # a short form stands for the whole: Zack for Zacharias-Karl
        return SHORT_GIVEN.get(a) == y[0] or SHORT_GIVEN.get(b) == x[0]
    return all(_near(p, q) for p, q in zip(x, y))


def _fits(initial: str, first: str) -> bool:
    """Whether initials such as "j" or "j.p" can stand for a first name."""
    letters, parts = _initials(initial), first.split("-")
    return letters[0] == parts[0][0] and (len(letters) == 1 or len(parts) == 1 or letters[1] == parts[1][0])


def full_match(a: Profile, b: Profile) -> bool:
    """Whether two profiles with full given names are one person."""
    if not a.firsts or not b.firsts or (a.middles and b.middles and not a.middles & b.middles):
        return False
    if not any(_near(x, y) for x in a.families for y in b.families):
        return False
    if any(_same_given(x, y) for x in a.firsts for y in b.firsts):
        return True
    same_family = bool(a.families & b.families)
    return same_family and (bool(a.nicks & b.firsts) or bool(b.nicks & a.firsts))


def short_match(short: Profile, full: Profile) -> int:
    """How well initials fit a full profile: more for the given name than for a nickname, for agreeing
    middle initials, and for the same family name rather than one typed with slips; 0 if not at all."""
    by_name = any(_fits(i, f) for i in short.initials for f in full.firsts)
    if not by_name and not any(_fits(i, f) for i in short.initials for f in full.nicks):
        return 0
    rest = {x for i in short.initials for x in _initials(i)[1:]}
    hyphens = {p[0] for f in full.firsts for p in f.split("-")[1:]}
    middles = short.middles | (rest if not hyphens else frozenset())
    agree = bool(middles & (full.middles | hyphens))
    if middles and full.middles and not agree:
        return 0
    if short.families & full.families:
        return 4 * by_name + 2 + agree
    return int(by_name and any(_near(x, y) for x in short.families for y in full.families))


def _heads(p: Profile) -> set[str]:
    """First parts of the full given names."""
    return {f.split("-")[0] for f in p.firsts}


def _beside(word: str) -> set[str]:
    """The given names that a word stands for, or that stand for it."""
    return {word, *LONG_GIVEN.get(word, ()), *([SHORT_GIVEN[word]] if word in SHORT_GIVEN else [])}


class _Families:
    """The full profiles of a block by family name and by what begins their given names, so that only likely ones are met."""

    def __init__(self, block: list[Profile]):
        self.near = near_words(f for p in block for f in p.families)
        self.given = near_words(h for p in block for h in _heads(p))
        self.by_given: dict[tuple[str, str], list[Profile]] = {}
        self.by_initial: dict[tuple[str, str], list[Profile]] = {}
        self.by_nick: dict[tuple[str, str], list[Profile]] = {}
        for p in block:
            for f in p.families if p.firsts else ():
                for h in _heads(p):
                    self.by_given.setdefault((f, h), []).append(p)
                for c in {x[0] for x in (*p.firsts, *p.nicks) if x}:
                    self.by_initial.setdefault((f, c), []).append(p)
                for n in p.nicks:
                    self.by_nick.setdefault((f, n), []).append(p)

    def _names(self, p: Profile) -> set[str]:
        return {n for f in p.families for n in (f, *self.near.get(f, ()))}

    def like(self, p: Profile) -> list[Profile]:
        """Those that full_match() may accept."""
        heads = {x for h in _heads(p) for g in (h, *self.given.get(h, ())) for x in _beside(g)} | {x for h in _heads(p) for x in _beside(h)}
        met = [q for f in self._names(p) for h in heads for q in self.by_given.get((f, h), ())]
        for f in p.families:
            for n in p.nicks:
                met += self.by_given.get((f, n.split("-")[0]), ())
            for x in p.firsts:
                met += self.by_nick.get((f, x), ())
        return list({q.root: q for q in met}.values())

    def fitting(self, p: Profile) -> list[Profile]:
        """Those that short_match() may accept for initials."""
        return list({q.root: q for f in self._names(p) for c in {i[0] for i in p.initials} for q in self.by_initial.get((f, c), ())}.values())


def merge_persons(block: list[Profile]) -> Iterator[tuple[int, int]]:
    """Pairs of roots in a block to be merged."""
    full = sorted((p for p in block if p.firsts), key=lambda p: (-p.seen, p.root))
    short = [p for p in block if not p.firsts and p.initials]
    known = _Families(block)
    for p in full:
        for q in known.like(p):
            if q.root > p.root and full_match(p, q):
                yield p.root, q.root
    fitting = {p.root: [(short_match(p, q), q) for q in known.fitting(p)] for p in short}
    for p in short:
        best = max((m for m, _ in fitting[p.root]), default=0)
        those = [q for m, q in fitting[p.root] if m == best] if best else []
        # Of several fitting entities none is meant for sure, unless they are spellings about to be merged.
        if those and all(len(those) == 1 or q is those[0] or full_match(those[0], q) for q in those):
            yield p.root, those[0].root
    # The same initials of one family without any full name to tell them apart.
    plain: dict[tuple[str, str], list[Profile]] = {}
    for p in short:
        if not any(m > 1 for m, _ in fitting[p.root]):
            for f in p.families:
                for i in p.initials:
                    plain.setdefault((f, _initials(i)[0]), []).append(p)
    for group in plain.values():
        # Those that share a middle initial are one; those without any join them where there is one such set.
        classes: list[tuple[set[str], Profile]] = []
        bare: Profile | None = None
        for p in sorted(group, key=lambda p: p.root):
            if not p.middles:
                if bare is not None:
                    yield bare.root, p.root
                bare = p
                continue
            meet = [c for c in classes if c[0] & p.middles]
            for _, q in meet:
                yield q.root, p.root
            classes = [c for c in classes if c not in meet] + [(set(p.middles).union(*(c[0] for c in meet)), p)]
        if bare is not None and len(classes) == 1:
            yield classes[0][1].root, bare.root


def merge_organisations(block: list[tuple[int, list[frozenset[str]]]]) -> Iterator[tuple[int, int]]:
    """Pairs of roots in a block to be merged. A root's word sets are those of its spellings."""

    def alike(a: frozenset[str], b: frozenset[str]) -> bool:
        left, right = set(a - b), set(b - a)
        for w in sorted(left):
            x = next((x for x in sorted(right) if _near(w, x) or (len(w) > 2 and x.startswith(w)) or (len(x) > 2 and w.startswith(x))), None)
            if x:
                left.discard(w)
                right.discard(x)
        if not left and not right:
            return bool(a & b) or any(w not in ORG_GENERIC for w in a)
        for one, other in ((left, right), (right, left)):  # an acronym of the rest
            if len(one) == 1 and len(other) > 1 and sorted(next(iter(one))) == sorted(w[0] for w in other):
                return bool(a & b)
        return False

    # Roots with the same words are merged in a chain; of them the first goes on. Others are compared only where a telling word is shared or near.
    first: dict[frozenset[str], int] = {}
    for root, sets in sorted(block):
        for words in sets:
            if words in first and first[words] != root:
                yield first[words], root
            first.setdefault(words, root)

    def telling(words: frozenset[str]) -> frozenset[str]:
        return frozenset(w for w in words if w not in ORG_GENERIC and len(w) > 3) or words

    near = near_words(w for words in first for w in telling(words))
    holding: dict[str, list[frozenset[str]]] = {}
    for words in first:
        for w in telling(words):
            holding.setdefault(w, []).append(words)
    for a, root in first.items():
        met = {b for w in telling(a) for x in (w, *near.get(w, ())) for b in holding.get(x, ())}
        for b in met:
            if first[b] > root and alike(a, b):
                yield root, first[b]


def _block_keys(kind: str, words: set[str], tail: int, givens: Iterable[str] = ("",)) -> set[int]:
    """The blocks of a profile: pieces of its telling words that a slip leaves alone, each with each of `givens`, which split a hot block."""
    out = set()
    for w in words:
        w = re.sub(r"[^\w]", "", w)
        pieces = [w[:4], "." + w[-tail:], "/" + "".join(sorted(set(w)))]
        if len(w) < tail + 4:  # a slip may be in both the beginning and the end
            pieces += [f"{w[:2]}~{w[-2:]}", "_" + w[-3:], "^" + w[:3]]
        for k in pieces:
            for g in givens:
                out.add(xxhash.xxh3_64_intdigest(f"{kind} {k}{g}") - (1 << 63))
    return out


def _given_keys(forms: list[dict]) -> set[str]:
    """What splits the block of a family: the initials that a person's given names and nicknames have, and the last letters of full ones, which a slip in the first letter leaves alone."""
    out = set()
    for f in forms:
        first = f["given"][0] if f["given"] else ""
        for w in (first.split("-")[0], *f["nicks"]):
            for x in _beside(w) if w else ():
                out.add(f" {x[0]}")
        if len(first) > 1 and "." not in first:
            out.add(f" ..{first.split('-')[0][-2:]}")
    return out or {" "}


def _grouped(rows: DataFrame, work: Callable[[int, list[dict]], Iterator[tuple[int, int]]], columns: list[str]) -> DataFrame:
    """a, b: what `work` yields for each block. rows: block, root and columns; sorted by block, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        left: list[int] = []
        right: list[int] = []

        def close() -> None:
            if len(held) > 1:
                for a, b in work(at, held):
                    left.append(a)
                    right.append(b)

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != at:
                    close()
                    at, held = row["block"], []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
            left, right = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "block").sortWithinPartitions("block", "root").select("block", "root", *columns).mapInArrow(run, "a long, b long").distinct()


def _rounds(spellings: DataFrame, blocks: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """spellings (id, ...) with `root`, the smallest id of the merged profile; repeated until nothing merges.

    After the first round only merged profiles enter the blocks again, and only
    blocks that one of them is in are looked at. Every round leaves fewer
    profiles, so it ends.
    """
    state = cut(spellings.withColumn("root", F.col("id")))
    placed = cut(blocks(state))
    touched = placed
    while True:
        links = cut(merge(touched))
        if links.isEmpty():
            return state
        roots = cut(components(links).select(F.col("node").alias("root"), F.col("root").alias("new")))
        state = cut(state.join(roots, "root", "left").withColumn("root", F.coalesce("new", "root")).drop("new"))
        changed = roots.select(F.col("new").alias("root")).distinct()
        fresh = cut(blocks(state.join(changed, "root", "left_semi")))
        placed = cut(placed.join(roots.select("root"), "root", "left_anti").unionByName(fresh))
        touched = placed.join(fresh.select("block").distinct(), "block", "left_semi")


def link_persons(names: DataFrame, column: str) -> DataFrame:
    """name and entity of every distinct name in a column of names.

    Null, empty and blank names, and names without a letter, are left out.
    entity is a number shared by the spellings of one person.
    """
    distinct = names.where(F.col(column).rlike(r"\p{L}")).groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))
    distinct = cut(distinct.withColumn("id", F.xxhash64("name")))

    # How often a word is a given name or a family name, in spellings whose form tells it.
    comma = distinct.where(F.col("name").contains(",")).select(F.split("name", ",").alias("p"))
    given = comma.select(F.explode(F.split(F.lower(F.trim(F.regexp_replace(F.element_at("p", 2), r"[\"(].*", ""))), r"\s+")).alias("w"), F.lit(1).alias("g"))
    family = comma.select(F.lower(F.trim(F.element_at("p", 1))).alias("w"), F.lit(-1).alias("g"))
    roles = given.unionByName(family).where(F.length("w") > 2).groupBy("w").agg(F.sum("g").alias("g"))
    # Given names are a bounded vocabulary; words are told by a join, never brought to one place.
    words = distinct.where(~F.col("name").contains(",")).select("id", F.explode(F.split(F.lower(F.trim("name")), r"\s+")).alias("w"))
    given_words = words.join(roles.where("g > 0"), "w").groupBy("id").agg(F.collect_set("w").alias("given"))
    told = distinct.join(given_words, "id", "left")

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, families, givens, nicks = [], [], [], []
            for i, name, known in zip(*(c.to_pylist() for c in batch.columns)):
                known = {fold(k) for k in known or ()}
                p = person(name, known.__contains__)
                if p:
                    ids.append(i)
                    families.append(p.family)
                    givens.append(list(p.given))
                    nicks.append(list(p.nicks))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(families, pa.string()), pa.array(givens, pa.list_(pa.string())), pa.array(nicks, pa.list_(pa.string()))], names=["id", "family", "given", "nicks"])

    apart = told.select("id", "name", "given").mapInArrow(take_apart, "id long, family string, given array<string>, nicks array<string>")
    people = apart.join(distinct.select("id", "name", "n"), "id")

    def profiles(state: DataFrame) -> DataFrame:
        """One row for each block a profile is in, with the distinct forms of its spellings."""
        forms = state.groupBy("root", "family", "given", "nicks").agg(F.sum("n").alias("n"))
        grouped = forms.groupBy("root").agg(F.collect_list(F.struct("family", "given", "nicks", "n")).alias("forms"))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at = [], []
                for i, forms in enumerate(batch.column(1).to_pylist()):
                    for k in sorted(_block_keys("family", {f["family"] for f in forms}, 6, _given_keys(forms))):
                        keys.append(k)
                        at.append(i)
                part = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *part.columns], names=["block", "root", "forms"])

        kind = "array<struct<family:string,given:array<string>,nicks:array<string>,n:long>>"
        return grouped.mapInArrow(spread, f"block long, root long, forms {kind}")

    def merge(rows: DataFrame) -> DataFrame:
        def work(_: int, held: list[dict]) -> Iterator[tuple[int, int]]:
            block = [person_profile(r["root"], [(Person(f["family"], tuple(f["given"]), tuple(f["nicks"])), f["n"]) for f in r["forms"]]) for r in held]
            return merge_persons(block)

        return _grouped(rows, work, ["forms"])

    return _rounds(people, profiles, merge).select("name", F.col("root").alias("entity"))


def link_organisations(names: DataFrame, column: str) -> DataFrame:
    """name and entity of every distinct organisation in a column of names; nulls and blanks are left out."""
    distinct = names.where(F.col(column).rlike(r"\p{L}")).select(F.col(column).alias("name")).distinct()
    distinct = cut(distinct.withColumn("id", F.xxhash64("name")))

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, names = (c.to_pylist() for c in batch.columns)
            words = [sorted(organisation(n)) for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(words, pa.list_(pa.string()))], names=["id", "name", "words"])

    orgs = distinct.select("id", "name").mapInArrow(take_apart, "id long, name string, words array<string>")

    def profiles(state: DataFrame) -> DataFrame:
        forms = state.select("root", "words").distinct()
        grouped = forms.groupBy("root").agg(F.collect_list("words").alias("forms"))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, at = [], []
                for i, forms in enumerate(batch.column(1).to_pylist()):
                    words = {w for f in forms for w in f}
                    for k in sorted(_block_keys("org", {w for w in words if w not in ORG_GENERIC and len(w) > 4} or words, 5)):
                        keys.append(k)
                        at.append(i)
                part = batch.take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *part.columns], names=["block", "root", "forms"])

        return grouped.mapInArrow(spread, "block long, root long, forms array<array<string>>")

    def merge(rows: DataFrame) -> DataFrame:
        def work(_: int, held: list[dict]) -> Iterator[tuple[int, int]]:
            return merge_organisations([(r["root"], [frozenset(f) for f in r["forms"]]) for r in held])

        return _grouped(rows, work, ["forms"])

    return _rounds(orgs, profiles, merge).select("name", F.col("root").alias("entity"))


def spelling_pairs(entities: DataFrame) -> DataFrame:
    """name_a, name_b: all pairs of different spellings of an entity, name_a first in binary order."""
    other = entities.select(F.col("name").alias("name_b"), "entity")
    return entities.select(F.col("name").alias("name_a"), "entity").join(other, "entity").where("name_a < name_b").select("name_a", "name_b")

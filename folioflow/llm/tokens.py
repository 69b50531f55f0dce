"""Encoding a whole corpus with a public byte-level BPE vocabulary.

The merges are compiled into a deterministic automaton over tokens by adding one
merge gadget after another. Rule number r, (u, v) -> w, does three things to the
automaton made by the rules before it:

* the state behind u loses its arc v: u and v side by side would have merged;
* w's state is a copy of v's state as it was before that;
* every state that has an arc u after that gets an arc w.

A state is reached by one token only, so states are tokens. The copies make two
trees: w hangs under v in the tree of states and under u in the tree of arcs.
When both trees are numbered in preorder, younger children first, all states
that are copies of u's made after rule r have consecutive numbers, and so have
all arcs that are copies of v's made after it. A lost arc is thus lost for a
rectangle of numbers, and the whole transition table is one row of blocked
ranges for each state, rows that are equal being kept once. The table is
compiled on the driver, once, and sent to the workers with a second table that
gives the longest token that ends at each byte.

Of all ways to cut a word into tokens the automaton accepts exactly one, the one
that the merges make. It is found from left to right: every prefix of a word has
one accepted cut, whose last token is the state; of the tokens that end at a
byte it is the one that the state at its beginning has an arc for. Decoding
emits the arcs' labels.
"""

from __future__ import annotations

import base64
import json
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern of the vocabulary's authors that cuts a text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The folder of the vocabulary files and the file's name are parameters of every operator here; only the driver reads them.
TOKENIZER_DIR = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.tiktoken"
#: Words whose cuts a worker keeps; beyond that many it starts anew.
CACHE_WORDS = 200_000


def merged(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """The definition of the encoding by rules under `below`: merge the pair of lowest rank, the leftmost first, until none is left."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = min(((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(below, 0))
        if found[0] >= below:
            break
        i = found[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def rules(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """The merge rules (u, v, w) in order: what each token of two bytes or more is merged from."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        n = len(token)
        if n < 2:
            continue
        cuts = [(u, v) for i in range(1, n) if (u := ranks.get(token[:i])) is not None and (v := ranks.get(token[i:])) is not None and (i == 1 or u < rank) and (i == n - 1 or v < rank)]
        if len(cuts) != 1:  # several pairs of tokens would do, the rules before tell which one is there
            parts = merged(token, ranks, rank)
            if len(parts) != 2:
                raise ValueError(f"no single merge makes {token!r}")
            cuts = [(ranks[parts[0]], ranks[parts[1]])]
        out.append((*cuts[0], rank))
    return out


def _preorder(children: dict[int, list[int]], roots: Iterable[int]) -> tuple[dict[int, int], dict[int, int]]:
    """First and last-but-one number of every node's subtree; of siblings the younger one comes first."""
    first: dict[int, int] = {}
    past: dict[int, int] = {}
    stack = [(r, False) for r in sorted(roots)]
    while stack:
        node, left = stack.pop()
        if left:
            past[node] = len(first)
            continue
        first[node] = len(first)
        stack.append((node, True))
        stack += [(c, False) for c in children.get(node, ())]  # oldest first, so that the youngest is taken first
    return first, past


class MergeAutomaton:
    """The compiled token automaton of a vocabulary of ranked byte strings.

    ranks: the bytes of each token and its id; among tokens of two bytes or
    more a smaller id merges earlier. Ids need not be consecutive.
    """

    def __init__(self, ranks: dict[bytes, int]):
        made = rules(ranks)
        self.labels: dict[int, bytes] = {i: b for b, i in ranks.items()}
        single = [i for b, i in ranks.items() if len(b) == 1]
        states: dict[int, list[int]] = {}
        arcs: dict[int, list[int]] = {}
        for u, v, w in made:  # the gadgets' copies: w's state of v's, the arcs w of the arcs u
            states.setdefault(v, []).append(w)
            arcs.setdefault(u, []).append(w)
        state_at, state_past = _preorder(states, single)
        self.number, arc_past = _preorder(arcs, single)

        def copies(node: int, rule: int, children: dict[int, list[int]], at: dict[int, int], past: dict[int, int], own: bool) -> tuple[int, int]:
            """The numbers of the node and of its copies made after the rule; `own`: or by the rule itself."""
            older = next((c for c in reversed(children.get(node, ())) if c < rule or (c == rule and not own)), None)
            return at[node], past[node] if older is None else at[older]

        # The gadgets' cuts: rule w blocks a range of arcs in a range of states. The copy of v's state made by
        # the rule is older than its cut (own), the arcs w that it makes are younger.
        opened: dict[int, list[tuple[int, int]]] = {}
        closed: dict[int, list[tuple[int, int]]] = {}
        for u, v, w in made:
            lo, hi = copies(u, w, states, state_at, state_past, own=False)
            blocked = copies(v, w, arcs, self.number, arc_past, own=True)
            opened.setdefault(lo, []).append(blocked)
            closed.setdefault(hi, []).append(blocked)
        self._lay_out(state_at, opened, closed)
        self._suffixes(ranks)

    def _lay_out(self, state_at: dict[int, int], opened: dict, closed: dict) -> None:
        """The rows of the transition table: sorted bounds of the blocked ranges, equal rows once."""
        self.bounds, self.row = array("i"), {}
        kept: dict[tuple[int, ...], tuple[int, int]] = {}
        active: dict[tuple[int, int], int] = {}
        where = (0, 0)
        for state, at in sorted(state_at.items(), key=lambda x: x[1]):
            if at in opened or at in closed:
                for r in closed.get(at, ()):
                    active[r] -= 1
                    if not active[r]:
                        del active[r]
                for r in opened.get(at, ()):
                    active[r] = active.get(r, 0) + 1
                flat: list[int] = []
                for lo, hi in sorted(active):
                    if flat and lo <= flat[-1]:
                        flat[-1] = max(flat[-1], hi)
                    else:
                        flat += (lo, hi)
                row = tuple(flat)
                if row not in kept:
                    kept[row] = (len(self.bounds), len(self.bounds) + len(row))
                    self.bounds.extend(row)
                where = kept[row]
            self.row[state] = where

    def _suffixes(self, ranks: dict[bytes, int]) -> None:
        """An automaton over bytes whose state tells the longest token that ends here, and for each token the next shorter one."""
        go: dict[int, int] = {}
        byte, parent, token = [0], [0], [-1]
        for b, i in ranks.items():
            node = 0
            for c in b:
                at = node << 8 | c
                if at not in go:
                    go[at] = len(byte)
                    byte.append(c)
                    parent.append(node)
                    token.append(-1)
                node = go[at]
            token[node] = i
        children: list[list[int]] = [[] for _ in byte]
        for node in range(1, len(byte)):
            children[parent[node]].append(node)
        fail, longest = [0] * len(byte), list(token)
        queue = deque(children[0])
        self.shorter: dict[int, int] = {}
        while queue:
            node = queue.popleft()
            if parent[node]:
                f = fail[parent[node]]
                while f and (f << 8 | byte[node]) not in go:
                    f = fail[f]
                fail[node] = go.get(f << 8 | byte[node], 0)
            if token[node] >= 0:
                self.shorter[token[node]] = longest[fail[node]]
            else:
                longest[node] = longest[fail[node]]
            queue.extend(children[node])
        self.go, self.fail, self.longest = go, array("i", fail), array("i", longest)
        self.sizes = {i: len(b) for b, i in ranks.items()}

    def arc(self, s: int, t: int) -> bool:
        """Whether state s has an arc t: a look into s's row."""
        lo, hi = self.row[s]
        return not (bisect_right(self.bounds, self.number[t], lo, hi) - lo) & 1

    def encode_bytes(self, word: bytes) -> list[int]:
        """The accepted cut of one word."""
        go, fail, longest, shorter, sizes = self.go, self.fail, self.longest, self.shorter, self.sizes
        row, bounds, number = self.row, self.bounds, self.number
        node, state = 0, [-1]
        for end, c in enumerate(word, 1):
            to = go.get(node << 8 | c)
            while to is None:
                if not node:
                    raise ValueError(f"no token has the byte {c}")
                node = fail[node]
                to = go.get(node << 8 | c)
            node = to
            t = longest[node]
            while True:
                before = state[end - sizes[t]]
                if before < 0:
                    break
                lo, hi = row[before]
                if not (bisect_right(bounds, number[t], lo, hi) - lo) & 1:
                    break
                t = shorter[t]
            state.append(t)
        out, end = [], len(word)
        while end:
            t = state[end]
            out.append(t)
            end -= sizes[t]
        return out[::-1]

    def decode(self, ids) -> str:
        """The text whose tokens these are."""
        return b"".join(self.labels[i] for i in ids).decode("utf-8", errors="replace")


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: base64 of a token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """Texts to ids: words by the pattern, their cuts by the automaton."""

    def __init__(self, automaton: MergeAutomaton, pattern: str = PATTERN):
        import regex

        self.automaton = automaton
        self.words = regex.compile(pattern).findall
        self.cache: dict[str, list[int]] = {}

    def _cut(self, word: str) -> list[int]:
        if len(self.cache) >= CACHE_WORDS:
            self.cache.clear()
        cut = self.automaton.encode_bytes(word.encode("utf-8", errors="replace"))
        if len(word) <= 64:  # a longer run is cut anew each time, the cache stays small
            self.cache[word] = cut
        return cut

    def encode(self, text: str | None) -> list[int]:
        """Null and the empty text both give the empty list."""
        out: list[int] = []
        if not text:
            return out
        get, extend, cut = self.cache.get, out.extend, self._cut
        for word in self.words(text):
            extend(get(word) or cut(word))
        return out


@lru_cache(4)
def automaton(path: str) -> MergeAutomaton:
    """The automaton of a vocabulary file, compiled once a process: on the driver."""
    return MergeAutomaton(read_ranks(path))


def encoder(path: str, pattern: str = PATTERN) -> Encoder:
    return Encoder(automaton(path), pattern)


_SENT: dict[tuple[str, str], Broadcast] = {}
_HERE: dict[tuple[int, str], Encoder] = {}


def sent(path: str) -> Broadcast:
    """The compiled automaton, sent to the workers; its size is bounded by the vocabulary's."""
    sc = SparkSession.active().sparkContext
    key = (sc.applicationId, path)
    if key not in _SENT:
        _SENT[key] = sc.broadcast(automaton(path))
    return _SENT[key]


def _worker(table: Broadcast, pattern: str) -> Encoder:
    """This worker's encoder, made once of the table that was sent."""
    key = (id(table.value), pattern)
    if key not in _HERE:
        _HERE.clear()
        _HERE[key] = Encoder(table.value, pattern)
    return _HERE[key]


def vocabulary_path(tokenizer_dir: str = TOKENIZER_DIR, tokenizer: str = TOKENIZER) -> str:
    return str(Path(tokenizer_dir) / tokenizer)


def token_ids(text: Column, path: str, pattern: str = PATTERN) -> Column:
    """The ids of a text. No special tokens: strings that spell one are plain text.

    Null and the empty text both give the empty list; a text of blanks has the
    ids of its blanks. Texts of any length are encoded whole.
    """
    table = sent(path)

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _worker(table, pattern)
        for texts in batches:
            yield pd.Series([e.encode(t) for t in texts], dtype=object)

    return encode(text)


def token_count(text: Column, path: str, pattern: str = PATTERN) -> Column:
    """The number of ids of a text, 0 for null and the empty text; the ids stay in the worker."""
    table = sent(path)

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = _worker(table, pattern)
        for texts in batches:
            yield pd.Series([len(e.encode(t)) for t in texts], dtype="int64")

    return count(text)


def encode_corpus(df: DataFrame, text: str, ids: str = "ids", path: str | None = None, batch_rows: int = 512) -> DataFrame:
    """df with the token ids of df[text] in a further column.

    Null and the empty text both get the empty list. All rows and other columns
    stay; a column named `ids` is replaced. The work is one pass without a shuffle; a worker holds the
    transition table, the cuts of at most CACHE_WORDS words and one batch.
    """
    table = sent(path or vocabulary_path())
    kept = [c for c in df.columns if c != ids]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _worker(table, PATTERN)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                lists = pa.array([e.encode(t) for t in part.column(part.num_columns - 1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(kept))] + [lists], names=[*kept, ids])

    fields = [df.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias("__text")).mapInArrow(encode, schema)


def decode_ids(ids: Column, path: str) -> Column:
    """The text of a list of ids, the labels of its arcs; null for null."""
    table = sent(path)

    @F.pandas_udf(T.StringType())
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a = table.value
        for lists in batches:
            yield pd.Series([None if x is None else a.decode(x) for x in lists], dtype=object)

    return decode(ids)


def vocabulary_of_json(path: str) -> dict[bytes, int]:
    """The ranks in a tokenizer's JSON file, for vocabularies that come without a rank file."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    return {bytes(shown[c] for c in t): i for t, i in model.items() if all(c in shown for c in t) and t != "<|endoftext|>"}

"""Cutting texts over a size limit into overlapping pieces, by their content.

A rolling hash over the characters marks landmarks. From the start of a piece on,
the first landmark between the least and the most size is taken, and the cut
snaps to the natural boundary nearest to it; a paragraph's end counts as nearer
than a sentence's, and that as nearer than a space. As landmarks depend on the
characters around them only, an edit changes the pieces near it, and once a cut
falls on the same place as before all later ones do, but the last two. Where there is no natural
boundary between the sizes the landmark itself is the cut; without one too the
last natural boundary before the least size, and without any the most size. The
last piece is kept from being under the least size by an earlier cut before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of the rolling hash's window.
WINDOW = 32
#: Least size of a piece's own part as a share of the most.
LEAST = 0.5
# Characters that end a sentence or clause.
STOPS = ".!?;。！？；"
_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)
_STOPS = np.array([ord(c) for c in STOPS], np.uint32)
_WIDE = np.array([ord(c) for c in "。！？；"], np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def codes(text: str) -> np.ndarray:
    """Code points of the text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(c: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At each position a hash of the `window` (a power of two) characters that end there, by doubling."""
    h = (c.astype(np.uint64) + np.uint64(1)) * _MIX
    h ^= h >> np.uint64(29)
    factor, width = int(_MIX) | 1, 1
    while width < window:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + older * np.uint64(factor)
        factor, width = factor * factor % (1 << 64), width * 2
    h ^= h >> np.uint64(32)
    return h * _MIX


def longest_run(c: np.ndarray) -> int:
    """Length of the longest run without white space and stops."""
    cut = np.flatnonzero(np.isin(c, _SPACES) | np.isin(c, _STOPS))
    return int(np.diff(np.r_[-1, cut, len(c)]).max()) - 1 if len(c) else 0


def cuts(text: str, most: int, overlap: int) -> list[tuple[int, int, bool]]:
    """begin, end and whether the end is natural, of each piece; pieces begin `overlap` before the last one's end."""
    c = codes(text)
    n = len(c)
    if n <= most:
        return [(0, n, True)] if n else []
    overlap = max(0, min(overlap, most - 1))
    space, stop = np.isin(c, _SPACES), np.isin(c, _STOPS)
    # Strength of a cut ahead of position i: 4 after a blank line, 3 after a sentence, 2 after white space, 1 after any stop.
    strength = np.zeros(n + 1, np.int64)
    strength[1:][stop] = 1
    strength[1:][space] = 2
    strength[1:][np.isin(c, _WIDE)] = 3
    strength[2:][stop[:-1] & space[1:]] = 3
    strength[2:][(c[:-1] == 10) & (c[1:] == 10)] = 4
    h = rolling(c)
    span = most - overlap
    mask = np.uint64((1 << max(1, int(span * (1 - LEAST) / 4).bit_length())) - 1)
    landmark = np.r_[False, (h & mask) == 0]
    out: list[tuple[int, int, bool]] = []
    start = 0  # where the piece's own part begins
    while True:
        begin = start - overlap if start else 0
        if n - begin <= most:
            out.append((begin, n, True))
            return out
        top = begin + most
        first = max(start, overlap) + 1  # a piece is longer than what it shares
        low = min(top, max(first, start + int((top - start) * LEAST)))
        least = int((most - overlap) * LEAST)
        if n - top < least:  # the rest would be a piece under the least size
            top = max(low, n - least)
        marks = np.flatnonzero(landmark[low : top + 1])
        aim = low + int(marks[0]) if len(marks) else top
        s = strength[low : top + 1]
        best = np.flatnonzero(s > 0)
        if len(best):
            away = np.abs(best + low - aim) - (s[best] - 1) * (top - low) / 6.0
            end, natural = low + int(best[np.argmin(away)]), True
        else:
            earlier = np.flatnonzero(strength[first:low] > 0)
            if len(earlier) and not len(marks):
                end, natural = first + int(earlier[-1]), True
            else:
                end, natural = aim, False
        out.append((begin, end, natural))
        start = end


def chunk(df: DataFrame, limits: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """id, piece_no (from 1), begin, end, natural, cut and piece, of each text longer than its source's limit.

    limits: source (unique), max_chars, overlap_chars; it is one row a source.
    A text whose source has no limit, a null text and one within the limit give
    no rows. begin and end count characters (code points); each piece has at most
    max_chars and begins overlap_chars before the end of the piece before it. An
    overlap of max_chars or more is lowered to max_chars - 1. cut is `forced` if
    the text has a run over max_chars without a natural boundary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("piece_no", pa.int32()), ("begin", pa.int64()), ("end", pa.int64()), ("natural", pa.bool_()), ("cut", pa.string()), ("piece", pa.string())])
        for batch in batches:
            for i, text, most, overlap in zip(*(c.to_pylist() for c in batch.columns)):
                kind = "forced" if longest_run(codes(text)) > most else "natural"
                rows = [(i, k, b, e, nat, kind, text[b:e]) for k, (b, e, nat) in enumerate(cuts(text, most, overlap), 1)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), schema.types)], schema=schema)

    bound = limits.select(F.col("source").alias("__source"), F.col("max_chars").alias("__most"), F.col("overlap_chars").alias("__overlap")).where("__most > 0")
    # Copies of a hot source stay where they are: the limits are a row a source, and sent to all tasks only when they are small.
    joined = df.join(bound, df[source_col] == F.col("__source")).where(F.length(df[text_col]) > F.col("__most"))
    chosen = joined.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"), "__most", F.coalesce("__overlap", F.lit(0)).alias("__overlap"))
    return chosen.mapInArrow(run, "id long, piece_no int, begin long, end long, natural boolean, cut string, piece string")

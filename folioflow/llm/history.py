"""Checking each new batch of works against all that were accepted before.

An index on shared storage keeps, for every accepted record, a few keys: bands
of a minwise signature over the words of its title, its whole title and its
address. Every key is stored with the record's signature words, in a folder
named by the key's hash; the number of folders grows with what is stored, so a
folder stays as large as it is. A batch's keys are dealt by the same hash, and
the task that gets a share of them opens the folders of that share only and takes
out the keys it has, so nothing that is stored is shuffled. What shares a key is
verified by the titles (which are in folders by the hash of the record's id),
and then the keys of the records that the batch brought in are appended.

What a batch appends is a segment of its own. Segments are merged in tiers, FAN
of one tier into one of the next, so their number and the times a key is written
again grow with the logarithm of history only. A batch counts when its list of
segments is put in place, in one step; what a broken run left behind is never
read, and a batch that is handed in again under its name gives what it gave.

Titles with the same words in any order are folded by grouped minima before
anything is compared, so a group of copies of any size leaves one record to be
compared. All records left that share a band are compared with each other. Keys
that very many rows have are split first, so that no task gets them whole.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from folioflow.lineage import cut, hadoop, remove, scratch, tidy
from folioflow.llm.components import components
from folioflow.llm.titles import Title, code, same_words, title

BANDS, ROWS = 20, 5
#: Titles of fewer words are headings that many works bear; only their addresses count.
LEAST_WORDS = 5
#: Share of signature words that a candidate has in common; the words decide afterwards.
LIKELY = 0.5
#: Records of one key from which on bit maps compare them; rows of a key from which on it is split.
LARGE, HOT = 64, 100_000
#: Links of a task that are written at once.
PORTION = 100_000
#: Keys of one folder, which has as many times fewer titles as they are wider; segments of a tier that are merged into one of the next.
BUCKET_ROWS, WIDER, FAN = 250_000, 4, 8
#: Low bits of a hash that choose a word of the bit map and name the folder; the map has 64 bits a word, 8 million in all.
WORD_BITS = 17
#: Kinds of keys; in the table of a batch's keys also links to what has the same address or whole title.
ADDRESS, EXACT, BAND, LINK = 0, 1, 2, 3

CANDIDATES = "later long, earlier long, later_old boolean, earlier_old boolean"

_rng = np.random.default_rng(20150105)
_A = _rng.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)

_DOI = re.compile(r"(10\.\d{4,9}(?:/|%2[fF])[^\s?#]*?\d)(?:v\d{1,2})?(?:\.full|\.pdf|/|\?|#|$|\s)", re.I)
_EPRINT = re.compile(r"(?:^|[/:])((?!(?:abs|pdf|html)/)[a-z\-]+(?:\.[a-z]{2})?/\d{7}|\d{4}\.\d{4,12})(?:v\d{1,2})?(?:\.pdf)?(?:[/?#\s]|$)", re.I)


def address(url: str | None) -> str | None:
    """The record a url leads to, without host, version, file form and query; None if it names none."""
    if not url or not any(c.isdigit() for c in url):
        return None
    u = url.strip()
    m = _DOI.search(u)
    if m:
        return m.group(1).lower().replace("%2f", "/")
    m = _EPRINT.search(u)
    if m:
        return m.group(1).lower()
    u = re.sub(r"^[a-z]+://(?:www\.)?", "", u.lower())
    u = re.split(r"[?#]", u)[0].rstrip("/")
    u = re.sub(r"v\d{1,2}(?=(?:\.full)?(?:\.pdf)?$)|(?:\.full)?\.pdf$", "", u)
    return u if "/" in u and re.search(r"\d", u.partition("/")[2]) else None


def band_keys(codes: np.ndarray, starts: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """The keys of each record, BANDS a row. codes: all records' words in a row; starts: where each begins."""
    x = codes.astype(np.uint64)
    lows = np.empty((BANDS * ROWS, len(starts)), np.uint64)
    for i in range(BANDS * ROWS):
        h = x * _A[i] + _B[i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        lows[i] = np.minimum.reduceat(h, starts)
    keys = np.empty((len(starts), BANDS), np.uint64)
    for b in range(BANDS):
        k = salt ^ np.uint64(b * 0x5851F42D4C957F2D + 1 & 0xFFFFFFFFFFFFFFFF)
        for r in range(ROWS):
            k = (k ^ lows[b * ROWS + r]) * np.uint64(0x9E3779B97F4A7C15)
            k ^= k >> np.uint64(29)
        keys[:, b] = k
    return keys


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _signature(codes: list[int]) -> bytes:
    """A byte of each word's code: enough to choose candidates by, not to tell equal words from alike ones."""
    return bytes(sorted({c & 0xFF for c in codes}))


def _whole(t: Title) -> int:
    """64 bits of all that same_words() looks at, in any order of the words: titles with the same are one work."""
    return _hash("|".join((t.derived, t.name, "cut" if t.cut else "", " ".join(sorted(t.words)))))


def profiles(df: DataFrame, id_col: str, title_col: str, url_col: str | None) -> DataFrame:
    """id, title, address and whole-title keys (null where there is none), band keys and signature words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            urls = batch.column(2).to_pylist()
            where = [address(u) for u in urls]
            titles = [title(t) for t in batch.column(1).to_pylist()]
            whole, bands, signatures = [None] * n, [None] * n, [None] * n
            told = [i for i, t in enumerate(titles) if len(t.words) >= LEAST_WORDS]
            if told:
                codes = [sorted({code(w) for w in titles[i].words}) for i in told]
                starts = np.cumsum([0] + [len(c) for c in codes[:-1]])
                salt = np.array([_hash("of " + titles[i].derived) for i in told], np.uint64)
                keys = band_keys(np.concatenate([np.array(c, np.uint64) for c in codes]), starts, salt).view(np.int64)
                for j, i in enumerate(told):
                    t = titles[i]
                    whole[i] = np.uint64(_whole(t)).view(np.int64)
                    bands[i] = keys[j]
                    signatures[i] = _signature(codes[j])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    batch.column(1),
                    pa.array([None if a is None else np.uint64(_hash("at " + a)).view(np.int64) for a in where], pa.int64()),
                    pa.array(whole, pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(signatures, pa.binary()),
                ],
                names=["id", "title", "at", "whole", "bands", "signature"],
            )

    none = F.lit(None).cast("string")
    chosen = df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{title_col}`").cast("string"), none if url_col is None else F.col(f"`{url_col}`"))
    return chosen.mapInArrow(run, "id long, title string, at long, whole long, bands array<long>, signature binary")


def _links_in_band(ids: list[int], signatures: list[bytes], new: list[bool]) -> Iterator[tuple[int, int]]:
    """(later, earlier) pairs of one key's records in the order of their ids that may be one work.

    Titles with the same words in any order were folded before. All that are left
    are compared with each other, also those of one signature, as other words may
    have it too; from LARGE records on by bit maps.
    """
    if len(ids) <= LARGE:
        sets = [frozenset(s) for s in signatures]
        for i, w in enumerate(sets):
            for j, other in enumerate(sets[:i]):
                if (new[i] or new[j]) and ids[i] != ids[j]:
                    both = len(w & other)
                    if both >= LIKELY * (len(w) + len(other) - both):
                        yield ids[i], ids[j]
        return
    words = [np.frombuffer(s, np.uint8) for s in signatures]
    bits = np.zeros((len(ids), 256), bool)
    bits[np.repeat(np.arange(len(ids)), [len(w) for w in words]), np.concatenate(words)] = True
    size, maps, fresh = bits.sum(axis=1), np.packbits(bits, axis=1).view(np.uint64), np.array(new, bool)
    for i in range(len(ids)):
        both = np.bitwise_count(maps[:i] & maps[i]).sum(axis=1, dtype=np.int64)
        for j in np.flatnonzero((both >= LIKELY * (size[:i] + size[i] - both)) & (fresh[:i] | fresh[i])).tolist():
            if ids[i] != ids[j]:
                yield ids[i], ids[j]


def _pairs(t: pa.Table, most: float = np.inf) -> Iterator[pa.RecordBatch]:
    """later, earlier, and whether each was stored, of records that share a key. t: key, id, signature, new, in the order of key and id.

    A key of more than `most` records gives one row of nulls instead.
    """
    key = t.column("key").to_numpy()
    same = key[1:] == key[:-1]
    member = np.zeros(len(key), bool)
    member[1:] |= same
    member[:-1] |= same
    at = np.flatnonzero(member)
    later: list[int | None] = []
    earlier: list[int | None] = []
    old: list[tuple[bool, bool]] = []

    def portion() -> pa.RecordBatch:
        flags = np.array(old, bool).reshape(-1, 2)
        out = [pa.array(later, pa.int64()), pa.array(earlier, pa.int64()), pa.array(flags[:, 0]), pa.array(flags[:, 1])]
        return pa.RecordBatch.from_arrays(out, names=["later", "earlier", "later_old", "earlier_old"])

    if len(at):
        few = t.take(pa.array(at))
        keys, ids = key[at], few.column("id").to_pylist()
        signatures, new = few.column("signature").to_pylist(), few.column("new").to_pylist()
        bounds = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for lo, hi in zip(bounds, bounds[1:]):
            if not any(new[lo:hi]):
                continue
            if hi - lo > most:
                later.append(None)
                earlier.append(None)
                old.append((False, False))
                continue
            fresh = {i for i, n in zip(ids[lo:hi], new[lo:hi]) if n}
            for x, y in _links_in_band(ids[lo:hi], signatures[lo:hi], new[lo:hi]):
                x, y = max(x, y), min(x, y)
                later.append(x)
                earlier.append(y)
                old.append((x not in fresh, y not in fresh))
                if len(later) >= PORTION:
                    yield portion()
                    later, earlier, old = [], [], []
    yield portion()


def band_links(rows: DataFrame, parts: int) -> DataFrame:
    """later, earlier, later_old, earlier_old: candidate links of records that share a key. rows: key, id, signature, new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            key = t.column("key").to_numpy()
            if not len(key):
                continue
            whole = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if whole:
                yield from _pairs(t.slice(0, whole))
            rest = t.slice(whole).combine_chunks()
        if rest is not None and rest.num_rows:
            yield from _pairs(rest)

    ready = rows.select("key", "id", "signature", "new").repartition(parts, "key").sortWithinPartitions("key", "id")
    return ready.mapInArrow(run, CANDIDATES).distinct()


class Stored(NamedTuple):
    """The folders of a table's segments, as tasks read them."""

    path: str
    segments: list[dict]

    def read(self, share: int, of: int, columns: list[str], kinds: tuple[int, ...] | None = None) -> Iterator[pa.Table]:
        """Portions of the folders that hashes with the low bits `share` fall in; of: how many shares there are, a power of two."""
        files, root = pa.fs.FileSystem.from_uri(self.path)
        for s in self.segments:
            n, empty = s["buckets"], set(s["empty"])
            for b in [share & (n - 1)] if n <= of else range(share, n, of):
                if b in empty:
                    continue
                for info in files.get_file_info(pa.fs.FileSelector(f"{root}/{s['name']}/bucket={b}")):
                    if info.path.endswith(".parquet"):
                        with files.open_input_file(info.path) as source:
                            yield from self._groups(pq.ParquetFile(source, read_dictionary=["signature"] if "signature" in columns else None), columns, kinds)

    @staticmethod
    def _groups(file: pq.ParquetFile, columns: list[str], kinds: tuple[int, ...] | None) -> Iterator[pa.Table]:
        at = file.schema_arrow.get_field_index("kind")
        for g in range(file.num_row_groups):
            if kinds is not None:
                seen = file.metadata.row_group(g).column(at).statistics
                if seen is not None and seen.has_min_max and (seen.min > max(kinds) or seen.max < min(kinds)):
                    continue
            yield file.read_row_group(g, columns=columns)


class _Among:
    """Finds values that are among some hashes or ids: by a bit map first, then in their order."""

    def __init__(self, some: np.ndarray, shift: int):
        """shift: low bits that tell little, as all of a share have the same."""
        self.some, self.shift = np.unique(some), shift
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self._place(self.some)] = True

    def _place(self, values: np.ndarray) -> np.ndarray:
        return (values >> self.shift) & (len(self.seen) - 1)

    def places(self, values: np.ndarray) -> np.ndarray:
        """Where the values are that are among them."""
        at = np.flatnonzero(self.seen[self._place(values)])
        if not len(at):
            return at
        near = np.minimum(np.searchsorted(self.some, values[at]), len(self.some) - 1)
        return at[self.some[near] == values[at]]


def _dealt(rows: DataFrame, h: Column, shares: int, parts: int, *by: str) -> DataFrame:
    """rows with their share, all of a share in one task, in the order of share and `by`."""
    rows = rows.withColumn("share", h.bitwiseAND(F.lit(shares - 1)).cast("int"))
    rows = rows.coalesce(1) if shares == 1 else rows.repartition(min(shares, parts), "share")
    return rows.sortWithinPartitions("share", *by)


def _by_share(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each share, or as many portions of about `most` rows as they make."""
    held: list[pa.Table] = []
    share: int | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        shares = t.column("share").to_numpy()
        bounds = np.flatnonzero(np.r_[True, shares[1:] != shares[:-1], True]) if len(shares) else []
        for lo, hi in zip(bounds, bounds[1:]):
            if held and (shares[lo] != share or most is not None and sum(h.num_rows for h in held) >= most):
                yield share, pa.concat_tables(held).combine_chunks()
                held = []
            share = int(shares[lo])
            held.append(t.slice(lo, hi - lo))
    if held:
        yield share, pa.concat_tables(held).combine_chunks()


TOLD = "kind int, key long, id long, signature binary, other long, old boolean"


def told(marked: DataFrame, stored: Stored, shares: int, parts: int) -> DataFrame:
    """The keys that a batch brings in (kind, key, id, signature) and, as kind LINK, its rows of addresses and titles that were there (id, other, old).

    Copies of an address or a whole title are linked to the one that is stored, or
    else to the first of the batch. One record of each title that is new goes on
    with its bands.
    """

    def rows(kind, key, ids, signature, other=None, old=None) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_())
        columns = [pa.nulls(len(kind), k) if c is None else pa.array(c, k) for c, k in zip((kind, key, ids, signature, other, old), types)]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "id", "signature", "other", "old"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int, bool] | None = None  # kind, key, what its rows are linked to, and whether that is stored
        for share, t in _by_share(batches, PORTION):
            kind, key, ids = (t.column(c).to_numpy() for c in ("kind", "key", "id"))
            known: dict[tuple[int, int], int] = {}
            some = _Among(key, WORD_BITS)
            for s in stored.read(share, shares, ["kind", "key", "id"], (ADDRESS, EXACT)):
                hit = some.places(s.column("key").to_numpy())
                k, stored_key, first = (s.column(c).to_numpy()[hit].tolist() for c in ("kind", "key", "id"))
                known.update(zip(zip(k, stored_key), first))
            begin = np.r_[True, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])]
            fresh: list[int] = []  # rows whose key is new
            links: list[tuple[int, int, bool]] = []
            for i, (new, kd, ke, x) in enumerate(zip(begin.tolist(), kind.tolist(), key.tolist(), ids.tolist())):
                if new and (last is None or last[:2] != (kd, ke)):
                    there = known.get((kd, ke))
                    last = (kd, ke, x if there is None else there, there is not None)
                    if there is None:
                        fresh.append(i)
                if last[2] != x:
                    links.append((x, last[2], last[3]))
            at = np.array(fresh, np.int64)
            lone = at[kind[at] == EXACT]
            each = np.repeat(lone, BANDS)
            yield rows(np.r_[kind[at], np.full(len(each), BAND)], np.r_[key[at], t.column("bands").take(pa.array(lone)).combine_chunks().flatten().to_numpy()], np.r_[ids[at], ids[each]], pa.chunked_array([pa.nulls(len(at), pa.binary()), *t.column("signature").take(pa.array(each)).chunks]).combine_chunks())
            later, earlier, old = zip(*links) if links else ((), (), ())
            yield rows(np.full(len(later), LINK), None, np.array(later, np.int64), None, np.array(earlier, np.int64), np.array(old, bool))

    none = F.lit(None)
    ways = F.array(
        F.struct(F.lit(ADDRESS).alias("kind"), F.col("at").alias("key"), none.cast("array<long>").alias("bands"), none.cast("binary").alias("signature")),
        F.struct(F.lit(EXACT).alias("kind"), F.col("whole").alias("key"), F.col("bands"), F.col("signature")),
    )
    plain = marked.select("id", F.explode(ways).alias("k")).select("id", "k.*").where("key is not null")
    return _dealt(plain, F.col("key"), shares, parts, "kind", "key", "id").mapInArrow(run, TOLD)


def met_links(lone: DataFrame, stored: Stored, shares: int, parts: int, most: float) -> DataFrame:
    """Candidate links of the records that share a band with each other or with stored ones; lone: key, id, signature.

    A key that more than `most` records have gives a row of nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, t in _by_share(batches):
            t = t.select(["key", "id", "signature"])
            some = _Among(t.column("key").to_numpy(), WORD_BITS)
            both = [t.append_column("new", pa.array(np.ones(t.num_rows, bool)))]
            for s in stored.read(share, shares, ["kind", "key", "id", "signature"], (BAND,)):
                hit = some.places(s.column("key").to_numpy())
                hit = hit[s.column("kind").to_numpy()[hit] == BAND]
                if len(hit):
                    both.append(s.select(["key", "id", "signature"]).take(pa.array(hit)).append_column("new", pa.array(np.zeros(len(hit), bool))))
            schema = both[0].schema
            whole = pa.concat_tables([b.cast(schema) for b in both])
            yield from _pairs(whole.sort_by([("key", "ascending"), ("id", "ascending")]).combine_chunks(), most)

    return _dealt(lone, F.col("key"), shares, parts).mapInArrow(run, CANDIDATES).distinct()


def sure_links(pairs: DataFrame, stored: Stored, shares: int, parts: int) -> DataFrame:
    """later and earlier, the works' firsts, and whether each was stored, of the links whose titles have the same words.

    pairs: id, title, other, other_title, old, sure. id is a new row; other is stored if old, then its title and first are
    looked up; sure links aren't compared. Nulls for a crowd stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for share, t in _by_share(batches, PORTION):
            ids, others = t.column("id").to_pylist(), t.column("other").to_pylist()
            titles, other_titles = t.column("title").to_pylist(), t.column("other_title").to_pylist()
            old, sure = t.column("old").to_pylist(), t.column("sure").to_pylist()
            some = _Among(np.array([y for y, o in zip(others, old) if o], np.int64), 0)
            works: dict[int, tuple[int, str]] = {}
            for s in stored.read(share, shares, ["id", "first", "title"]) if len(some.some) else ():
                hit = some.places(s.column("id").to_numpy())
                if len(hit):
                    s = s.take(pa.array(hit))
                    works.update(zip(s.column("id").to_pylist(), zip(s.column("first").to_pylist(), s.column("title").to_pylist())))
            rows: list[tuple] = []
            for x, y, a, b, o, certain in zip(ids, others, titles, other_titles, old, sure):
                first = y
                if o:
                    first, b = works[y]
                if x is None or certain or same_words(title(a), title(b)):
                    rows.append((x, False, first, o))
            columns = list(zip(*rows)) or [()] * 4
            types = (pa.int64(), pa.bool_(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types)], names=["later", "later_old", "earlier", "earlier_old"])

    return _dealt(pairs, F.xxhash64("other"), shares, parts).mapInArrow(run, "later long, later_old boolean, earlier long, earlier_old boolean")


def _word(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).cast("int")


def _bit(c: Column) -> Column:
    return F.shiftright(c, WORD_BITS).bitwiseAND(F.lit(63)).cast("int")


class BitMap:
    """Which hashes may be among some: at most 1 << WORD_BITS words of 64 bits, however many hashes there are."""

    def __init__(self, hashes: DataFrame):
        """hashes: one column h. most: how many hashes share a word at most; rows: how many there are."""
        words = hashes.groupBy(_word(F.col("h")).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("h")))).alias("mask"), F.count("*").alias("n"))
        self.table = words.toArrow()  # at most 1 << WORD_BITS rows
        self.words = self.table.column("word").to_numpy()
        n = self.table.column("n").to_numpy()
        self.rows, self.most = int(n.sum()), int(n.max(initial=0))

    def buckets(self, of: int) -> list[int]:
        """The folders that the hashes fall in, of a power of two."""
        return np.unique(self.words & (of - 1)).tolist()

    def keep(self, df: DataFrame, h: Column) -> DataFrame:
        """The rows of df whose hash may be among those of the map; the map's size is bounded, so it is broadcast."""
        some = df.sparkSession.createDataFrame(self.table.select(["word", "mask"]))
        marked = df.withColumn("__word", _word(h)).withColumn("__bit", F.call_function("shiftleft", F.lit(1).cast("long"), _bit(h)))
        met = marked.join(F.broadcast(some.withColumnRenamed("word", "__word")), "__word")
        return met.where(F.col("mask").bitwiseAND(F.col("__bit")) != 0).select(*df.columns)


class Prepared(NamedTuple):
    """A batch ready to be added: its name, its folder in the shared one, its rows with their keys, and how many they are."""

    name: str
    work: str
    marked: DataFrame
    rows: int


class WorkIndex:
    """The accepted works: their keys, in folders by hash, and the first record of each.

    path: a folder on shared storage that Spark and pyarrow can both read. Tables:
    keys (kind, key, id, signature) of accepted records, an address and a whole
    title once; works (id, first, title) of all records that came in, first as it
    was known then; joined (id, first) of firsts whose work a later row joined to
    an older one; found, the results of each batch. A list of segments in
    `commits` says what counts. ingest() may be called any number of times, by
    one caller at a time.
    """

    KEYS, WORKS, PAIRS = "kind int, key long, id long, signature binary", "id long, first long, title string", "id long, first long"

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = BUCKET_ROWS, hot: int = HOT, fan: int = FAN):
        self.spark, self.path, self.bucket_rows, self.hot, self.fan = spark, path.rstrip("/"), bucket_rows, hot, fan
        self.state = self._latest()

    # What counts.

    def _latest(self) -> dict:
        files, at = hadoop(self.spark, f"{self.path}/commits")
        names = sorted(f.getPath().getName() for f in files.listStatus(at)) if files.exists(at) else []
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return {"number": 0, "keys": [], "works": [], "joined": [], "found": {}}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/commits/{names[-1]}").collect()))

    def _commit(self, state: dict) -> None:
        """Put the next list in place: written beside it, then renamed, which fails if another caller was first."""
        state = state | {"number": self.state["number"] + 1}
        files, at = hadoop(self.spark, f"{self.path}/commits/.{uuid.uuid4().hex}")
        out = files.create(at, True)
        out.write(bytearray(json.dumps(state), "utf-8"))
        out.close()
        _, to = hadoop(self.spark, f"{self.path}/commits/{state['number']:010d}.json")
        if files.exists(to) or not files.rename(at, to):
            raise RuntimeError("another caller changed the index at the same time")
        self.state = state

    # Segments.

    def _shares(self, estimate: int) -> int:
        """Folders for so many rows, a power of two."""
        n = 1
        while n * self.bucket_rows < estimate and n < 1 << WORD_BITS:
            n *= 2
        return n

    def _write(self, rows: DataFrame, table: str, h: Column, estimate: int, tier: int = 0) -> dict:
        """Write rows as a segment with as many folders as they need; what the list says of it."""
        buckets = self._shares(estimate)
        name = f"{table}/segment={uuid.uuid4().hex}"
        rows = rows.withColumn("bucket", h.bitwiseAND(F.lit(buckets - 1)).cast("int"))
        rows = rows.coalesce(1) if buckets == 1 else rows.repartition(buckets, "bucket")
        order = ("kind", "id") if "kind" in rows.columns else ("id",)
        rows.sortWithinPartitions("bucket", *order).write.partitionBy("bucket").option("compression", "zstd").option("parquet.block.size", 1 << 20).parquet(f"{self.path}/{name}")
        files, at = hadoop(self.spark, f"{self.path}/{name}")
        there = {int(n.partition("=")[2]) for f in files.listStatus(at) if "=" in (n := f.getPath().getName())}
        return {"name": name, "buckets": buckets, "empty": sorted(set(range(buckets)) - there), "rows": estimate, "tier": tier}

    def _paths(self, table: str, some: BitMap | None = None) -> list[str]:
        """The folders of a table that hashes of a map fall in."""
        out = []
        for s in self.state[table]:
            wanted = range(s["buckets"]) if some is None else some.buckets(s["buckets"])
            out += [f"{self.path}/{s['name']}/bucket={b}" for b in wanted if b not in set(s["empty"])]
        return out

    def _read(self, table: str, schema: str, some: BitMap | None = None) -> DataFrame:
        paths = self._paths(table, some)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _merged(self, state: dict, table: str, schema: str, h: Column) -> tuple[dict, list[str]]:
        """The list with FAN segments of a tier merged into one of the next, as often as there are so many; folders no more needed."""
        gone: list[str] = []
        while True:
            tiers = [s["tier"] for s in state[table]]
            tier = next((t for t in sorted(set(tiers)) if tiers.count(t) >= self.fan), None)
            if tier is None:
                return state, gone
            old = [s for s in state[table] if s["tier"] == tier]
            paths = [f"{self.path}/{s['name']}/bucket={b}" for s in old for b in range(s["buckets"]) if b not in set(s["empty"])]
            rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
            total = sum(s["rows"] for s in old)
            new = self._write(rows, table, h, total, tier + 1)
            state = state | {table: [s for s in state[table] if s["tier"] != tier] + [new]}
            gone += [s["name"] for s in old]

    # Results.

    def joined(self) -> DataFrame:
        """id and first of the works that a later row joined to an older one."""
        paths = [f"{self.path}/{n}" for n in self.state["joined"]]
        rows = self.spark.read.schema(self.PAIRS).parquet(*paths) if paths else self.spark.createDataFrame([], self.PAIRS)
        return rows.groupBy("id").agg(F.min("first").alias("first"))

    def repeats(self) -> DataFrame:
        """id and first of every repeat, by what is known now, the same for any cut into batches.

        A row that belongs to two works makes them one: the later work's rows, its
        first among them, get the first of the older.
        """
        found = self._read("works", self.WORKS).where("id <> first").select("id", "first")
        if not self.state["joined"]:
            return found
        moved = cut(self.joined())
        now = found.join(moved.select(F.col("id").alias("first"), F.col("first").alias("now")), "first", "left")
        return now.select("id", F.coalesce("now", "first").alias("first")).unionByName(moved)

    # A batch.

    def _split(self, rows: DataFrame, share: int = 64) -> DataFrame:
        """rows, with keys that very many rows have split so that no task gets the crowd.

        The crowd is dealt into splits and each two splits get a key of their own,
        so any two rows still meet. Hot keys are looked for among the rows of every
        64th id, which decides only where splits are made, not what is found.
        """
        drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).groupBy("key").count().where(F.col("count") > self.hot / share)
        hot = cut(drawn.select("key", F.ceil(2 * share * F.col("count") / self.hot).cast("int").alias("splits")))
        dealt = rows.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("id", F.lit(1)), F.col("splits"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("splits") - 1)))
        crowd = dealt.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).select(*rows.columns)
        return crowd.unionByName(rows.join(hot, "key", "left_anti").select(*rows.columns))

    def prepare(self, batch: DataFrame, id_col: str, title_col: str, url_col: str, name: str | None = None) -> Prepared:
        """A batch's keys, which don't depend on what is stored; accept() takes them in."""
        work = scratch(self.spark, "batch")
        rows, seen = profiles(batch.where(F.col(f"`{id_col}`").isNotNull()), id_col, title_col, url_col), Observation()
        rows.observe(seen, F.count("*").alias("rows")).write.parquet(f"{work}/marked")
        marked = self.spark.read.schema(rows.schema).parquet(f"{work}/marked")
        return Prepared(uuid.uuid4().hex if name is None else name, work, marked, seen.get["rows"])

    def accept(self, batch: Prepared) -> DataFrame:
        """Add a prepared batch; id and first of each of its rows that repeats an earlier row."""
        if batch.name not in self.state["found"]:
            self._accept(batch)
        remove(self.spark, batch.work)
        return self.result(batch.name)

    def result(self, name: str) -> DataFrame:
        """What a batch of that name gave."""
        return self.spark.read.schema(self.PAIRS + ", old boolean").parquet(f"{self.path}/{self.state['found'][name]}").where("not old").select("id", "first")

    def ingest(self, batch: DataFrame, id_col: str, title_col: str, url_col: str, name: str | None = None) -> DataFrame:
        """Add a batch; id and first of each of its rows that repeats an earlier row.

        Earlier are all rows ingested before and the rows of the batch with a
        smaller id. Null ids are left out. A title of less than LEAST_WORDS
        telling words (also a null or blank one) and a url that names no record
        tell nothing; a row with neither is new. Ties of equal rows go by id. A
        name that was ingested before adds nothing and gives its result again.
        """
        if name is not None and name in self.state["found"]:
            return self.result(name)
        with tidy(self.spark):
            return self.accept(self.prepare(batch, id_col, title_col, url_col, name))

    def ingest_all(self, batches: Iterable[tuple[str, DataFrame]], id_col: str, title_col: str, url_col: str) -> None:
        """Add batches one after the other; while one is added the next is prepared."""
        with tidy(self.spark), ThreadPoolExecutor(1) as ahead:
            ready: Future | None = None
            for name, batch in batches:
                coming = ahead.submit(self.prepare, batch, id_col, title_col, url_col, name)
                if ready is not None:
                    self.accept(ready.result())
                ready = coming
            if ready is not None:
                self.accept(ready.result())

    def _crowd_links(self, lone: DataFrame, parts: int) -> DataFrame:
        """Candidate links as met_links() gives them, with the keys that very many rows have split among tasks."""
        mine = BitMap(lone.select(F.col("key").alias("h")))
        met = lone.select("key", "id", "signature", F.lit(True).alias("new"))
        stored = mine.keep(self._read("keys", self.KEYS, mine).where(F.col("kind") == BAND), F.col("key"))
        return band_links(self._split(met.unionByName(stored.select("key", "id", "signature", F.lit(False).alias("new")))), parts)

    def _accept(self, batch: Prepared) -> None:
        spark, parts = self.spark, int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        work, total = batch.work, batch.rows * (BANDS + 2)
        shares, title_shares = self._shares(total), self._shares(batch.rows * WIDER)
        keys, works = (Stored(self.path, self.state[t]) for t in ("keys", "works"))

        def kept(df: DataFrame, to: str) -> DataFrame:
            df.write.parquet(to)
            return small(spark.read.schema(df.schema).parquet(to))

        def small(df: DataFrame) -> DataFrame:
            """What has the keys of one folder is one part, so that it needs no shuffle."""
            return df.coalesce(1) if shares == 1 else df

        def current(df: DataFrame, of: str) -> DataFrame:
            """df with firsts that are known to belong to older works replaced."""
            if not self.state["joined"]:
                return df
            moved = self.joined().select(F.col("id").alias(of), F.col("first").alias("__now"))
            return df.join(moved, of, "left").withColumn(of, F.coalesce("__now", of)).select(*df.columns)

        def linked(likely: DataFrame) -> DataFrame:
            """The batch's links to be kept, of the candidates and of equal addresses and titles: id, first, whether id was there before."""
            flip = F.col("later_old")
            ends = likely.select(F.when(flip, F.col("earlier")).otherwise(F.col("later")).alias("id"), F.when(flip, F.col("later")).otherwise(F.col("earlier")).alias("other"), (flip | F.col("earlier_old")).alias("old"))
            texts = marked.select("id", "title")
            pairs = ends.join(texts.hint("merge"), "id", "left").join(texts.hint("merge").select(F.col("id").alias("other"), F.col("title").alias("other_title")), "other", "left")
            sure = rows.where(F.col("kind") == LINK).select("id", "other", "old", F.lit(True).alias("sure"))
            links = sure_links(pairs.withColumn("sure", F.lit(False)).unionByName(sure, allowMissingColumns=True), works, title_shares, parts)
            links = current(links, "earlier").where("later <> earlier or later is null")
            larger = F.col("later") > F.col("earlier")
            return links.groupBy(F.greatest("later", "earlier").alias("id"), F.least("later", "earlier").alias("first")).agg(F.max(F.when(larger, F.col("later_old")).otherwise(F.col("earlier_old"))).alias("old"))

        def new_place() -> str:
            return f"{self.path}/found/{uuid.uuid4().hex}"

        def titles_of(edges: DataFrame) -> DataFrame:
            return marked.select("id", "title").join(edges.where("not old").select("id", "first").hint("merge"), "id", "left").select("id", F.coalesce("first", "id").alias("first"), "title")

        def look(edges: DataFrame) -> tuple[int, int, int]:
            """Ends of links that aren't settled, stored firsts that are linked to older ones, keys that wait to be split."""
            none = F.lit(None)
            ends = edges.select("id", F.col("first").alias("lo"), F.col("old").cast("int").alias("old")).unionByName(edges.select(F.col("first").alias("id"), none.cast("long").alias("lo"), F.lit(0).alias("old")))
            seen = ends.groupBy("id").agg(F.min("lo").alias("lo"), F.max("lo").alias("hi"), F.count_if(F.col("lo").isNull()).alias("roots"), F.max("old").alias("old"))
            return tuple(seen.agg(F.count_if(F.expr("lo <> hi or (lo is not null and roots > 0)")), F.count_if(F.col("old") == 1), F.count_if(F.col("id").isNull())).first())

        marked = small(batch.marked)

        # Copies of a whole title or an address are linked to one, and one record of each title that is new goes on with its bands.
        rows = kept(told(marked, keys, shares, parts), f"{work}/told")
        lone = rows.where(F.col("kind") == BAND).select("key", "id", "signature")
        with ThreadPoolExecutor(2) as pool:
            fresh = rows.where(F.col("kind") != LINK).select("kind", "key", "id", "signature")
            writing = pool.submit(self._write, fresh, "keys", F.col("key"), total)
            found_at = new_place()
            edges = kept(linked(met_links(lone, keys, shares, parts, self.hot)), found_at)

            # Mostly each record is linked to one first that is linked to none: then the links are the result. While that
            # is looked up the titles are written as if it were so; what turns out wrong is written again.
            write = lambda e: self._write(titles_of(e), "works", F.xxhash64("id"), max(1, batch.rows * WIDER))
            titles, wrong = pool.submit(write, edges), []
            open_ends, moved, crowds = look(edges)
            if crowds:
                wrong, found_at = [*wrong, found_at], new_place()
                edges = kept(linked(self._crowd_links(lone, parts)), found_at)
                open_ends, moved, _ = look(edges)
            if open_ends:
                ids = marked.select("id").distinct().withColumn("new", F.lit(True))
                roots = components(edges, "id", "first").where("node <> root").select(F.col("node").alias("id"), F.col("root").alias("first"))
                wrong, found_at = [*wrong, found_at], new_place()
                edges = kept(roots.join(ids, "id", "left").select("id", "first", F.col("new").isNull().alias("old")), found_at)
                moved = edges.where("old").count()
            written = titles.result()
            if wrong:
                wrong.append(f"{self.path}/{written['name']}")
                written = write(edges)
            for path in wrong:
                remove(spark, path)
            key_segment = writing.result()
        state = self.state | {"found": self.state["found"] | {batch.name: found_at.removeprefix(f"{self.path}/")}}
        if moved:  # also what was joined to a first that is none any more gets the new one
            gone = edges.where("old").select("id", "first")
            if self.state["joined"]:
                further = self.joined().join(gone.select(F.col("id").alias("first"), F.col("first").alias("now")), "first").select("id", F.col("now").alias("first"))
                gone = gone.unionByName(further)
            to = f"joined/{uuid.uuid4().hex}"
            gone.coalesce(1).write.parquet(f"{self.path}/{to}")
            state["joined"] = [*state["joined"], to]

        state |= {"keys": [*state["keys"], key_segment], "works": [*state["works"], written]}
        state, old_keys = self._merged(state, "keys", self.KEYS, F.col("key"))
        state, old_works = self._merged(state, "works", self.WORKS, F.xxhash64("id"))
        self._commit(state)
        for segment in old_keys + old_works:
            remove(spark, f"{self.path}/{segment}")

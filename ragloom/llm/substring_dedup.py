"""Removal of bytes in strings of a fixed length that start at more than one place of a corpus.

Texts are cut at anchors that depend on their content alone: the key of a window of ``WINDOW`` bytes
is the least hash of the ``ANCHOR`` bytes' strings in it, and a piece is a run of windows with one
key. Equal windows have equal keys, so pieces are dealt by key and each collection of pieces is
sorted on its own. A collection's Burrows-Wheeler transform and common prefixes grow column by
column: each round puts one symbol of every string before its suffix, right to left, and rewrites
both files front to back. Windows whose suffix has ``WINDOW`` bytes in common with a neighbour's
are repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import textkit
from ragloom.llm.scratch import KeySet, Scratch, if_small

WINDOW = 200
ANCHOR = 100
#: Bytes of a symbol, one 64-bit integer: a text has this many readings, one for each remainder of a start. Divides ``WINDOW``.
WIDTH = 8
#: Bytes of a text that are cut at once; a longer text is cut in overlapping sections.
SECTION = 1 << 22
#: Pieces of a collection. A key has at most ``MOST`` different pieces in one; the windows of keys with more are counted by digest.
COLLECTION, MOST = 512, 4096

_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)


_BASE = 0x9E3779B97F4A7C55
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each. Hashes by them choose where texts are cut, not what is equal."""
    if len(_tables.get("power", ())) < n:
        for key, base in (("power", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            table = np.full(max(n, 2 * textkit.SLICE_BYTES), base, np.uint64)
            table[0] = 1
            _tables[key] = np.multiply.accumulate(table)
    return _tables["power"], _tables["inverse"]


def _sliding(values: np.ndarray, width: int, pick: np.ufunc, rest: np.uint64) -> np.ndarray:
    """pick.reduce of values[i : i + width] for each i, with ``rest`` past the end: from the running picks of blocks, forward and backward."""
    n = len(values)
    blocks = np.concatenate([values, np.full(-n % width + width, rest, np.uint64)]).reshape(-1, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


class Cutter:
    """Windows, anchors and pieces of texts, for a length of windows and of anchors."""

    def __init__(self, window: int = WINDOW, anchor: int = ANCHOR):
        self.window, self.anchor, self.reach = window, anchor, window - anchor + 1

    def sections(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, offset in its text, bytes, bounds) so that every window of every text lies in one section."""
        raw, bounds, _ = textkit.buffers(texts)
        for lo, hi in textkit.slices(bounds):
            a, b = int(bounds[lo]), int(bounds[hi])
            if hi == lo + 1 and b - a > SECTION:
                for at in range(a, b - self.window + 1, SECTION):
                    own = raw[at : min(b, at + SECTION + self.window - 1)]
                    yield lo, at - a, own, np.array([0, len(own)])
            elif b - a >= self.window:
                yield lo, 0, raw[a:b], bounds[lo : hi + 1] - a

    def keys(self, own: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash of each anchor string, key of each window start, and whether a window lies in one text."""
        n, k = len(own), self.anchor
        power, inverse = _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((own.astype(np.uint64) + _U(1)) * power[:n], out=sums[1:])
        h = textkit.mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])
        whole = np.zeros(n - self.window + 2, np.int32)
        long_enough = np.diff(bounds) >= self.window
        np.add.at(whole, bounds[:-1][long_enough], 1)
        np.add.at(whole, bounds[1:][long_enough] - self.window + 1, -1)
        return h, _sliding(h, self.reach, np.minimum, _TOP)[: n - self.window + 1], np.cumsum(whole[:-1]) > 0

    def anchors(self, texts: pa.Array) -> np.ndarray:
        """The hash of every place that is the least of some window."""
        found = [np.zeros(0, np.uint64)]
        for _, _, own, bounds in self.sections(texts):
            h, key, whole = self.keys(own, bounds)
            # a place is an anchor if its hash is the greatest key of the windows that hold it
            around = np.concatenate([np.zeros(self.reach - 1, np.uint64), np.where(whole, key, _U(0)), np.zeros(self.reach - 1, np.uint64)])
            found.append(h[h == _sliding(around, self.reach, np.maximum, _U(0))[: len(h)]])
        return np.concatenate(found)

    def pieces(self, texts: pa.Array, wanted: KeySet) -> Iterator[tuple[int, int, int, int, bytes]]:
        """(row, start, windows, key, bytes) of each piece with a wanted key; a run of over ``reach`` windows is several pieces."""
        for lo, offset, own, bounds in self.sections(texts):
            _, key, whole = self.keys(own, bounds)
            turn = np.ones(len(key) + 1, bool)
            turn[1:-1] = (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
            # texts may follow each other without a window between them
            turn[bounds[bounds < len(key)]] = True
            edge = np.flatnonzero(turn)
            start, size = edge[:-1], np.diff(edge)
            use = whole[start]
            use[use] = wanted.has(key[start[use]].view(np.int64))
            start, size = start[use], size[use]
            parts = -(-size // self.reach)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            at = np.repeat(start, parts) + nth * self.reach
            n = np.minimum(np.repeat(start + size, parts) - at, self.reach)
            row = np.searchsorted(bounds, at, side="right") - 1
            data = own.tobytes()
            for r, s, m, x, b in zip((lo + row).tolist(), at.tolist(), n.tolist(), key[at].view(np.int64).tolist(), (at - bounds[row] + offset).tolist()):
                yield r, b, m, x, data[s : s + m + self.window - 1]


def shared_starts(data: np.ndarray, start: np.ndarray, length: np.ndarray, least: int) -> np.ndarray:
    """For each byte of the strings data[start : start + length], whether the ``least`` bytes from there lie in one string and occur again.

    ``bwt`` has, for the suffixes so far in their order, the symbol before each (0: none), ``lcp`` the symbols that each has in common
    with the one before it; ends of strings come first. A suffix grown by its symbol goes to where its symbol stands among all equal ones,
    as those keep their order; its common prefix is one more than the least of those between the two equal symbols' suffixes.
    """
    width = WIDTH
    least //= width
    grams = np.ndarray((max(0, len(data) - width + 1),), "<u8", data.tobytes(), strides=(1,))
    values, code = np.unique(grams, return_inverse=True)
    kind = np.uint16 if len(values) < (1 << 16) - 1 else np.uint32
    code = (code + 1).astype(kind)
    base = (start[:, None] + np.arange(width)).ravel()
    symbols = ((length[:, None] - np.arange(width)) // width).ravel()
    base, symbols = base[symbols > 0], symbols[symbols > 0]
    n, rounds, count = len(base), int(symbols.max(initial=0)), np.uint16
    bwt, lcp = code[base + width * (symbols - 1)], np.zeros(n, count)
    rank, string = np.arange(n), np.arange(n)

    def sources(bwt: np.ndarray) -> np.ndarray:
        """For each suffix after the ends, in order, the place of its first symbol in the transform."""
        return np.argsort(bwt, kind="stable")[len(bwt) - np.count_nonzero(bwt) :]

    for column in range(1, rounds + 1):
        source = sources(bwt)
        owner = np.full(len(bwt), -1, np.int64)
        owner[rank] = string
        owner = owner[source]
        at = np.flatnonzero(owner >= 0)
        string = owner[at]
        near = np.zeros(len(source) + 1, bool)
        near[at] = near[at + 1] = True
        k = np.flatnonzero(near[:-1])
        here, before = source[k], source[k - 1]
        equal = (k > 0) & (bwt[here] == bwt[before])
        common = np.zeros(len(k), count)
        common[equal] = 1 + _least_between(lcp, before[equal] + 1, here[equal] + 1)
        stays = np.ones(len(source), bool)
        stays[at] = False
        left = symbols[string] - column
        grown_bwt, grown_lcp = np.empty(n + len(source), kind), np.zeros(n + len(source), count)
        grown_bwt[:n] = bwt[:n]
        grown_bwt[n:][stays] = bwt[n:]
        grown_bwt[n + at] = np.where(left > 0, code[base[string] + width * np.maximum(left - 1, 0)], 0)
        grown_lcp[n:][stays] = lcp[n:]
        grown_lcp[n + k] = common
        bwt, lcp = grown_bwt, grown_lcp
        rank, string = n + at[left > 0], string[left > 0]

    repeated = lcp >= least
    repeated[:-1] |= repeated[1:]
    source = sources(bwt)
    grown = np.zeros(len(bwt), np.int64)
    grown[source] = np.arange(n, n + len(source))
    out = np.zeros(len(data), bool)
    rank, string = np.arange(n), np.arange(n)
    for column in range(1, rounds + 1):
        go = symbols[string] >= column
        rank, string = grown[rank[go]], string[go]
        if column >= least:
            out[base[string] + width * (symbols[string] - column)] = repeated[rank]
    return out


def _least_between(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo:hi] for each pair, none empty, from the least of each power of two of values."""
    if not len(lo):
        return np.zeros(0, values.dtype)
    level = np.frexp(hi - lo)[1] - 1
    table = np.empty((int(level.max()) + 1, len(values)), values.dtype)
    table[0] = values
    for x in range(1, len(table)):
        half = 1 << (x - 1)
        np.minimum(table[x - 1, :-half], table[x - 1, half:], out=table[x, :-half])
    return np.minimum(table[level, lo], table[level, hi - (1 << level)])


def _digest(piece: bytes) -> bytes:
    return hashlib.blake2b(piece, digest_size=16).digest()


def _text_digest(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def repeated_anchors(texts: DataFrame, cut: Cutter) -> DataFrame:
    """(anchor) of the hashes that are anchors at two places or more."""

    def counted(batches):
        for b in batches:
            values, n = np.unique(cut.anchors(b.column(0)), return_counts=True)
            yield _batch(anchor=pa.array(values.view(np.int64)), n=pa.array(n))

    return texts.mapInArrow(counted, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")


def tallies(texts: DataFrame, cut: Cutter, wanted: KeySet) -> DataFrame:
    """(anchor, digest, windows, n): how often each piece with a wanted key occurs, by digest."""

    def each(batches):
        for b in batches:
            n: dict[tuple[int, bytes, int], int] = {}
            for _, _, windows, key, piece in cut.pieces(b.column(0), wanted):
                k = key, _digest(piece), windows
                n[k] = n.get(k, 0) + 1
            anchor, digest, windows = zip(*n) if n else ((), (), ())
            yield _batch(anchor=pa.array(anchor, pa.int64()), digest=pa.array(digest, pa.binary()), windows=pa.array(windows, pa.int32()), n=pa.array(list(n.values()), pa.int64()))

    rows = wanted.narrowed(texts.mapInArrow(each, "anchor bigint, digest binary, windows int, n bigint"), "anchor")
    return rows.groupBy("anchor", "digest", "windows").agg(F.sum("n").alias("n"))


def pieces_of(texts: DataFrame, cut: Cutter, wanted: KeySet) -> DataFrame:
    """(anchor, piece, n): the different pieces with a wanted key and how often each occurs."""

    def each(batches):
        for b in batches:
            n: dict[tuple[int, bytes], int] = {}
            for _, _, _, key, piece in cut.pieces(b.column(0), wanted):
                n[key, piece] = n.get((key, piece), 0) + 1
            yield _batch(anchor=pa.array([k for k, _ in n], pa.int64()), piece=pa.array([p for _, p in n], pa.binary()), n=pa.array(list(n.values()), pa.int64()))

    rows = wanted.narrowed(texts.mapInArrow(each, "anchor bigint, piece binary, n bigint"), "anchor")
    return rows.groupBy("anchor", "piece").agg(F.sum("n").alias("n"))


def places_of(texts: DataFrame, cut: Cutter, wanted: KeySet) -> DataFrame:
    """(digest, text_digest, start) of the pieces with a wanted key in each text; equal texts of a batch are one."""

    def each(batches):
        for b in batches:
            found: set[tuple[bytes, bytes, int]] = set()
            row, own = -1, b""
            for r, start, _, _, piece in cut.pieces(b.column(0), wanted):
                if r != row:
                    row, own = r, _text_digest(b.column(0)[r].as_buffer().to_pybytes())
                found.add((_digest(piece), own, start))
            digest, text, start = zip(*found) if found else ((), (), ())
            yield _batch(digest=pa.array(digest, pa.binary()), text_digest=pa.array(text, pa.binary()), start=pa.array(start, pa.int64()))

    return texts.mapInArrow(each, "digest binary, text_digest binary, start bigint")


def _packed(flags: np.ndarray) -> bytes:
    return np.packbits(flags, bitorder="little").tobytes()


_MARKS = "digest binary, windows int, mask binary"


def _marks(rows: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
    rows = [(p, f) for p, f in rows if f.any()]
    return _batch(digest=pa.array([_digest(p) for p, _ in rows], pa.binary()), windows=pa.array([len(f) for _, f in rows], pa.int32()), mask=pa.array([_packed(f) for _, f in rows], pa.binary()))


def sorted_marks(pieces: DataFrame, window: int, partitions: int) -> DataFrame:
    """(digest, windows, mask) of the pieces that occur once and have a repeated window, from the sorted suffixes of collections of whole keys."""

    def collection(rows: list[tuple[bytes, int]]) -> pa.RecordBatch:
        length = np.array([len(p) for p, _ in rows], np.int64)
        start = np.cumsum(length) - length
        flags = shared_starts(np.frombuffer(b"".join(p for p, _ in rows), np.uint8), start, length, window) if rows else None
        return _marks([(p, flags[s : s + m - window + 1]) for (p, n), s, m in zip(rows, start.tolist(), length.tolist()) if n == 1])

    def each(batches):
        key, group, waiting = None, [], []
        for b in batches:
            for k, p, n in zip(*(c.to_pylist() for c in b.columns)):
                if k != key:
                    waiting += group
                    if len(waiting) >= COLLECTION:
                        yield collection(waiting)
                        waiting = []
                    key, group = k, []
                group.append((p, n))
        yield collection(waiting + group)

    return pieces.select("anchor", "piece", "n").repartition(partitions, "anchor").sortWithinPartitions("anchor").mapInArrow(each, _MARKS)


def counted_marks(pieces: DataFrame, window: int) -> DataFrame:
    """The same for keys with very many pieces: a string for each window, so that equal ones meet by digest and are only counted."""

    def each(batches):
        for b in batches:
            for p, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = len(p) - window + 1
                digests = pa.array([_digest(p[k : k + window]) for k in range(m)], pa.binary())
                yield _batch(string=digests, digest=pa.array([_digest(p)] * m, pa.binary()), nth=pa.array(range(m), pa.int32()), windows=pa.array([m] * m, pa.int32()), n=pa.array([n] * m, pa.int64()))

    windows = pieces.select("piece", "n").mapInArrow(each, "string binary, digest binary, nth int, windows int, n bigint")
    again = windows.groupBy("string").agg(F.sum("n").alias("all")).filter("all > 1").select("string")

    def packed(batches):
        for b in batches:
            masks = []
            for nth, m in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
                flags = np.zeros(m, bool)
                flags[nth] = True
                masks.append(_packed(flags))
            yield _batch(digest=b.column(0), windows=b.column(1), mask=pa.array(masks, pa.binary()))

    return windows.join(again, "string").groupBy("digest", "windows").agg(F.collect_set("nth").alias("nth")).mapInArrow(packed, _MARKS)


def marked(scratch: Scratch, texts: DataFrame, cut: Cutter, wanted: KeySet, most: int = MOST) -> DataFrame:
    """(digest, windows, mask) of the pieces with a repeated window; without a mask all are.

    Pieces that occur twice are repeated as a whole, so only keys with a piece that occurs once are sorted. Keys of over ``most``
    different pieces, of which one task need not hold the whole, are counted window by window.
    """
    found = scratch.save(tallies(texts, cut, wanted))
    keys = scratch.save(found.groupBy("anchor").agg(F.count("*").alias("k"), F.min("n").alias("least")).filter("least = 1").select("anchor", "k"))
    twice = found.filter("n > 1").select("digest", "windows", F.lit(None).cast("binary").alias("mask"))
    hot = keys.filter(F.col("k") > most).select("anchor")
    cold = keys.filter(F.col("k") <= most)
    n_pieces, n_hot = cold.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0], hot.count()
    partitions = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + n_pieces // (1 << 15))
    pieces = pieces_of(texts, cut, KeySet(cold.select("anchor")))
    few = if_small(hot)
    marks = twice.unionByName(sorted_marks(pieces.join(few, "anchor", "left_anti") if n_hot else pieces, cut.window, partitions))
    if n_hot:
        many = pieces_of(texts, cut, KeySet(hot)).join(few, "anchor", "left_semi").filter("anchor is not null")
        marks = marks.unionByName(counted_marks(many, cut.window))
    marks = scratch.save(marks.dropDuplicates(["digest"]) if n_hot else marks)
    scratch.drop(found, keys)
    return marks


def deduplicated(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, most: int = MOST) -> DataFrame:
    """The rows with ``_spans`` (start and end, in bytes, of the runs removed from the text) and ``_kept`` (the remaining bytes).

    A byte goes if a string of ``window`` bytes that covers it starts at any other place of any text. ``window`` is a multiple of 8, ``anchor`` shorter.
    A null text has no bytes. Results depend on texts alone, so ids may be null or repeated; every row of a repeated text loses it. Columns
    named ``_spans`` or ``_kept`` are left out of the result.
    """
    cut, scratch = Cutter(window, anchor), Scratch(docs.sparkSession)
    text_col = F.coalesce(text, F.lit(""))
    texts = docs.select(text_col.alias("text")).filter(F.octet_length("text") >= window)
    anchors = scratch.save(repeated_anchors(texts, cut))
    wanted = KeySet(anchors)
    marks = marked(scratch, texts, cut, wanted, most)
    found = places_of(texts, cut, wanted).join(marks, "digest").groupBy("text_digest").agg(F.collect_set(F.struct("start", "windows", "mask")).alias("_marks"))
    found = scratch.save(found)
    scratch.drop(anchors, marks)
    kept = [c for c in docs.columns if c not in ("_spans", "_kept")]
    rows = docs.select(F.struct(*kept).alias("_row"), text_col.alias("_text"), F.substring(F.unhex(F.sha2(text_col.cast("binary"), 256)), 1, 16).alias("text_digest"))
    row_type = rows.schema["_row"].dataType.simpleString()
    # only texts that may have marks are shuffled
    some = KeySet(found.select(F.conv(F.hex(F.substring("text_digest", 1, 8)), 16, -10).cast("bigint").alias("start")))

    def side(inside: bool) -> DataFrame:
        def chosen(batches):
            for b in batches:
                digests = b"".join(b.column(2).to_pylist())
                has = some.has(np.frombuffer(digests, ">i8")[::2].astype(np.int64))
                yield b.filter(pa.array(has == inside))

        return rows.mapInArrow(chosen, f"_row {row_type}, _text string, text_digest binary")

    joined = side(True).join(found, "text_digest", "left").select("_row", "_text", "_marks")

    def removed(batches):
        for b in batches:
            spans, left = [], []
            for t, marks_ in zip(b.column(1), b.column(2).to_pylist()):
                own = np.frombuffer(t.as_buffer(), np.uint8) if len(t.as_buffer()) else np.zeros(0, np.uint8)
                change = np.zeros(len(own) + 1, np.int64)
                for m in marks_ or ():
                    if m["mask"] is None:
                        lo, hi = m["start"], m["start"] + m["windows"] + window - 1
                        change[lo] += 1
                        change[hi] -= 1
                    else:
                        at = m["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(m["mask"], np.uint8), bitorder="little")[: m["windows"]])
                        change[at] += 1
                        change[at + window] -= 1
                gone = np.cumsum(change[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                left.append(own[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield _batch(_row=b.column(0), _spans=pa.array(spans, kind), _kept=pa.array(left, pa.binary()))

    spans_type = "array<struct<start: bigint, end: bigint>>"
    changed = joined.mapInArrow(removed, f"_row {row_type}, _spans {spans_type}, _kept binary")
    whole = side(False).select("_row", F.array().cast(spans_type).alias("_spans"), F.col("_text").cast("binary").alias("_kept"))
    return changed.unionByName(whole).select("_row.*", "_spans", "_kept")

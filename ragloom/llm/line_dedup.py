"""Near-duplicate lines by an exact set-similarity join; later matches are removed.

A line is the set of its words (A-Z lower-cased). Lines with equal sets are one class, held by its
first occurrence in the order of document id and line number. Tokens are ordered by rarity: the
counts of all words of all documents, in ``BUCKETS`` hashed counters, then the hash, which is one
total order whatever collides. With a similarity of at least t, two lines of sizes a and b share one of
the first n - ceil(t n) + 1 tokens of each, so each class goes to the buckets of these tokens.

A task reads texts, keeps one line of each class of a batch and sends its bucket rows as packed arrays, one for each of
many parts of the token domain. In a bucket, each class is compared with the earlier ones by the length filter, the
positional filter and a 128-bit parity sketch (a lower bound of the symmetric difference); its ``keep`` earliest
partners left over go on, and whether there are more. The rows of a bucket of over ``run`` classes are made again as a
table dealt by class, where each meets the ``hubs`` earliest ones only, and counts as having more. Partners are verified on whole
sets. Classes with more that no partner removed are joined with all earlier rows of their buckets, split by a second common token,
and verified likewise: nothing is lost to the bounds, and thousands of near copies give a few pairs each.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm import textkit as K
from ragloom.llm.scratch import KeySet, Scratch, if_small

BUCKETS, BLOCKS = 1 << 20, 64
LINES, CHUNK = 1 << 12, 1 << 20
#: Words that are counted at once.
COUNTED = 1 << 21
#: Packed rows that a task gathers before it sends them.
GATHER = 1 << 18
#: Bytes of bucket rows that a partition is to hold, and parts of the token domain for each partition.
PART_BYTES, PARTS = 32 << 20, 8
_U = np.uint64
_HASH = _U((1 << 44) - 1)


class Limits(NamedTuple):
    """What a task holds of buckets; results do not depend on it."""

    keep: int = 8  # earliest partners of a class in a bucket
    run: int = 1 << 14  # classes of a bucket that are compared with each other in one task
    hubs: int = 1 << 6  # earliest classes of larger buckets, which all others are compared with
    held: int = 1 << 22  # rows before larger buckets are left to the table


def _lines(w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The line of each word as a number from 0 over lines that have words; row and line number of each."""
    feeds = np.flatnonzero(w.data == 10)
    rows = w.rows
    # feeds lie between words: they are counted by the word that follows
    before = np.cumsum(np.bincount(np.searchsorted(w.start, feeds), minlength=len(rows) + 1)[: len(rows)])
    no = before - np.repeat(np.searchsorted(feeds, w.bounds[:-1]), np.diff(w.first))
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (no[1:] != no[:-1])
    return np.cumsum(new) - 1, rows[new], no[new]


def _token_sets(word: np.ndarray, line: np.ndarray, order: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words by line as tokens, where each line's begin, and their whole hashes. With ``order`` (8-bit rarity by bucket) a token is rarity and 44 bits of hash, else 52 bits of hash; ascending, words of one token by hash."""
    n_lines = int(line[-1]) + 1 if len(line) else 0
    t = word >> _U(12) if order is None else (order[(word >> _U(44)).astype(np.int64)].astype(np.uint64) << _U(44)) | (word & _HASH)
    cuts = np.searchsorted(line, np.arange(0, n_lines + LINES, LINES))
    parts = [a + np.argsort(((line[a:z] & (LINES - 1)).astype(np.uint64) << _U(52)) | t[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    if ((t[at[1:]] == t[at[:-1]]) & (line[at[1:]] == line[at[:-1]]) & (word[at[1:]] != word[at[:-1]])).any():
        at = np.lexsort((word, t, line))
    t, line, word = t[at], line[at], word[at]
    new = np.ones(len(t), bool)
    new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
    return t[new], np.searchsorted(line[new], np.arange(n_lines + 1)), word[new]


def _count(batches):
    """The task's word counts."""
    counts, held, size = np.zeros(BUCKETS, np.int64), [], 0
    for b in batches:
        for w in K.words(b.column(1)):
            held.append((w.hash >> _U(44)).astype(np.int32))
            size += len(held[-1])
            if size > COUNTED:
                counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
                held, size = [], 0
    if held:
        counts += np.bincount(np.concatenate(held), minlength=BUCKETS)
    parts = [(k, p.tobytes()) for k, p in enumerate(counts.astype(np.uint32).reshape(BLOCKS, -1)) if p.any()]
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([p for _, p in parts], pa.binary())], ["block", "counts"])


def _rarity(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Eight-bit rarity by bucket, six steps for each doubling of the count, 0 for a count of at most one; and the number of words."""

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(v.as_buffer(), np.uint32).astype(np.int64)
        step = [np.minimum(255, np.floor(6 * np.log2(np.maximum(s, 1)))).astype(np.uint8).tobytes() for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(step, pa.binary()), pa.array([int(s.sum()) for s in sums.values()], pa.int64())], ["block", "steps", "n"])

    out, n = np.zeros((BLOCKS, BUCKETS // BLOCKS), np.uint8), 0
    for r in texts.mapInArrow(_count, "block int, counts binary").repartition("block").mapInArrow(add, "block int, steps binary, n bigint").collect():
        out[r["block"]] = np.frombuffer(r["steps"], np.uint8)
        n += r["n"]
    return out.reshape(-1), n


def _classes(b: pa.RecordBatch, order: np.ndarray):
    """Of a batch of (id, text): its lines (doc, no, two fingerprints of the class), tokens by line, where each line's begin, and for each line the line that is the first of its class here."""
    tokens, hashes, sizes, docs, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ids = b.column(0).to_numpy(zero_copy_only=False)
    for w in K.words(b.column(1)):
        line, row, no = _lines(w)
        t, first, h = _token_sets(w.hash, line, order)
        tokens.append(t)
        hashes.append(h)
        sizes.append(np.diff(first))
        docs.append(ids[row + w.lo])
        numbers.append(no)
    t, h, n, doc, no = (np.concatenate(x) for x in (tokens, hashes, sizes, docs, numbers))
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    fp, other = K.set_hashes(h, first)
    by_class = np.lexsort((no, doc, other, fp))
    new = np.ones(len(fp), bool)
    new[1:] = (fp[by_class[1:]] != fp[by_class[:-1]]) | (other[by_class[1:]] != other[by_class[:-1]])
    heads = np.zeros(len(fp), np.int64)
    heads[by_class] = by_class[new][np.cumsum(new) - 1]
    return doc, no, fp, other, t, first, heads


def _bucket_rows(fp, t, first, heads, num: int, den: int):
    """Own line, position, token, sizes and sketches of the bucket rows of a batch; sketches and buckets tell words apart by 44 bits, which lets more pairs through, never fewer."""
    n = np.diff(first)
    lines = np.unique(heads)
    lines = lines[den * n[lines] >= num * (n[lines] + 1)]  # a smaller set matches none but its equals
    if not len(lines):
        return None
    spread = K.mix(t & _HASH)
    bit, upper = _U(1) << (spread & _U(63)), (spread & _U(64)) > 0
    sketches = [np.bitwise_xor.reduceat(np.where(half, bit, _U(0)), first[:-1]) for half in (~upper, upper)]
    length = n[lines] - -(-num * n[lines] // den) + 1
    own = np.repeat(lines, length)
    at = np.arange(len(own)) - np.repeat(np.cumsum(length) - length, length)
    token = t[first[own] + at]
    some = (token >> _U(44)) > 0  # a word that occurs once is in no other line
    return own[some], at[some], token[some], n, sketches


_FIELDS = ((np.uint64, 8), (np.int64, 8), (np.uint64, 8), (np.uint64, 8), (np.int64, 8), (np.int32, 4), (np.int32, 4), (np.int32, 4))  # token, class, sketches, doc, line, size, position
_CLASS = ((np.int64, 8), (np.int64, 8), (np.int64, 8), (np.int32, 4))  # class by two fingerprints, doc, line
_PLACE = ((np.int64, 8), (np.int64, 8), (np.int32, 4))  # any number, doc, line
ROWS, CLASSES, REMOVED = 0, 1, 2
_PACKED = "part int, kind int, packed binary"


def _pack(kind: int, cols: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Rows dealt to parts by their first column; for each part column by column, and by bytes of the same place, so that bytes that are all zero compress."""
    part = K.mix(cols[0].view(np.uint64)) % _U(parts)
    order = np.argsort(part.astype(np.uint16 if parts <= 1 << 16 else np.int64), kind="stable")
    part, cols = part[order].astype(np.int64), [c[order] for c in cols]
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    ends = np.append(edge[1:], len(part))[: len(edge)]
    places = lambda c: np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes()
    packed = [b"".join(places(c[a:z]) for c in cols) for a, z in zip(edge.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(part[edge].astype(np.int32)), pa.array(np.full(len(edge), kind, np.int32)), pa.array(packed, pa.binary())], ["part", "kind", "packed"])


def _unpack(blob: pa.Scalar, fields) -> list[np.ndarray]:
    raw = blob.as_buffer()
    n, out, at = raw.size // sum(w for _, w in fields), [], 0
    for kind, width in fields:
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).reshape(n))
        at += n * width
    return out


def _dealt(order, num: int, den: int, parts: int):
    def run(batches):
        held: dict[int, list[list[np.ndarray]]] = {ROWS: [], CLASSES: [], REMOVED: []}
        count = 0

        def flush():
            for kind, rows in held.items():
                if rows:
                    yield _pack(kind, [np.concatenate(c) for c in zip(*rows, strict=True)], parts)
                    rows.clear()

        for b in batches:
            doc, no, fp, other, t, first, heads = _classes(b, order.value)
            line, own = no.astype(np.int32), np.unique(heads)
            held[CLASSES].append([fp[own], other[own], doc[own], line[own]])
            later = (doc > doc[heads]) | ((doc == doc[heads]) & (no > no[heads]))
            held[REMOVED].append([fp[later] + doc[later], doc[later], line[later]])
            if (rows := _bucket_rows(fp, t, first, heads, num, den)) is not None:
                own, at, token, n, sketches = rows
                held[ROWS].append([token, fp[own], sketches[0][own], sketches[1][own], doc[own], line[own], n[own].astype(np.int32), at.astype(np.int32)])
                count += len(own)
            if count > GATHER or len(held[CLASSES]) >= 64:
                yield from flush()
                count = 0
        yield from flush()

    return run


def _may_match(na, nb, ia, ib, num: int, den: int):
    """Length and positional filters on arrays of pairs."""
    total = na + nb
    need = -(-num * total // (den + num))
    return (np.minimum(na, nb) * den >= np.maximum(na, nb) * num) & (np.minimum(na - ia, nb - ib) >= need)


_FOUND = "x bigint, y bigint, xd bigint, xl int, yd bigint, token bigint"


def _found(x, y, xd, xl, yd, token) -> pa.RecordBatch:
    """A batch of _FOUND; None is a column of nulls."""
    n = len(xd)
    col = lambda v, kind: pa.nulls(n, kind) if v is None else pa.array(v, kind)
    return pa.RecordBatch.from_arrays([col(x, pa.int64()), col(y, pa.int64()), col(xd, pa.int64()), col(xl, pa.int32()), col(yd, pa.int64()), col(token, pa.int64())], ["x", "y", "xd", "xl", "yd", "token"])


def _least_places(key: np.ndarray, other: np.ndarray, doc: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first place of each different (key, other), and whether a row is later than that of its own."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    head, later = np.ones(len(key), bool), np.zeros(len(key), bool)
    if same.any():
        # rows that share a key with another one are put in order, others are alone
        shared = np.zeros(len(key), bool)
        shared[1:] |= same
        shared[:-1] |= same
        order = np.sort(order[shared])
        order = order[np.lexsort((line[order], doc[order], other[order], key[order]))]
        k, o = key[order], other[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        first = order[new][np.cumsum(new) - 1]
        head[order] = new
        later[order] = (doc[order] > doc[first]) | ((doc[order] == doc[first]) & (line[order] > line[first]))
    return np.flatnonzero(head), later


class _Buckets:
    """The bucket rows that a task holds, and what it finds in them."""

    def __init__(self, num: int, den: int, limits: Limits):
        self.num, self.den, self.limits, self.blobs, self.held, self.most = num, den, limits, [], 0, limits.held
        self.hot = np.zeros(0, np.uint64)

    def add(self, blob: pa.Scalar):
        self.blobs.append(_unpack(blob, _FIELDS))
        self.held += len(self.blobs[-1][0])
        if self.held > self.most:
            yield from self.thin()
            self.most = max(self.most, 2 * self.held)

    def rows(self) -> list[np.ndarray]:
        """One row of each class and bucket, its first place, by bucket and size."""
        cols = [np.concatenate(c) for c in zip(*self.blobs, strict=True)]
        token, fp, sketch, _, doc, line, n, _ = cols
        heads, _ = _least_places(K.mix(token) + fp.view(np.uint64), sketch, doc, line)
        if len(heads) and int(n[heads].max()) < 1 << 12:  # a token has 52 bits
            heads = heads[np.argsort((token[heads] << _U(12)) | n[heads].astype(np.uint64), kind="stable")]
        else:
            heads = heads[np.lexsort((n[heads], token[heads]))]
        return [c[heads] for c in cols]

    def thin(self):
        """One row of each class and bucket; buckets beyond the limit go, their tokens are told."""
        cols = self.rows()
        token = cols[0]
        edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(edge, len(token)))
        hot = (size > self.limits.run) | np.isin(token[edge], self.hot)
        self.hot = np.union1d(self.hot, token[edge[hot]])
        if hot.any():
            yield _found(None, None, np.zeros(hot.sum(), np.int64), None, None, token[edge[hot]].view(np.int64))
        keep = np.repeat(~hot, size)
        self.blobs = [[c[keep] for c in cols]]
        self.held = int(keep.sum())

    def filtered(self, cols, i, j):
        """Of pairs of rows of one bucket, those that may match, the later row first."""
        _, fp, s1, s2, doc, line, n, at = cols
        differ = np.bitwise_count(s1[i] ^ s1[j]).astype(np.int64) + np.bitwise_count(s2[i] ^ s2[j])
        ok = differ * (self.den + self.num) <= (n[i].astype(np.int64) + n[j]) * (self.den - self.num)
        i, j = i[ok], j[ok]
        ok = _may_match(*(x.astype(np.int64) for x in (n[i], n[j], at[i], at[j])), self.num, self.den) & ((doc[i] != doc[j]) | (line[i] != line[j])) & (fp[i] != fp[j])
        i, j = i[ok], j[ok]
        swap = (doc[i] < doc[j]) | ((doc[i] == doc[j]) & (line[i] < line[j]))
        return np.where(swap, j, i), np.where(swap, i, j)

    def told(self, cols, x, y):
        """The earliest partners of each row, and rows that have more, of pairs ordered by the later row and then the earlier one's place."""
        token, fp, _, _, doc, line, _, _ = cols
        nth = np.arange(len(x)) - np.searchsorted(x, x)
        more = x[nth == self.limits.keep]
        x, y = x[nth < self.limits.keep], y[nth < self.limits.keep]
        if len(x):
            yield _found(fp[x], fp[y], doc[x], line[x], doc[y], None)
        if len(more):
            yield _found(fp[more], None, doc[more], line[more], None, token[more].view(np.int64))

    def end(self):
        """Pairs by buckets, some at a time; of a bucket that is not at its end, each row waits with one partner more than it may keep."""
        if not self.blobs:
            return
        yield from self.thin()
        cols = self.blobs[0]
        token, doc, line, n = cols[0], cols[4], cols[5], cols[6].astype(np.int64)
        run = np.cumsum(np.concatenate([[0], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
        key = run * (1 << 32) + n
        width = np.arange(len(token)) - np.searchsorted(key, run * (1 << 32) + -(-n * self.num // self.den))
        total, begin = np.cumsum(width), 0
        x = y = np.zeros(0, np.int64)
        while begin < len(token):
            stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + CHUNK, side="right")))
            i = np.repeat(np.arange(begin, stop), width[begin:stop])
            j = np.arange(len(i)) - np.repeat(np.cumsum(width[begin:stop]) - width[begin:stop], width[begin:stop]) + i - np.repeat(width[begin:stop], width[begin:stop])
            x, y = (np.concatenate(z) for z in zip((x, y), self.filtered(cols, i, j)))
            order = np.lexsort((line[y], doc[y], x))
            x, y = x[order], y[order]
            few = np.arange(len(x)) - np.searchsorted(x, x) <= self.limits.keep
            x, y = x[few], y[few]
            begin = stop
            whole = run[x] < run[stop] if stop < len(token) else np.ones(len(x), bool)
            yield from self.told(cols, x[whole], y[whole])
            x, y = x[~whole], y[~whole]


def _partners(num: int, den: int, limits: Limits):
    """Over packed rows: pairs of classes (x, y) with y earlier, (x, token) where a bucket has more, (token) of buckets left out, and places (xd, xl) that an equal line precedes."""

    def run(batches):
        buckets, classes, held = _Buckets(num, den, limits), [], 0

        def least():
            cols = [np.concatenate(c) for c in zip(*classes, strict=True)]
            heads, later = _least_places(*cols)
            yield _found(None, None, cols[2][later], cols[3][later], None, None)
            classes[:] = [[c[heads] for c in cols]]

        limit = limits.held
        for b in batches:
            for kind, blob in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                if kind == ROWS:
                    yield from buckets.add(blob)
                elif kind == REMOVED:
                    _, doc, line = _unpack(blob, _PLACE)
                    yield _found(None, None, doc, line, None, None)
                else:
                    classes.append(_unpack(blob, _CLASS))
                    held += len(classes[-1][0])
                    if held > limit:
                        yield from least()
                        held = len(classes[0][0])
                        limit = max(limit, 2 * held)
        if classes:
            yield from least()
        yield from buckets.end()

    return run


def _rows_again(order, num: int, den: int, tokens, split: bool):
    """Rows of the buckets of some tokens; with ``split`` by the token and each later one of the prefix that holds two common tokens."""

    def run(batches):
        for b in batches:
            doc, no, fp, _, t, first, heads = _classes(b, order.value)
            rows = _bucket_rows(fp, t, first, heads, num, den)
            if rows is None:
                continue
            own, at, token, n, sketches = rows
            mine = tokens.has(token.view(np.int64))
            own, at, token = own[mine], at[mine], token[mine]
            key, row = token, np.arange(len(own))
            if split:
                least = -(-num * n[own] // den)
                later = np.maximum(np.minimum(n[own], n[own] - least + 2) - at - 1, 0)
                more = np.repeat(row, later)
                second = t[first[own[more]] + at[more] + 1 + np.arange(len(more)) - np.repeat(np.cumsum(later) - later, later)]
                alone = np.flatnonzero(least < 2)
                key, row = np.concatenate([K.mix(token[more] ^ K.mix(second)), K.mix(token[alone])]), np.concatenate([more, alone])
            k = own[row]
            cols = (key.view(np.int64), token[row].view(np.int64), doc[k], no[k].astype(np.int32), fp[k], sketches[0][k].view(np.int64), sketches[1][k].view(np.int64), n[k].astype(np.int32), at[row].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "token", "doc", "line", "fp", "s1", "s2", "n", "at"])

    return run


_AGAIN = "key bigint, token bigint, doc bigint, line int, fp bigint, s1 bigint, s2 bigint, n int, at int"


def _where(fp, doc):
    """A number for a class in a document; of arrays or columns."""
    return fp ^ (doc << 21) if isinstance(fp, np.ndarray) else fp.bitwiseXOR(F.shiftleft(doc, 21))


def _wanted_sets(order, wanted_docs, wanted_lines):
    def run(batches):
        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["id", "text"]).filter(pa.array(wanted_docs.has(b.column(0).to_numpy(zero_copy_only=False))))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in K.words(b.column(1)):
                line, row, _ = _lines(w)
                if not len(line):
                    continue
                _, first, h = _token_sets(w.hash, line, None)
                fp, _ = K.set_hashes(h, first)
                doc = ids[row + w.lo]
                keep = wanted_lines.has(_where(fp, doc))
                size = np.diff(first)
                sets = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[keep])]), pa.int32()), pa.array(h[np.repeat(keep, size)].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(fp[keep]), pa.array(doc[keep]), sets], ["fp", "doc", "h"])

    return run


def removed_lines(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (8, 10), limits: Limits = Limits()) -> DataFrame:
    """(doc, lines array<int>): the numbers, from 0, of the lines to remove in each document that has any."""
    num, den = similarity
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null and text is not null")
    rarity, n_words = _rarity(texts)
    order = spark.sparkContext.broadcast(rarity)
    per_row = sum(w for _, w in _FIELDS)
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_words * (den - num) / den * per_row / PART_BYTES))
    packed = texts.mapInArrow(_dealt(order, num, den, PARTS * partitions), _PACKED)
    found = scratch.save(packed.repartition(partitions, "part").mapInArrow(_partners(num, den, limits), _FOUND))
    scratch.free_shuffles()

    def sets_of(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.explode(F.array(F.struct(F.col("x").alias("fp"), F.col("xd").alias("id")), F.struct(F.col("y").alias("fp"), F.col("yd").alias("id")))).alias("end")).select("end.*")
        wanted, lines = KeySet(ends.select("id").distinct()), KeySet(ends.select(_where(F.col("fp"), F.col("id")).alias("at")).distinct())
        return scratch.save(wanted.narrowed(texts, "id").mapInArrow(_wanted_sets(order, wanted, lines), "fp bigint, doc bigint, h array<bigint>").dropDuplicates(["fp", "doc"]))

    def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs, the later classes of those that match and their first places. A set is known by its fingerprint and document."""
        whole = pairs
        for end in "xy":
            whole = whole.join(sets.select(F.col("fp").alias(end), F.col("doc").alias(f"{end}d"), F.col("h").alias(f"{end}h")), [end, f"{end}d"])
        inter = F.size(F.array_intersect("xh", "yh"))
        hits = whole.filter(den * inter >= num * (F.size("xh") + F.size("yh") - inter))
        return scratch.save(hits.select("x", "xd", "xl").distinct())

    def again(tokens: DataFrame, split: bool) -> DataFrame:
        """One row, with its first place, of each class and bucket of the tokens."""
        made = texts.mapInArrow(_rows_again(order, num, den, KeySet(tokens), split), _AGAIN).join(tokens, "token", "left_semi")
        return scratch.save(made.groupBy("key", "token", "fp", "s1", "s2", "n").agg(F.min(F.struct("doc", "line")).alias("place"), F.first("at").alias("at")))

    def candidates(x: DataFrame, y: DataFrame) -> DataFrame:
        """Pairs of a row of x and an earlier one of y in one bucket that the filters leave."""
        cols = ("fp", "place", "s1", "s2", "n", "at")
        x, y = (rows.select("key", *(F.col(c).alias(f"{end}_{c}") for c in cols)) for end, rows in (("x", x), ("y", y)))
        total = F.col("x_n") + F.col("y_n")
        possible = (
            (F.col("x_place") > F.col("y_place"))
            & (F.least("x_n", "y_n") * den >= F.greatest("x_n", "y_n") * num)
            & ((F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))) * (den + num) >= total * num)
            & ((F.bit_count(F.col("x_s1").bitwiseXOR(F.col("y_s1"))) + F.bit_count(F.col("x_s2").bitwiseXOR(F.col("y_s2")))) * (den + num) <= total * (den - num))
        )
        return x.join(y, "key").filter(possible).select(F.col("x_fp").alias("x"), F.col("y_fp").alias("y"), F.col("x_place.doc").alias("xd"), F.col("x_place.line").alias("xl"), F.col("y_place.doc").alias("yd"))

    later_row = ["x", "xd", "xl"]  # a class by a fingerprint and its first place
    near = found.filter("y is not null").select("x", "y", "xd", "xl", "yd")
    more = found.filter("x is not null and token is not null").select("x", "xd", "xl", "token")
    hot = scratch.save(found.filter("x is null and token is not null").select("token").distinct())
    if hot.limit(1).count():
        rows = again(hot, False)
        salt = F.pmod(F.xxhash64("fp"), F.lit(64))
        hubs = rows
        for by in (("token", salt), ("token",)):
            hubs = hubs.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).filter(F.col("nth") <= limits.hubs).drop("nth")
        nth = F.row_number().over(Window.partitionBy(*later_row).orderBy(F.xxhash64("x", "y")))
        near = near.unionByName(candidates(rows, scratch.save(hubs)).distinct().withColumn("nth", nth).filter(F.col("nth") <= limits.keep).drop("nth"))
        more = more.unionByName(rows.select(F.col("fp").alias("x"), F.col("place.doc").alias("xd"), F.col("place.line").alias("xl"), "token"))
    pairs = scratch.save(near.groupBy(*later_row, "y", "yd").agg(F.count("*").alias("met")))
    sets = sets_of(pairs)
    # of each class the partner that it meets most often; the others only if that one does not match
    likely = pairs.groupBy(*later_row).agg(F.max_by(F.struct("y", "yd"), F.struct("met", "y", "yd")).alias("p")).select(*later_row, "p.*")
    later = verified(likely, sets)
    others = pairs.join(later, later_row, "left_anti").join(likely, [*later_row, "y", "yd"], "left_anti")
    later = later.unionByName(verified(others.drop("met"), sets))
    left = scratch.save(more.distinct().join(later, later_row, "left_anti"))
    if left.limit(1).count():
        rows = again(left.select("token").distinct(), True)
        mine = rows.join(left.withColumnRenamed("x", "fp").withColumn("place", F.struct(F.col("xd").alias("doc"), F.col("xl").alias("line"))), ["fp", "token", "place"], "left_semi")
        pairs = scratch.save(candidates(mine, rows).distinct())
        later = later.unionByName(verified(pairs, sets_of(pairs)))
    gone = found.filter("x is null and token is null").select("xd", "xl").unionByName(later.select("xd", "xl"))
    return gone.groupBy(F.col("xd").alias("doc")).agg(F.array_sort(F.collect_set("xl")).alias("lines"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = (8, 10), counts: tuple[str, str] = ("_n_lines", "_n_removed"), limits: Limits = Limits()) -> DataFrame:
    """docs with the text of each row without its removed lines, and first the two columns ``counts``: lines, and lines removed.

    A line (between line feeds) is removed if an earlier line of the same or another document, by id and line number, has a
    Jaccard similarity of word sets of at least num/den with it, removed or not. Lines without words stay. A document that
    loses all lines stays with an empty text; a null text or id comes back as it is. Rows that repeat an id count as the same place, so
    the one does not remove the other's lines; each row loses the lines found for its id. Other columns pass through under any name, but a column named as
    one of ``counts`` is replaced.
    """
    scratch = Scratch(docs.sparkSession)
    gone = scratch.save(removed_lines(docs, scratch, id_col, text_col, similarity, limits))
    scratch.keep_only(gone)
    free = "_" * (1 + max((len(c) for c in docs.columns), default=0))  # longer than any name of docs
    doc, lines, key, none = (f"{free}{c}" for c in ("doc", "lines", "key", "none"))
    # rows without an id match nothing; they go to many tasks, not to one
    sides = docs.withColumns({key: F.coalesce(F.col(id_col).cast("bigint"), F.xxhash64(text_col)), none: F.col(id_col).isNull()})
    out = sides.join(if_small(gone, F.size("lines")).select(F.col("doc").alias(doc), F.col("lines").alias(lines)), (F.col(key) == F.col(doc)) & ~F.col(none), "left")
    parts = F.split(F.col(text_col), "\n")
    kept = F.filter(parts, lambda x, i: ~F.array_contains(lines, i))
    text = F.when(F.col(lines).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.select(
        F.coalesce(F.size(parts), F.lit(0)).alias(counts[0]), F.coalesce(F.size(lines), F.lit(0)).alias(counts[1]),
        *(text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in counts),
    )

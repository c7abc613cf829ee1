"""Best-fit packing of texts into sequences of several permitted lengths.

Texts are dealt by the hash of their id and place in the table to shards of about ``SHARD`` rows, and each shard is packed for
itself, which costs at most a few part-filled bins a shard. A text longer than the largest length is cut
into pieces of that length and a rest. Pieces go, the longest first, to the open bin with the least
room that holds them. If there is none, a bin of the length with the least cost for each token it is
expected to hold is opened: what the piece and the shorter pieces still to come can fill. At last
each bin shrinks to the shortest length that holds its contents.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragloom.llm import textkit as K
from ragloom.llm.scratch import Scratch

LENGTHS, SHARD = (512, 1024, 2048, 4096), 1 << 15


def cost(length: int) -> float:
    """Of a sequence: one a token, eight for its ends, and attention's share, which grows with the square."""
    return length + 8 + length * length / 65536


def best_fit(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = cost) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each piece and the length of each bin; sizes are from 1 to max(lengths). Equal sizes go in their order."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    per_size = np.bincount(np.asarray(sizes, np.int64), minlength=lengths[-1] + 1) if len(sizes) else np.zeros(lengths[-1] + 1, np.int64)
    volume = np.cumsum(per_size * np.arange(len(per_size))).tolist()
    left = per_size.tolist()
    rooms: list[int] = []  # the different rooms of open bins, ascending
    by_room: dict[int, list[int]] = {}
    used: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    room_of: list[int] = []
    for i in order:
        size = sizes[i]
        left[size] -= 1
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
        else:
            def rate(length: int) -> float:
                room = length - size
                coming = volume[room] if room < size else volume[size - 1] + left[size] * size
                return cost(length) / (size + min(room, coming))

            b, room = len(used), min((x for x in lengths if x >= size), key=lambda x: (rate(x), x))
            used.append(0)
            room_of.append(room)
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        room -= size
        if room:
            if room not in by_room:
                insort(rooms, room)
                by_room[room] = []
            by_room[room].append(b)
    return bins, offsets, [lengths[bisect_left(lengths, u)] for u in used]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n): the words of each row's whole text, 0 for a null one."""

    def run(batches):
        for b in batches:
            n = np.zeros(b.num_rows, np.int64)
            for w in K.words(b.column(1)):
                n[w.lo : w.hi] = np.diff(w.first)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], ["id", "n"])

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")).mapInArrow(run, "id bigint, n bigint")


def packed(sized: DataFrame, lengths: Sequence[int] = LENGTHS, cost: Callable[[int], float] = cost, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, bin_offset, bin_length) from rows (id, n): where each piece of each row lies.

    start is the piece's first token in its text. A row of no tokens comes back as a piece of length 0 without a bin. Ids may
    be null or repeat: every row is packed. An empty table gives no rows. bin_id is shard * 2**32 + number.
    """
    most = max(lengths)
    shards = max(1, math.ceil(sized.count() / shard))
    dealt = sized.select("id", "n", F.pmod(F.xxhash64("id", "n", F.monotonically_increasing_id()), F.lit(shards)).alias("shard"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "id"], ascending=[False, True], kind="stable")
        n = rows["n"].to_numpy(np.int64)
        pieces = np.maximum(-(-n // most), 1)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[row] - piece * most, most)
        some = size > 0
        bins, offsets, kinds = best_fit(size[some].tolist(), lengths, cost)
        out = pd.DataFrame({"doc_id": rows["id"].astype("Int64").to_numpy()[row], "piece": piece.astype(np.int32), "start": piece * most, "length": size})
        for name, values in (("bin_id", np.array(bins, np.int64) + (int(rows["shard"].iloc[0]) << 32)), ("bin_offset", np.array(offsets, np.int64)), ("bin_length", np.array(kinds, np.int64)[bins] if bins else np.zeros(0, np.int64))):
            full = pd.array([pd.NA] * len(row), "Int64")
            full[some] = values
            out[name] = full
        return out

    schema = "doc_id bigint, piece int, start bigint, length bigint, bin_id bigint, bin_offset bigint, bin_length bigint"
    return dealt.groupBy("shard").applyInPandas(one, schema)


def packed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """``packed`` with words as tokens."""
    return packed(Scratch(docs.sparkSession).save(word_counts(docs, id_col, text_col)), lengths)

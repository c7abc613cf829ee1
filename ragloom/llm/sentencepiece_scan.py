"""SentencePiece encoding and decoding by a max-plus scan over chunks.

A text is a lattice of vocabulary pieces. The given model is a byte-pair one, whose encoding is the only
path on which each two adjacent pieces are what the merges make of their joined text; so a path weighs 0
and an incompatible pair minus infinity, and the best path in max-plus algebra is the encoding.

A state at a chunk's border is the piece that ends at or reaches over it. A chunk's transfer matrix says which
state at its end each state at its start leads to (the entries that are not minus infinity). Products of
matrices are associative, so a document's matrices are multiplied in runs of ``FAN``, the products again in runs
of ``FAN``, and so on until one is left; the states at the ends of each run are then chosen level by level downward,
and each chunk is backtraced for itself between its two states. A task holds ``FAN`` matrices at once, however
long a document is.

No piece reaches over the start of a word, so only the first and last part of a chunk depend on its states, and a
word within a chunk has one path: the merges themselves find it for words up to ``SHORT`` characters, which are kept by
word, and the lattice for longer ones, as its time grows with the length alone. Texts up to ``CHUNK`` characters are one chunk.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ragloom.llm.scratch import Scratch, if_small

#: Characters of a chunk; words and pairs of pieces that a worker keeps (some 75 and 20 MB).
CHUNK, CACHE, PAIRS = 1 << 14, 1 << 18, 1 << 16
#: Matrices that one task multiplies at once; characters of the longest word that is merged step by step and kept.
FAN, SHORT = 64, 48
SPACE = "▁"
_PARTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class WordIds(dict):
    """Ids by word, at most ``CACHE`` of them and none of long words; words not met among the last ones go."""

    def __init__(self, ids_of):
        self.ids_of, self.older = ids_of, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.older.get(word)
        if ids is None:
            ids = tuple(self.ids_of(word))
        if len(word) <= SHORT:
            if len(self) >= CACHE // 2:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class PieceModel:
    """Pieces, ranks and byte pieces of a SentencePiece byte-pair model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(self.pieces)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in special if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.raw = pa.array([bytes([self.byte_of[i]]) if i in self.byte_of else p.encode() for i, p in enumerate(self.pieces)], pa.binary())
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.rank = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.longest = max(map(len, self.ids))
        self.starts = {p[:k] for p in self.ids for k in range(1, len(p) + 1)}
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.fits = lru_cache(PAIRS)(self._fits)
        self.word_ids = WordIds(lambda word: self.to_ids(self.word(word)))

    def _merged(self, text: str) -> list[str]:
        parts, none = list(text), float("inf")
        ranks = [self.rank.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (low := min(ranks)) < none:
            at = ranks.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.rank.get(parts[at - 1] + parts[at], none)
            if at < len(ranks):
                ranks[at] = self.rank.get(parts[at] + parts[at + 1], none)
        return parts

    def _fits(self, left: str, right: str) -> bool:
        """Whether the merges keep two adjacent pieces as they are; left is empty at the start of a text."""
        return self._merged(left + right) == ([left, right] if left else [right])

    def reached(self, text: str, at: int, piece: str, end: int) -> dict[int, tuple[int, str, int]]:
        """From a piece that ends at ``at``: for each end of a piece that starts before ``end``, (start, piece, end of the piece before)."""
        last: dict[int, list[tuple[int, str]]] = {at: [(at - len(piece), piece)]}
        for i in range(at, end):
            for _, before in last.get(i, ()):
                for j in range(i + 1, min(len(text), i + self.longest) + 1):
                    p = text[i:j]
                    if j > i + 1 and p not in self.starts:
                        break
                    # from one piece on, at most one piece ends at a place
                    if j not in last and (j == i + 1 or p in self.ids) and self.fits(before, p):
                        last.setdefault(j, []).append((i, p))
        return last

    def path(self, last: dict, start: int, end: int, piece: str | None = None) -> list[str]:
        """The pieces from start to end, the last being ``piece`` if given; an error if no path leads there."""
        out, at, right = [], end, None
        while at > start:
            step = next(((i, p) for i, p in last.get(at, ()) if (right is None and piece in (None, p) or right is not None and self.fits(p, right)) and i >= start), None)
            if step is None:
                break
            out.append(step[1])
            at, right = step
        if at != start:
            raise ValueError("no path of pieces between two states")
        return out[::-1]

    def lattice(self, text: str) -> list[str]:
        """The pieces of a whole text by its lattice."""
        return self.path(self.reached(text, 0, "", len(text)), 0, len(text))

    def word(self, text: str) -> list[str]:
        return self._merged(text) if len(text) <= SHORT else self.lattice(text)

    def cuts(self, text: str, start: int, end: int) -> list[int]:
        """Word starts in [start, end]: where a space mark follows another character."""
        if not self.words_apart:
            return []
        out, at = [], text.find(SPACE, max(start, 1), end + 1)
        while at >= 0:
            if text[at - 1] != SPACE:
                out.append(at)
            at = text.find(SPACE, at + 1, end + 1)
        return out

    def entries(self, text: str, at: int) -> list[tuple[int, str]]:
        """Every piece that may end at or reach over ``at``, as (end, piece)."""
        out = []
        for s in range(max(0, at - self.longest), at):
            out += [(e, text[s:e]) for e in range(max(at, s + 1), min(len(text), s + self.longest) + 1) if e == s + 1 or text[s:e] in self.ids]
        return out

    def transfer(self, text: str, start: int, end: int) -> list[tuple[int, str, int, str]]:
        """Entries of the chunk's matrix: (end and piece at its start, end and piece at its end), ends in the text given."""
        cuts = self.cuts(text, start, end)
        before = self.entries(text, start) if start else [(0, "")]
        exits = lambda last: [(e, p) for e, steps in last.items() if e >= end for s, p in steps if s < end]
        if not cuts:
            return [(e, p, *x) for e, p in before for x in (exits(self.reached(text, e, p, end)) if e < end else [(e, p)])]
        good = [(e, p) for e, p in before if e == cuts[0] or (e < cuts[0] and cuts[0] in self.reached(text[: cuts[0]], e, p, cuts[0]))]
        after = exits(self.reached(text, cuts[-1], "", end)) if cuts[-1] < end else [(end, "")]
        return [(*g, *x) for g in good for x in after]

    def between(self, text: str, entry: tuple[int, str], end: int, leave: tuple[int, str]) -> list[int]:
        """Ids of one chunk from its entry state to its exit state, by backtracing."""
        cuts = self.cuts(text, entry[0], end)
        if not cuts:
            return self.to_ids(self.path(self.reached(text, *entry, end), entry[0], leave[0], leave[1])) if leave[0] > entry[0] else []
        out = self.to_ids(self.path(self.reached(text[: cuts[0]], *entry, cuts[0]), entry[0], cuts[0]))
        for a, z in zip(cuts, cuts[1:], strict=False):
            out += self.word_ids[text[a:z]]
        if leave[0] > cuts[-1]:
            out += self.to_ids(self.path(self.reached(text, cuts[-1], "", end), cuts[-1], leave[0], leave[1] or None))
        return out

    def to_ids(self, pieces: Iterable[str]) -> list[int]:
        """Ids; a character without a piece is its bytes, or the unknown id without byte pieces."""
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out.extend([i] if i is not None else [self.bytes[b] for b in p.encode()] if self.bytes else [self.unknown])
        return out

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        out: list[int] = []
        for word in _PARTS.findall(text) if self.words_apart else [text]:
            out += self.word_ids[word]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids of one whole encoding."""
        raw = b"".join(bytes([self.byte_of[i]]) if i in self.byte_of else self.pieces[i].encode() for i in ids)
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


_MATRIX = "array<struct<a:int,p:string,b:int,q:string>>"
_ENTRIES = pa.list_(pa.struct([("a", pa.int32()), ("p", pa.string()), ("b", pa.int32()), ("q", pa.string())]))


class Transfer:
    """The finite entries of a matrix: the states at its end that each state at its start leads to."""

    def __init__(self, entries: list[dict]):
        self.exits: dict[tuple, set[tuple]] = {}
        self.at: dict[int, list[tuple]] = {}
        for x in entries:
            start = (x["a"], x["p"])
            if start not in self.exits:
                self.exits[start] = set()
                self.at.setdefault(x["a"], []).append(start)
            self.exits[start].add((x["b"], x["q"]))

    def starts(self, state: tuple) -> list[tuple]:
        """Where a state at the end of the matrix before goes on; a state without a piece stands for any that ends at a word's start."""
        return self.at.get(state[0], []) if state[1] == "" else [state] if state in self.exits else []

    def after(self, states: Iterable[tuple]) -> set[tuple]:
        return {start for s in states for start in self.starts(s)}

    def leaves(self, starts: Iterable[tuple]) -> set[tuple]:
        return set().union(*(self.exits[s] for s in starts))


def product(ms: list[Transfer]) -> list[dict]:
    """The entries of the max-plus product of adjacent matrices."""
    found = ms[0].exits
    for m in ms[1:]:
        step = {s: m.leaves(m.starts(s)) for s in set().union(*found.values())}
        found = {start: ends for start, states in found.items() if (ends := set().union(*(step[s] for s in states)))}
    return [{"a": a, "p": p, "b": b, "q": q} for (a, p), ends in found.items() for b, q in ends]


def choose(ms: list[Transfer], entry: tuple, leave: tuple) -> list[tuple[tuple, tuple]]:
    """Entry and exit state of each of adjacent matrices on the path from entry to leave; an error if there is none."""
    alive = [{entry} & ms[0].exits.keys()]
    for before, m in zip(ms, ms[1:], strict=False):
        alive.append(m.after(before.leaves(alive[-1])))
    out, now = [], leave
    for k in range(len(ms) - 1, -1, -1):
        start = min((s for s in alive[k] if now in ms[k].exits[s]), default=None)
        if start is None:
            raise ValueError("no path of pieces through a document's chunks")
        out.append((start, now))
        if k:
            now = start if start in ms[k - 1].leaves(alive[k - 1]) else (start[0], "")
    return out[::-1]


def _scan(table: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, part, a, p, b, q): the states at both ends of each part of a row's path, of matrices (row, part, m).

    Upward, runs of ``FAN`` matrices become their product, until a row has one; downward, the states of a run's ends give those within.
    """
    up = F.shiftright("part", FAN.bit_length() - 1)
    levels = [scratch.save(table)]
    most = levels[0].agg(F.max("part")).first()[0] or 0

    def multiplied(run: pa.Table) -> pa.Table:
        rows = sorted(run.to_pylist(), key=lambda r: r["part"])
        out = product([Transfer(r["m"]) for r in rows])
        return pa.table({"row": [rows[0]["row"]], "part": pa.array([rows[0]["up"]], pa.int32()), "m": pa.array([out], _ENTRIES)})

    while most:
        levels.append(scratch.save(levels[-1].withColumn("up", up).groupBy("row", "up").applyInArrow(multiplied, f"row bigint, part int, m {_MATRIX}")))
        most //= FAN

    # a row begins at a word's start and ends with a piece that ends with it
    whole = F.get(F.filter("m", lambda x: (x["a"] == 0) & (x["p"] == "") & (x["b"] == 0)), 0)
    ends = levels[-1].withColumn("x", whole).select("row", "part", F.lit(0).alias("a"), F.lit("").alias("p"), F.lit(0).alias("b"), F.col("x.q").alias("q"))

    def told(run: pa.Table) -> pa.Table:
        rows = sorted(run.to_pylist(), key=lambda r: r["part"])
        r = rows[0]
        path = choose([Transfer(x["m"]) for x in rows], (r["a"], r["p"]), (r["b"], r["q"]))
        (a, p), (b, q) = (zip(*states, strict=True) for states in zip(*path, strict=True))
        ints = lambda values: pa.array(values, pa.int32())
        return pa.table({"row": [x["row"] for x in rows], "part": ints([x["part"] for x in rows]), "a": ints(a), "p": pa.array(p, pa.string()), "b": ints(b), "q": pa.array(q, pa.string())})

    for level in reversed(levels[:-1]):
        run = level.withColumn("up", up).join(ends.withColumnRenamed("part", "up"), ["row", "up"])
        ends = run.groupBy("row", "up").applyInArrow(told, "row bigint, part int, a int, p string, b int, q string")
    return ends


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = DEFAULT_MODEL, chunk: int = CHUNK) -> DataFrame:
    """(id, row, part, ids array<int>): the piece ids of every whole text in parts by number; a text up to ``chunk`` characters is part 0.

    row names the text that a part is of, and is null for texts of one part. Parts of longer texts are a written table.

    Null and empty texts have part 0 with no ids. Repeated rows come back as often. A text with a space mark of its own is encoded
    as if it were a space. The model file must be at that path on the executors.
    """
    kind = docs.select(F.col(id_col)).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    short = rows.filter(F.char_length("text") <= chunk)

    def whole(batches):
        m = model_of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([0] * b.num_rows, pa.int32()), pa.array([m.encode(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["id", "part", "ids"])

    out = short.mapInArrow(whole, f"id {kind}, part int, ids array<int>").select("id", F.lit(None).cast("bigint").alias("row"), "part", "ids")
    scratch = Scratch(docs.sparkSession)
    longest = model_of(model).longest
    marked = rows.filter(F.char_length("text") > chunk).select("id", F.monotonically_increasing_id().alias("row"), F.concat(F.lit(SPACE), F.replace("text", F.lit(" "), F.lit(SPACE))).alias("t"))
    size = F.char_length("t")
    parts = marked.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((size - 1) / chunk).cast("int")))).select(
        "id", "row", "part", F.least(F.col("part") * chunk, F.lit(2 * longest)).alias("start"), F.least(F.lit(chunk), size - F.col("part") * chunk).alias("length"),
        F.substring("t", F.greatest(F.col("part") * chunk - 2 * longest, F.lit(0)) + 1, F.lit(chunk + 4 * longest)).alias("t"),
    )
    parts = scratch.save(parts)

    def matrices(batches):
        m = model_of(model)
        for b in batches:
            out = []
            for t, start, length in zip(*(b.column(c).to_pylist() for c in ("t", "start", "length")), strict=True):
                # states by their end relative to the border, so that neighbours name them alike
                out.append([{"a": e - start, "p": p, "b": x - start - length, "q": q} for e, p, x, q in m.transfer(t, start, start + length)])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("part"), pa.array(out, _ENTRIES)], ["row", "part", "m"])

    table = parts.mapInArrow(matrices, f"row bigint, part int, m {_MATRIX}")
    chosen = _scan(table, scratch)
    both = parts.join(if_small(scratch.save(chosen)), ["row", "part"]).select("id", "row", "part", "t", "start", "length", "a", "p", "b", "q")

    def backtraced(batches):
        m = model_of(model)
        for b in batches:
            ids = [
                m.between(r["t"], (r["start"] + r["a"], r["p"]), r["start"] + r["length"], (r["start"] + r["length"] + r["b"], r["q"]))
                for r in b.select(["t", "start", "length", "a", "p", "b", "q"]).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), b.column("part"), pa.array(ids, pa.list_(pa.int32()))], ["id", "row", "part", "ids"])

    linked = scratch.save(both.mapInArrow(backtraced, f"id {kind}, row bigint, part int, ids array<int>"))
    scratch.keep_only(linked)
    return out.unionByName(linked)


def decoded(parts: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """(id, row, part, ids, text) of parts (id, row, part, ids), of which those with a row are read twice: the texts of a row's parts, joined by number, are the text of all its ids.

    A part is decoded for itself. Bytes that end a part amid a character go to the next part with ids, and only a row's first part
    with ids loses a leading space. A part with a null row is a whole text.
    """
    kind = dict(parts.dtypes)["id"]
    parts = parts.select("id", "row", "part", "ids")
    order = Window.partitionBy("row").orderBy("part")
    # a character has four bytes, so three before a part decide on what it begins with
    tails = parts.filter("row is not null and size(ids) > 0").select("row", "part", F.slice("ids", F.greatest(F.size("ids") - 2, F.lit(1)), 3).alias("tail"))
    borders = tails.select("row", "part", F.flatten(F.collect_list("tail").over(order.rowsBetween(-3, -1))).alias("before"), F.lead("part").over(order).isNull().alias("ends"))
    borders = if_small(Scratch(parts.sparkSession).save(borders), F.size("before"))
    single = parts.filter("row is null").withColumn("before", F.array().cast("array<int>")).withColumn("ends", F.lit(True))
    linked = parts.filter("row is not null").join(borders, ["row", "part"], "left").select("id", "row", "part", "ids", "before", "ends")

    def run(batches):
        m = model_of(model)
        for b in batches:
            raw, before = (_joined(b.column(c), m.raw) for c in ("ids", "before"))
            text = [_text(x, y, z) for x, y, z in zip(raw, before, b.column("ends").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "row", "part", "ids")), pa.array(text, pa.string())], ["id", "row", "part", "ids", "text"])

    return single.unionByName(linked).mapInArrow(run, f"id {kind}, row bigint, part int, ids array<int>, text string")


def _joined(ids: pa.Array, raw: pa.Array) -> list[bytes]:
    """The bytes of each list of ids; none for a null."""
    sizes = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, raw.take(pc.list_flatten(ids))), b"").to_pylist()


def _text(raw: bytes, before: bytes, ends: bool | None) -> str:
    """Text of a part's bytes after the last bytes before it; what is amid a character at the end is left to the next part."""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    if before:
        decoder.decode(before[max(0, len(before) - 3) :])
    text = decoder.decode(raw, bool(ends)).replace(SPACE, " ")
    return text[1:] if not before and text.startswith(" ") else text

"""N-gram Jaccard join by PartEnum signatures.

A document's features are its distinct word shingles. Sets of similar size form a band; a band's
instance knows the largest Hamming distance k that two of its sets can have at the wanted Jaccard
similarity. It deals the feature domain to ``groups`` parts, each of three sub-parts, and a set's
signatures are, for each group, the three choices of two sub-parts. Two sets with at most k
differences have at most one in ``slack + 1`` groups at least, and share a signature there.

Signatures over few features would be frequent. A set leaves out those over fewer than t, the largest t
up to ``TINY`` for which at most ``slack`` of its groups have one. Of two linked sets, let t be the larger of their two:
one of the ``slack + 1`` agreeing groups has no signature under t in its set, so the one that they share there
has t features or more and both keep it.

Equal sets, by two fingerprints of 64 bits, are one node. Nodes that share a signature are candidates, in steps, so that a large group
of near copies gives a few pairs a node: for a few rounds each node against the first node of each of its
buckets, in an order that changes each round, if it is in another component, and the first node then leaves the bucket; at last, of each bucket, all pairs that are
still in different components. Buckets with the same members count once.
A pair whose size or parity sketch (a lower bound of the Hamming distance) rules the link out is not
verified; all others are, on their whole sets.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ragloom.llm import textkit as K
from ragloom.llm.scratch import SMALL, KeySet, Scratch, components

TINY = 3
SKETCH_WORDS = 16
HUB_ROUNDS = 3


@lru_cache(maxsize=8)
def instances(num: int, den: int, largest: int) -> list[tuple[int, int, int, int]]:
    """(low, high, groups, slack) of each instance: two sets with 0 < num/den * larger <= smaller share one that holds both sizes."""
    # at a low similarity groups hold few features: narrower bands and more slack keep tiny signatures out
    power, part = (3, 16) if 10 * num >= 9 * den else (2, 8)
    out, low = [], 1
    while low <= largest:
        high = max(low, low * den**power // num**power)
        while -(-num * (high + 1) // den) <= low:
            high += 1
        k = 2 * high * (den - num) // (den + num)
        groups = -(-(k + 1) // 2) if k else 0
        slack = groups // part
        out.append((low, high, groups + slack, slack))
        low = -(-num * (high + 1) // den)
    return out


def _sets(w: K.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, their row, and where each row's begin."""
    sh, bound = K.shingles(w, n)
    row = np.repeat(np.arange(len(bound) - 1), np.diff(bound))
    order = np.lexsort((sh, row))
    sh, row = sh[order], row[order]
    keep = np.ones(len(sh), bool)
    keep[1:] = (sh[1:] != sh[:-1]) | (row[1:] != row[:-1])
    sh, row = sh[keep], row[keep]
    return sh, row, np.searchsorted(row, np.arange(len(bound)))


class Nodes:
    """Names sets by 64-bit fingerprints; where two different sets share one, as their second fingerprints tell, all sets with it go by the second."""

    def __init__(self, bits: int = 64, shared: np.ndarray | None = None):
        self.drop, self.shared = np.int64(64 - bits), shared

    def both(self, sh: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fp, other = K.set_hashes(sh, first)
        return fp >> self.drop, other

    def names(self, sh: np.ndarray, first: np.ndarray) -> np.ndarray:
        fp, other = self.both(sh, first)
        return fp if self.shared is None or not len(self.shared) else np.where(np.isin(fp, self.shared), other, fp)


def _signatures(sh: np.ndarray, row: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and the row of each."""
    size = np.diff(first)
    table = instances(num, den, int(size.max()) if len(size) else 0)
    low, high = np.array([x[0] for x in table]), np.array([x[1] for x in table])
    out, owner = [], []
    newest = np.searchsorted(low, size, side="right") - 1
    for back in range(int((newest - np.searchsorted(high, size)).max(initial=-1)) + 1):
        inst = newest - back
        has = (size > 0) & (inst >= 0)
        has[has] = high[inst[has]] >= size[has]
        groups = np.where(has, np.array([x[2] for x in table])[inst], 0)
        slack = np.where(has, np.array([x[3] for x in table])[inst], 0)
        base = np.concatenate([[0], np.cumsum(groups * 3)])
        own = groups[row] > 0
        h, r = sh[own], row[own]
        if not len(h):
            continue
        spread = K.mix(h + np.uint64(0x632BE59BD9B4E019) * (inst[r] + 1).astype(np.uint64))
        part = base[r] + ((spread >> np.uint64(32)) * (groups[r] * 3).astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        counts = np.bincount(part, minlength=base[-1])
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(spread[np.argsort(part, kind="stable")], out=sums[1:])
        edge = np.concatenate([[0], np.cumsum(counts)])
        sums, counts = (sums[edge[1:]] - sums[edge[:-1]]).reshape(-1, 3), counts.reshape(-1, 3)
        g_row = np.repeat(np.arange(len(size)), groups)
        g_no = np.arange(len(g_row)) - base[g_row] // 3
        with_two = counts.sum(1, keepdims=True) - counts
        tag = (inst[g_row].astype(np.uint64) << np.uint64(40)) + (g_no.astype(np.uint64) << np.uint64(2))
        sig = K.mix(sums.sum(1, keepdims=True, dtype=np.uint64) - sums + K.mix(tag[:, None] + np.arange(3, dtype=np.uint64)))
        fewest, least = with_two.min(1), np.zeros(len(size), np.int64)
        for t in range(1, TINY + 1):
            least[np.bincount(g_row[fewest < t], minlength=len(size)) <= slack] = t
        keep = with_two >= least[g_row][:, None]
        out.append(sig[keep].view(np.int64))
        owner.append(np.broadcast_to(g_row[:, None], keep.shape)[keep])
    return (np.concatenate(out), np.concatenate(owner)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


SKETCH = [f"p{i}" for i in range(SKETCH_WORDS)]


def _ident(n: int, nodes: Nodes):
    def run(batches):
        for b in batches:
            (fp, other, size), sketch = np.zeros((3, b.num_rows), np.int64), np.zeros((b.num_rows, SKETCH_WORDS), np.int64)
            for w in K.words(b.column(1)):
                sh, _, first = _sets(w, n)
                (fp[w.lo : w.hi], other[w.lo : w.hi]), size[w.lo : w.hi] = nodes.both(sh, first), np.diff(first)
                for k, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    sketch[w.lo + k] = K.parity(sh[a:z], SKETCH_WORDS * 64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fp), pa.array(other), pa.array(size), *(pa.array(np.ascontiguousarray(c)) for c in sketch.T)], ["id", "key", "fp", "other", "n", *SKETCH])

    return run


def _signed(n: int, num: int, den: int, nodes: Nodes):
    def run(batches):
        for b in batches:
            done: set[int] = set()  # equal sets of a batch are signed once
            for w in K.words(b.column(1)):
                sh, row, first = _sets(w, n)
                fp = nodes.names(sh, first)
                new = np.zeros(len(fp), bool)
                for r, f in enumerate(fp.tolist()):
                    if f not in done:
                        done.add(f)
                        new[r] = True
                keep = new[row]
                sh, row = sh[keep], row[keep]
                sig, owner = _signatures(sh, row, np.searchsorted(row, np.arange(len(fp) + 1)), num, den)
                if len(sig):
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(fp[owner])], ["sig", "fp"])

    return run


def _wide_bits(n: int) -> int:
    """Parities of a wide sketch: a power of two, four for each element; that of sets that may link differs by one step at most."""
    return 1 << max(10, (4 * n - 1).bit_length())


def _wanted_sets(n: int, wanted: KeySet, nodes: Nodes):
    def run(batches):
        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["id", "text"]).filter(pa.array(wanted.has(b.column(0).to_numpy(zero_copy_only=False))))
            for w in K.words(b.column(1)):
                sh, _, first = _sets(w, n)
                h = pa.LargeListArray.from_arrays(pa.array(first, pa.int64()), pa.array(sh.view(np.int64))).cast(pa.list_(pa.int64()))
                wide = pa.array([K.parity(sh[a:z], _wide_bits(int(z - a))) for a, z in zip(first[:-1], first[1:], strict=True)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes.names(sh, first)), wide, h], ["fp", "wide", "h"])

    return run


def _linked(num: int, den: int, inter: Column) -> Column:
    return F.lit(den) * inter >= F.lit(num) * (F.col("a_n") + F.col("b_n") - inter)


def _possible(num: int, den: int) -> Column:
    """What size and parity sketch leave possible."""
    differ = sum((F.bit_count(F.col(f"a_p{i}").bitwiseXOR(F.col(f"b_p{i}"))) for i in range(1, SKETCH_WORDS)), F.bit_count(F.col("a_p0").bitwiseXOR(F.col("b_p0"))))
    return (
        (F.least("a_n", "b_n") * den >= F.greatest("a_n", "b_n") * num)
        & (differ * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num))
    )


def _side(sets: DataFrame, key: str, *columns: str) -> DataFrame:
    return sets.select(F.col("fp").alias(key), *(F.col(c).alias(f"{key}_{c}") for c in columns))


def _wide_difference(a: Column, b: Column) -> Column:
    """Differing parities of two wide sketches, the wider folded to the other's width."""
    fold = lambda x: F.zip_with(F.slice(x, F.lit(1), (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    x, y = F.when(F.size(a) > F.size(b), fold(a)).otherwise(a), F.when(F.size(b) > F.size(a), fold(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, k: s + k)


def _near(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b), those that both sketches leave possible, with a_n, b_n and the differing parities."""
    maybe = pairs.join(_side(sketches, "a", "n", *SKETCH), "a").join(_side(sketches, "b", "n", *SKETCH), "b").filter(_possible(num, den)).select("a", "b", "a_n", "b_n")
    wide = maybe.join(_side(sets, "a", "wide"), "a").join(_side(sets, "b", "wide"), "b").withColumn("differ", _wide_difference(F.col("a_wide"), F.col("b_wide")))
    return wide.filter(F.col("differ") * (den + num) <= (F.col("a_n") + F.col("b_n")) * (den - num)).select("a", "b", "a_n", "b_n", "differ")


def _verified(near: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b, a_n, b_n), those that link by their whole sets, as edges."""
    whole = near.select("a", "b", "a_n", "b_n").join(_side(sets, "a", "h"), "a").join(_side(sets, "b", "h"), "b")
    return whole.filter(_linked(num, den, F.size(F.array_intersect("a_h", "b_h")))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _across(near: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components, with a_comp and b_comp."""
    a, b = (comp.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp")) for end in "ab")
    return near.join(a, "a").join(b, "b").filter("a_comp != b_comp")


def _paired(rows: DataFrame, end: str, *columns: str) -> DataFrame:
    """Rows of buckets as one end of pairs; an end keeps its own name for the bucket so that it can meet itself."""
    return rows.select(F.col("sig").alias(f"{end}_sig"), F.col("fp").alias(end), *(F.col(c).alias(f"{end}_{c}") for c in columns))


def _open_buckets(shared: DataFrame, comp: DataFrame) -> DataFrame:
    """(sig, fp, comp) of the buckets whose nodes are in different components, one bucket of those with the same members."""
    placed = shared.select("sig", "fp").join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("sig", "fp", F.coalesce("comp", "fp").alias("comp"))
    members = placed.groupBy("sig").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("k"),
        F.bit_xor(F.xxhash64("fp")).alias("x"), F.bit_xor(F.xxhash64("fp", F.lit(1))).alias("y"),
    ).filter("lo != hi")
    return placed.join(members.groupBy("k", "x", "y").agg(F.min("sig").alias("sig")).select("sig"), "sig", "left_semi")


def _hub_pairs(open_: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """(a, b), a < b: each node with the first node of another component in each of its buckets; and (sig, fp) of the buckets without their first nodes, which have then met all others. The order is by a hash that differs each turn."""
    order = F.xxhash64("fp", F.lit(turn))
    head = open_.groupBy("sig").agg(F.min(F.struct(order.alias("order"), "fp", "comp")).alias("head"))
    seen = open_.join(head, "sig")
    other = seen.filter(F.col("comp") != F.col("head.comp")).groupBy("sig").agg(F.min_by("fp", order).alias("other"))
    hub = F.when(F.col("comp") != F.col("head.comp"), F.col("head.fp")).otherwise(F.col("other"))
    met = seen.join(other, "sig").select(F.least("fp", hub).alias("a"), F.greatest("fp", hub).alias("b")).distinct()
    return met, seen.filter(F.col("fp") != F.col("head.fp")).select("sig", "fp")


def _merged(scratch: Scratch, comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after links (u, v): only links between different components go on, one of each pair of them."""
    u, v = (comp.select(F.col("node").alias(end), F.col("comp").alias(f"c{end}")) for end in "uv")
    across = links.join(u, "u").join(v, "v").select(F.least("cu", "cv").alias("u"), F.greatest("cu", "cv").alias("v")).distinct()
    up = components(scratch, across).select(F.col("node").alias("comp"), F.col("comp").alias("up"))
    return scratch.save(comp.join(up, "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")))


def text_key(text_col: str = "text") -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.col(text_col).cast("string"))


def _named(scratch: Scratch, keyed: DataFrame, shingle: int, bits: int) -> tuple[Nodes, DataFrame]:
    """Names of sets, and (id, key, fp, n, sketches) of every row of (id, text, key)."""
    ident = scratch.save(keyed.mapInArrow(_ident(shingle, Nodes(bits)), "id bigint, key bigint, fp bigint, other bigint, n bigint, " + ", ".join(f"{p} bigint" for p in SKETCH)))
    # of a million million sets some tens of thousands share a fingerprint
    twice = scratch.save(ident.filter("n > 0").groupBy("fp").agg(F.min("other").alias("a"), F.max("other").alias("b")).filter("a != b").select("fp"))
    n = twice.count()
    if n > SMALL:
        raise ValueError(f"{n} fingerprints are shared")
    if n:
        ident = ident.join(F.broadcast(twice.withColumnRenamed("fp", "shared")), F.col("fp") == F.col("shared"), "left")
        ident = scratch.save(ident.withColumn("fp", F.when(F.col("shared").isNull(), F.col("fp")).otherwise(F.col("other"))).drop("shared"))
    return Nodes(bits, np.sort(twice.toPandas()["fp"].to_numpy(np.int64))), ident.drop("other")


def _joined(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int], bits: int = 64) -> tuple[Scratch, DataFrame, DataFrame]:
    """Scratch, (id, key, fp, n, ...) of every row, and (fp, comp) of every set of a row with an id: its component by sets."""
    num, den = similarity
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.withColumn("key", text_key())
    names, ident = _named(scratch, keyed, shingle, bits)
    known = texts.filter("id is not null and text is not null")

    signed = known.mapInArrow(_signed(shingle, num, den, names), "sig bigint, fp bigint")
    by_sig = Window.partitionBy("sig")
    met = scratch.save(
        signed.withColumns({"least": F.min("fp").over(by_sig), "most": F.max("fp").over(by_sig)})
        .filter("least != most").select("sig", "fp").dropDuplicates(["sig", "fp"])
    )
    scratch.free_shuffles()
    rep = ident.filter("id is not null and n > 0").groupBy("fp").agg(F.min("id").alias("rep"), F.first("n").alias("n"), *(F.first(p).alias(p) for p in SKETCH))
    # nodes that no other node of a bucket can link with go before whole sets are read
    drawn = met.join(rep.drop("rep"), "fp")
    a, b = _paired(drawn, "a", "n", *SKETCH), _paired(drawn, "b", "n", *SKETCH)
    shared = scratch.save(a.join(b, (F.col("a_sig") == F.col("b_sig")) & (F.col("a") != F.col("b")) & _possible(num, den), "left_semi").select(F.col("a_sig").alias("sig"), F.col("a").alias("fp")))
    nodes = scratch.save(shared.select("fp").distinct())
    sketches = scratch.save(rep.join(nodes, "fp", "left_semi"))
    wanted = KeySet(sketches.select("rep"))
    sets = scratch.save(wanted.narrowed(known, "id").mapInArrow(_wanted_sets(shingle, wanted, names), "fp bigint, wide array<bigint>, h array<bigint>").join(nodes, "fp", "left_semi").dropDuplicates(["fp"]))
    scratch.drop(met)
    comp = nodes.select(F.col("fp").alias("node"), F.col("fp").alias("comp"))
    open_ = shared
    for turn in range(HUB_ROUNDS):
        open_ = scratch.save(_open_buckets(open_, comp))
        met, open_ = _hub_pairs(open_, turn)
        late = scratch.save(_verified(_near(met, sketches, sets, num, den), sets, num, den))
        if late.limit(1).count():
            comp = _merged(scratch, comp, late)
    open_ = scratch.save(_open_buckets(open_, comp).join(sketches, "fp"))
    a, b = _paired(open_, "a", "comp", "n", *SKETCH), _paired(open_, "b", "comp", "n", *SKETCH)
    more = a.join(b, (F.col("a_sig") == F.col("b_sig")) & (F.col("a_comp") < F.col("b_comp")) & _possible(num, den)).select("a", "b").distinct()
    near = scratch.save(_near(more, sketches, sets, num, den))
    # of two components the likeliest pair first; the others only if it does not join them
    pair = _across(near, comp).groupBy(F.least("a_comp", "b_comp").alias("c"), F.greatest("a_comp", "b_comp").alias("d")).agg(F.min_by(F.struct("a", "b", "a_n", "b_n"), F.struct("differ", "a", "b")).alias("p"))
    late = scratch.save(_verified(pair.select("p.*"), sets, num, den))
    if late.limit(1).count():
        comp = _merged(scratch, comp, late)
        late = scratch.save(_verified(_across(near, comp), sets, num, den))
    else:
        late = scratch.save(_verified(near, sets, num, den))
    if late.limit(1).count():
        comp = _merged(scratch, comp, late)

    member = rep.join(comp.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("comp", "fp").alias("comp"))
    return scratch, ident, member


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (8, 10), bits: int = 64) -> DataFrame:
    """(id, n_shingles, component_id) of every row: documents with Jaccard similarity of at least num/den on word shingles are linked.

    A text of fewer than ``shingle`` words is one shingle of all of them; a null or empty text has none
    and is alone. component_id is the least id that links reach, the row's own included; a null id
    takes no part in links and has a null component. Repeated rows all come back. Other columns are not read.
    Words are lower-cased A-Z only. ``bits`` of a first fingerprint name a set; results do not depend on it.
    """
    scratch, ident, member = _joined(docs, id_col, text_col, shingle, similarity, bits)
    least = member.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = scratch.save(member.join(least, "comp").select("fp", "component_id"))
    scratch.keep_only(ident, named)
    return ident.join(named, "fp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
    )


def redundant(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: tuple[int, int] = (8, 10)) -> DataFrame:
    """(id, key, stays), key as of ``text_key``: with stays false the rows to leave out, which are linked to a text with a lesser (id, key); with stays true those of which one of several equal rows stays.

    Links are as of ``link_components``, but between texts: of texts that share an id, those that are not linked all stay, and so does every text
    without words. Rows without an id are not in the result. The table is a written one.
    """
    scratch, ident, member = _joined(docs, id_col, text_col, shingle, similarity)
    rows = ident.filter("id is not null").groupBy("id", "key", "fp", "n").agg(F.count("*").alias("copies"))
    grouped = rows.filter("n > 0").join(member.select("fp", "comp"), "fp")
    least = grouped.groupBy("comp").agg(F.min(F.struct("id", "key")).alias("least"))
    marked = grouped.join(least, "comp").withColumn("stays", F.struct("id", "key") == F.col("least"))
    out = marked.unionByName(rows.filter("n = 0").withColumn("stays", F.lit(True)), allowMissingColumns=True).filter("not stays or copies > 1")
    out = scratch.save(out.select(F.col("id").alias(id_col), "key", "stays"))
    scratch.keep_only(out)
    return out

"""A manifest of a dataset: a hash tree over each source's rows, one over the sources, and a proof for every row.

Rows are range-sorted by source and id. A prefix sum of each source's counts by partition gives
every row its index in its source, so a partition hashes all subtrees that lie wholly within it;
the few nodes at its ragged edges are shuffled by coordinate and finish the upper levels.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ragloom.llm.scratch import Scratch

FANOUT = 3
#: Rows of a partition and its subtrees, held by one task.
ROWS = 1 << 16
#: Levels that one shuffle of ragged nodes finishes; a group has fewer than ``FANOUT**STEP`` leaves below it.
STEP = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODE = "part int, g string, level int, idx bigint, d binary, offset bigint, total bigint, height int"
_STEPS = "array<struct<pre: binary, post: binary>>"
RESULT = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _sized(value: Column) -> Column:
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column | None = None) -> Column:
    """Digest of a row's fields, each as UTF-8 byte count, colon and value, or ``-`` if null."""
    return F.sha2(F.concat(*(_sized(F.col(c) if text is None or c != "text" else text) for c in FIELDS)), 256)


def height(total: int) -> int:
    h = 0
    while FANOUT**h < total:
        h += 1
    return h


def climb(nodes: list[str], offset: int, total: int) -> list[tuple[int, list[str]]]:
    """Of consecutive leaves from an index of a tree of ``total`` leaves, all subtrees that they make whole: start and digests of each level."""
    levels = [(offset, nodes)]
    while total > 1:
        start, nodes = levels[-1]
        end = start + len(nodes)
        first, last = -(-start // FANOUT), -(-end // FANOUT) if end == total else end // FANOUT
        if last <= first:
            break
        levels.append((first, [_hash("".join(nodes[FANOUT * p - start : FANOUT * (p + 1) - start])) for p in range(first, last)]))
        total = -(-total // FANOUT)
    return levels


def tops(levels: list[tuple[int, list[str]]]) -> list[tuple[int, int]]:
    """Level and index of the nodes whose parent is not among the levels."""
    out = []
    for k, (start, nodes) in enumerate(levels):
        lo, hi = (FANOUT * levels[k + 1][0], FANOUT * (levels[k + 1][0] + len(levels[k + 1][1]))) if k + 1 < len(levels) else (start, start)
        out += [(k, i) for i in range(start, start + len(nodes)) if not lo <= i < hi]
    return out


def ranged(scratch: Scratch, rows: DataFrame, order: list[str], partitions: int) -> DataFrame:
    """Rows (g, d, ...) sorted by g and order over ranges, with the number of the range and the place in it; equal rows are told apart by their place in the input, so no range has to hold all of them."""
    by = ["g", *order, "_nth"]
    cut = rows.withColumn("_nth", F.monotonically_increasing_id()).repartitionByRange(partitions, *by).sortWithinPartitions(*by)
    return scratch.save(cut.withColumn("part", F.spark_partition_id()).withColumn("pos", F.monotonically_increasing_id()).drop("_nth"))


def offsets(scratch: Scratch, table: DataFrame) -> DataFrame:
    """(part, g, offset, total): where each range's rows of a group begin in the group, and the group's size."""
    n = table.groupBy("part", "g").agg(F.count("*").alias("n"))
    group = Window.partitionBy("g")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return scratch.save(n.select("part", "g", F.coalesce(before, F.lit(0)).alias("offset"), F.sum("n").over(group).alias("total")))


def _segments(left: pa.Table):
    """Each group's digests of a range, in order, with the order of rows."""
    left = left.sort_by("pos")
    names, digests = left.column("g").to_pylist(), [x.hex() for x in left.column("d").to_pylist()]
    lo = 0
    for hi in range(1, len(names) + 1):
        if hi == len(names) or names[hi] != names[lo]:
            yield names[lo], lo, digests[lo:hi]
            lo = hi


def _ragged(left: pa.Table, right: pa.Table) -> pa.Table:
    part = right.column("part")[0].as_py()
    where = {g: (o, t) for g, o, t in zip(*(right.column(c).to_pylist() for c in ("g", "offset", "total")))}
    out = defaultdict(list)
    for g, _, digests in _segments(left):
        offset, total = where[g]
        levels = climb(digests, offset, total)
        for level, idx in tops(levels):
            for name, value in zip(("part", "g", "level", "idx", "d", "offset", "total", "height"), (part, g, level, idx, bytes.fromhex(levels[level][1][idx - levels[level][0]]), offset, total, height(total))):
                out[name].append(value)
    types = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
    return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))


def _finish(upto: int):
    """Hash the parents of a group's nodes, level by level, up to level ``upto`` or the group's root."""

    def finish(rows: pa.Table) -> pa.Table:
        cols = {c: rows.column(c).to_pylist() for c in ("level", "idx", "d")}
        g, total, high = (rows.column(c)[0].as_py() for c in ("g", "total", "height"))
        known = defaultdict(dict)
        for level, idx, d in zip(*cols.values()):
            known[level][idx] = d.hex()
        new = []
        for level in range(min(known), min(upto, high)):
            width = -(-total // FANOUT**level)
            for p in {i // FANOUT for i in known[level]}:
                d = _hash("".join(known[level][i] for i in range(FANOUT * p, min(FANOUT * (p + 1), width))))
                known[level + 1][p] = d
                new.append((-1, g, level + 1, p, bytes.fromhex(d), 0, total, high))
        types = (pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
        names = ("part", "g", "level", "idx", "d", "offset", "total", "height")
        return pa.table([pa.array(v, t) for v, t in zip(zip(*new) if new else [()] * len(names), types)], names)

    return finish


def upper_nodes(scratch: Scratch, ragged: DataFrame) -> DataFrame:
    """The ragged nodes and all nodes above them; each shuffle finishes ``STEP`` levels, keyed by the ancestor there."""
    nodes = ragged
    highest = ragged.agg(F.max("height")).first()[0] or 0
    for upto in range(STEP, highest + STEP, STEP):
        ancestor = F.floor(F.col("idx") / F.pow(F.lit(float(FANOUT)), F.lit(upto) - F.col("level"))).cast("bigint")
        low = nodes.filter((F.col("level") < min(upto, highest)) & (F.col("level") >= upto - STEP) & (F.col("level") < F.col("height"))).withColumn("ancestor", ancestor)
        nodes = nodes.unionByName(scratch.save(low.groupBy("g", "ancestor").applyInArrow(_finish(upto), _NODE)))
    return nodes


def with_paths(ragged: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each ragged node with its path to its group's root: for every level the digests before and after it in its run; and that root."""
    ids = ["part", "g", "level", "idx"]
    runs = nodes.groupBy("g", F.col("level").alias("at"), F.floor(F.col("idx") / FANOUT).alias("run")).agg(F.sort_array(F.collect_list(F.struct("idx", "d"))).alias("run_nodes"))
    shift = F.pow(F.lit(float(FANOUT)), F.col("at") - F.col("level"))
    own = F.floor(F.col("idx") / shift).cast("bigint")
    climbs = ragged.filter("level < height").withColumn("at", F.explode(F.sequence("level", F.col("height") - 1))).withColumn("own", own).withColumn("run", F.floor(F.col("own") / FANOUT))

    def joined(keep) -> Column:
        return F.aggregate(F.filter("run_nodes", keep), F.unhex(F.lit("")), lambda s, x: F.concat(s, x["d"]))

    step = F.struct("at", joined(lambda x: x["idx"] < F.col("own")).alias("pre"), joined(lambda x: x["idx"] > F.col("own")).alias("post"))
    paths = climbs.join(runs, ["g", "at", "run"]).groupBy(*ids).agg(F.sort_array(F.collect_list(step)).alias("ways"))
    roots = nodes.filter("level = height").select("g", F.col("d").alias("top"))
    bare = F.transform(F.coalesce("ways", F.array().cast("array<struct<at: int, pre: binary, post: binary>>")), lambda x: F.struct(x["pre"].alias("pre"), x["post"].alias("post")))
    return ragged.join(paths, ids, "left").join(roots, "g").select(*ids, "offset", "total", bare.alias("steps"), "top")


def grown(scratch: Scratch, rows: DataFrame, order: list[str], partitions: int) -> tuple[DataFrame, DataFrame]:
    """The range-sorted rows (g, d, ...) and the ragged nodes of their trees with paths."""
    table = ranged(scratch, rows, order, partitions)
    where = offsets(scratch, table)
    ragged = scratch.save(table.select("part", "pos", "g", "d").groupBy("part").cogroup(where.groupBy("part")).applyInArrow(_ragged, _NODE))
    return table, scratch.save(with_paths(ragged, upper_nodes(scratch, ragged)))


def walked(left: pa.Table, right: pa.Table):
    """(segment start, leaf digests, links) of each group of a range; a link is (digests before, after, the parent's link), None at the root."""
    per_group = defaultdict(list)
    for r in right.to_pylist():
        per_group[r["g"]].append(r)
    for g, lo, digests in _segments(left):
        known = per_group[g]
        levels = climb(digests, known[0]["offset"], known[0]["total"])
        above = {}
        for r in known:
            link = None
            for s in reversed(r["steps"]):
                link = (s["pre"].hex(), s["post"].hex(), link)
            above[r["level"], r["idx"]] = link
        links: list = []
        for level in range(len(levels) - 1, -1, -1):
            start, nodes = levels[level]
            here = []
            for i in range(start, start + len(nodes)):
                if (level, i) in above:
                    here.append(above[level, i])
                else:
                    lo_run = FANOUT * (i // FANOUT)
                    run = nodes[lo_run - start : lo_run - start + FANOUT]
                    here.append(("".join(run[: i - lo_run]), "".join(run[i - lo_run + 1 :]), links[i // FANOUT - levels[level + 1][0]]))
            links = here
        yield lo, digests, links, known[0]


def folded(digest: str, link) -> str:
    """The root that a leaf's digest and the siblings on its way give."""
    while link is not None:
        before, after, link = link
        digest = _hash(before + digest + after)
    return digest


def _siblings(link) -> str:
    out = []
    while link is not None:
        out += link[:2]
        link = link[2]
    return "".join(out)


def _source_steps(left: pa.Table, right: pa.Table) -> pa.Table:
    names, steps, tops_ = left.sort_by("pos").column("name").to_pylist(), [], []
    for _, _, links, known in walked(left, right):
        for link in links:
            own = []
            while link is not None:
                own.append({"pre": bytes.fromhex(link[0]), "post": bytes.fromhex(link[1])})
                link = link[2]
            steps.append(own)
            tops_.append(known["top"])
    kind = pa.list_(pa.struct([("pre", pa.binary()), ("post", pa.binary())]))
    return pa.table([pa.array(names, pa.string()), pa.array(steps, kind), pa.array(tops_, pa.binary())], ["g", "more", "root"])


def _proofs(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = left.sort_by("pos")
    ids, tampered = rows.column("doc_id"), [x.hex() for x in rows.column("tampered").to_pylist()]
    out = defaultdict(list)
    for lo, digests, links, known in walked(left, right):
        subroot, root = known["top"].hex(), known["root"].hex()
        for k, (d, link) in enumerate(zip(digests, links)):
            got = folded(tampered[lo + k], link)
            for name, value in (("leaf", d), ("subroot", subroot), ("root", root), ("proof_sha256", _hash(_siblings(link))), ("folded_root", got), ("verified", got == root)):
                out[name].append(value)
    return pa.table({"doc_id": ids} | dict(out))


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of (doc_id, source, lang, n_chars, text).

    ``tampered_text`` is the text that the proof is held against, the text itself by default. Rows of a source ascend by doc_id (null
    first), rows of one id by digest; equal rows each have a leaf. A null source is a source of its own, the first. An empty table has
    no rows and no root. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    other = F.col("text") if tampered_text is None else tampered_text
    changed = F.unhex(F.when(~other.eqNullSafe(F.col("text")), leaf(other)).otherwise(F.col("leaf")))
    rows = docs.select(*FIELDS).withColumn("leaf", leaf()).select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("g"), "doc_id", F.unhex("leaf").alias("d"), changed.alias("tampered"))
    table, known = grown(scratch, rows, ["doc_id", "d"], _partitions(spark, docs))
    subroots = known.select("g", "top").distinct().select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("top").alias("d"))
    n = subroots.count()
    sources, above = grown(scratch, subroots, ["name"], 1 + n // ROWS)
    steps = scratch.save(sources.groupBy("part").cogroup(above.groupBy("part")).applyInArrow(_source_steps, f"g string, more {_STEPS}, root binary"))
    whole = scratch.save(known.join(steps, "g").withColumn("steps", F.concat("steps", "more")).drop("more"))
    return table.groupBy("part").cogroup(whole.groupBy("part")).applyInArrow(_proofs, RESULT.format(docs.schema["doc_id"].dataType.simpleString()))


def _partitions(spark: SparkSession, docs: DataFrame) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + docs.count() // ROWS)


def without_line_breaks(text: Column, doc_id: Column) -> Column:
    """The text as the contract tampers with it: without line breaks where 2 divides the crc32 of the decimal id."""
    return F.when(F.crc32(doc_id.cast("string")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)

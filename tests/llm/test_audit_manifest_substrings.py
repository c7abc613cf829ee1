import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ragloom.llm import filter_audit, merkle, substring_dedup


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def fails(text, words):
    bad = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text))}
    return {k for k, v in bad.items() if v}


def test_filter_audit_against_brute_force(spark):
    rng = random.Random(1)
    stock = [f"w{i}" for i in range(150)] + ["UP", "a#", "é"]
    rows = []
    for i in range(120):
        words = rng.sample(stock, 120) if rng.random() < 0.5 else [rng.choice(stock[:60]) for _ in range(rng.choice([3, 90, 130]))]
        rows.append((i, " ".join(words).upper() if rng.random() < 0.2 else "\n".join(words), rng.choice(["en", "de", None, ""])))
    rows += [(i, rows[rng.randrange(100)][1], "en") for i in range(200, 260)] + [(3, rows[3][1], "en"), (3, rows[3][1], rows[3][2]), (None, rows[5][1], "en"), (700, None, "de"), (701, "", None), (702, "x " * 60000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(i, t, lang, "clash", 1) for i, t, lang in rows], "doc_id bigint, text string, lang string, mask string, n int")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    least: dict = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1} for k in (0, 1))
    want: dict = {}
    for i, t, lang in rows:
        bad = fails(t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")) | ({"E"} if i is not None and i > least[t or ""] else set())
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order):
                c = want.setdefault((lang or "", order, step + 1), Counter())
                hit = f in bad
                c["kept"] += not gone and not hit
                c["removed"] += (now := hit and not gone)
                c["redundant"] += hit and gone
                c["unique_fails"] += bad == {f}
                c["good_lost"] += now and i is not None and i in good
                c["toxic_lost"] += now and i is not None and i in toxic
                gone |= hit
    shapley: dict = Counter()
    for (part, order, step), c in want.items():
        shapley[part, order[step - 1]] += c["removed"]
    got = filter_audit.audited(docs, table).collect()
    assert len(got) == len(want) == 3 * 600
    for r in got:
        assert {k: r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")} == {k: want[r["part"], r["filter_order"], r["step"]][k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
        assert r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]]
    assert filter_audit.audited(docs.limit(0), table).count() == 0 and filter_audit.audited(docs, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_incidence_outcomes_add_up():
    orders, m = filter_audit.incidence()
    assert len(orders) == 120 and all(x.shape == (32, 600) for x in m.values())
    by_step = {k: x.reshape(32, 120, 5) for k, x in m.items()}
    assert (by_step["kept"][:, :, 4] + by_step["removed"].sum(2) == 1).all()
    assert (by_step["kept"][0] == 1).all() and (by_step["removed"].sum(2)[1:] == 1).all()


def tree(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 3])) for k in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    """(digests before, after) in the run of each level from leaf i up."""
    out = []
    for nodes in levels[:-1]:
        lo = i // 3 * 3
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 3])))
        i //= 3
    return out


def digest(row, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


@pytest.mark.parametrize(("rows_a_part", "step"), [(5, 2), (1 << 16, 12)])
def test_merkle_manifest_against_brute_force(spark, monkeypatch, rows_a_part, step):
    monkeypatch.setattr(merkle, "ROWS", rows_a_part)
    monkeypatch.setattr(merkle, "STEP", step)
    rng = random.Random(2)
    sources = [None, "", "é", "z", "one"] + ["hot"] * 12
    rows = [(i, rng.choice(sources[:4] + sources[5:]), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["a\nb", "plain é", "", None, "\n" * i])) for i in rng.sample(range(1000), 230)]
    rows += [(7777, "one", "en", 1, "x\ny"), *[(5, "hot", "en", 1, "same\ntext")] * 40, (5, "hot", "en", 2, "other"), (None, "hot", None, None, None)]
    docs = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, g string, part int")
    by_source: dict = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, digest(r, r[4]), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    want = []
    for s in names:
        for i, (_, _, d, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            x = digest(r, r[4].replace("\n", "") if even and r[4] is not None else r[4])
            steps = way(trees[s], i) + way(top, names.index(s))
            for before, after in steps:
                x = sha(before + x + after)
            want.append((r[0], d, trees[s][-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), x, x == top[-1][0]))
    got = merkle.manifest(docs.repartition(3), merkle.without_line_breaks(F.col("text"), F.col("doc_id"))).collect()
    assert Counter(map(tuple, got)) == Counter(want) and {w[-1] for w in want} == {True, False}
    assert all(r["verified"] for r in merkle.manifest(docs.limit(3)).collect())
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_local_subtrees_leave_only_edges():
    digests = [str(i) for i in range(1000)]
    for lo, hi in [(0, 1000), (1, 1000), (200, 777), (998, 1000), (4, 5)]:
        levels = merkle.climb(digests[lo:hi], lo, 1000)
        whole = tree(digests)
        assert all(nodes == whole[k][start : start + len(nodes)] for k, (start, nodes) in enumerate(levels))
        assert len(merkle.tops(levels)) <= 4 * len(levels)


def without_repeats(texts, window):
    own = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + window] for b in own for i in range(len(b) - window + 1))
    out = []
    for b in own:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - window + 1):
            if seen[b[i : i + window]] > 1:
                gone[i : i + window] = 1
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone])))
        out.append(([*zip(edge[::2].tolist(), edge[1::2].tolist())], bytes(x for x, g in zip(b, gone) if not g)))
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(8)
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [make(rng.randint(17, 90)) for _ in range(6)]
    texts = ["".join(rng.choice([make(rng.randint(0, 40)), rng.choice(shared)]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    # one passage of exactly the window's length among unlike neighbours, a text that repeats itself, copies, texts of just one window
    texts += [make(30) + "=" * 4 + "0123456789ABCDEFGHIJKLMN"[:24] + "=" * 4 + make(30) for _ in range(40)]
    texts += ["xyz" * 50, "a" * 100, texts[0], texts[1], "\x00" * 24, "abcdefghijklmnopqrstuvwx", "abcdefghijklmnopqrstuvwx", "", None, None, "short"]
    return texts


@pytest.mark.parametrize(("window", "anchor", "most"), [(24, 12, 4096), (24, 12, 2), (16, 5, 4096)])
def test_substring_dedup_against_brute_force(spark, passages, window, anchor, most):
    rows = [(None if i % 7 == 0 else i // 2, t, "clash", i) for i, t in enumerate(passages)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _kept string, nth int").repartition(3)
    out = substring_dedup.deduplicated(df, window=window, anchor=anchor, most=most)
    assert out.columns == ["doc_id", "text", "nth", "_spans", "_kept"]
    got = {r["nth"]: ([tuple(s) for s in r["_spans"]], bytes(r["_kept"])) for r in out.collect()}
    want = without_repeats(passages, window)
    assert got == dict(enumerate(want)) and sum(bool(s) for s, _ in want) > 40


def test_substring_dedup_edges(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [(r["_spans"], bytes(r["_kept"])) for r in substring_dedup.deduplicated(df).collect()] == [([], b""), ([], b"")]
    assert substring_dedup.deduplicated(df.limit(0)).count() == 0
    long_text = "".join(random.Random(3).choices("abcdefgh", k=200_000))
    whole = substring_dedup.deduplicated(spark.createDataFrame([(1, long_text), (2, "x" + long_text[50_000:50_200] + "y")], "doc_id bigint, text string"))
    assert {r["doc_id"]: [tuple(s) for s in r["_spans"]] for r in whole.collect()} == {1: [(50_000, 50_200)], 2: [(1, 201)]}


def test_pieces_hold_every_window_once(monkeypatch, passages):
    class All:
        def has(self, keys):
            return np.ones(len(keys), bool)

    monkeypatch.setattr(substring_dedup, "SECTION", 64)
    monkeypatch.setattr(substring_dedup.textkit, "slices", lambda bounds: ((i, i + 1) for i in range(len(bounds) - 1)))
    cut = substring_dedup.Cutter(24, 12)
    texts = pa.array([*passages, "".join(passages[:50])])
    seen = Counter()
    for row, start, n, _, piece in cut.pieces(texts, All()):
        own = (texts[row].as_py() or "").encode()
        assert own[start : start + n + 23] == piece and n <= cut.reach
        seen.update((row, start + k) for k in range(n))
    assert seen == Counter((r, k) for r, t in enumerate(texts.to_pylist()) for k in range(len((t or "").encode()) - 23))

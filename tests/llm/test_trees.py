"""Merkle manifest and prefix trie against plain versions, with hot keys spread over tasks."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuslens.llm import merkle_manifest, prefix_trie
from corpuslens.llm._places import STEP, numbered


@pytest.fixture
def spread_out(spark):
    """Small tables stay in many partitions."""
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


# places -------------------------------------------------------------------
@pytest.mark.parametrize("n", [0, 1, 2, 400])
def test_numbered(spark, spread_out, n):
    rng = random.Random(n)
    keys = [None, "a", "a", "a", "b", *"cdefgh"]
    rows = [(rng.choice(keys), i, rng.randrange(-2**63, 2**63)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    df = df.withColumn("s", F.col("v")).withColumn("p", F.col("v"))
    got = numbered(df, "k", ["o"], {"s": "sum", "p": "poly"}).collect()
    assert len(got) == n
    groups = defaultdict(list)
    for r in got:
        groups[r.k].append(r)
    wrap = lambda x: (x + 2**63) % 2**64 - 2**63
    for rs in groups.values():
        rs.sort(key=lambda r: r.o)
        s = p = 0
        for i, r in enumerate(rs):
            s, p = s + r.v, p + r.v * pow(STEP, i, 2**64)
            assert (r.pos, r.last, r.s, r.p) == (i, i == len(rs) - 1, wrap(s), wrap(p))


# Merkle manifest ----------------------------------------------------------
def plain_tree(nodes):
    """(root, for each node its (place, others) level by level)."""
    paths, at, levels = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(levels) > 1:
        for i, a in enumerate(at):
            run = levels[a - a % 3: a - a % 3 + 3]
            paths[i].append((a % 3, run[: a % 3] + run[a % 3 + 1:]))
        levels = [H("".join(levels[k: k + 3])) for k in range(0, len(levels), 3)]
        at = [a // 3 for a in at]
    return levels[0], paths


def plain_manifest(rows):
    def leaf(row, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))

    by_source = defaultdict(list)
    for r in rows:
        even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
        altered = leaf(r, None if r[1] is None else r[1].replace("\n", "")) if even else None
        by_source[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), altered))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by_source[s].sort(key=lambda x: (*x[:3], x[3] or ""))
        trees[s] = plain_tree([x[2] for x in by_source[s]])
    root, tops = plain_tree([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (has, i, lf, altered), path in zip(by_source[s], trees[s][1], strict=True):
            node = altered or lf
            for at, sib in path + top:
                node = H("".join([*sib[:at], node, *sib[at:]]))
            proof = H("".join("".join(sib) for _, sib in path + top))
            out.append((i if has else None, lf, trees[s][0], root, proof, node, node == root))
    return sorted(out, key=str)


def manifest_of(docs, levels):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    got = merkle_manifest.manifest(docs, even, F.replace("text", F.lit("\n"), F.lit("")), levels)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("n,levels", [(1, 1), (3, 1), (4, 1), (130, 1), (130, 2), (130, 6)])
def test_manifest(make_docs, clashing, spread_out, n, levels):
    rng = random.Random(n)
    rows = [(rng.choice([None, i, i, 3, -i]), rng.choice([None, "", "x\ny", f"é{i}\n", "z" * 500]), rng.choice([None, "en"]),
             rng.choice(["hot"] * 12 + [None, "", "é", "z", *map(str, range(9))])) for i in range(n)]
    rows += [(5, "same\n", "en", "hot")] * (n // 20)
    full = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    got = manifest_of(clashing(make_docs(rows)), levels)
    assert got == plain_manifest(full)
    if n > 100:
        assert 0 < sum(r[-1] for r in got) < len(got)


def test_manifest_of_nothing_and_of_sources_only(make_docs, spread_out):
    assert manifest_of(make_docs([]), 1) == []
    rows = [(i, "t", "en", f"s{i:03}") for i in range(100)]  # a tree of sources over several partitions
    assert manifest_of(make_docs(rows), 1) == plain_manifest([(*r, 1) for r in rows])


def test_manifest_without_changes_verifies(make_docs):
    got = merkle_manifest.manifest(make_docs([(i, "a\n", "en", "s") for i in range(10)])).collect()
    assert len({r.root for r in got}) == 1 and all(r.verified and r.folded_root == r.root for r in got)


# prefix trie --------------------------------------------------------------
def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c - (c // 100) * 100 if c >= 0 else -((-c) % 100))
        paths[c] = [*own.get(base, [])[:h], *ts[h:]]
    members = defaultdict(list)
    for c, ts in paths.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(set)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    out = []

    def below(k):
        return [k, *(x for kid in kids[k] for x in below(kid))]

    for k, cs in members.items():
        sub = below(k)
        ends = ",".join(str(c) for c in sorted(cs) if len(paths[c]) == len(k))
        out.append((min(cs), len(k), min(members[k[:-1]]) if k else None, len(cs), len(kids[k]), sum(not kids[x] for x in sub),
                    sum((len(members[x]) - 1) * len(x[-1][1]) for x in sub if x), H(ends)))
    return sorted(out, key=str)


def trie_of(conversations, **kw):
    got = prefix_trie.trie(*prefix_trie.rebuild(conversations), **kw)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


SCHEMA = "conv_id long, turn long, role string, text string"


def conversation_rows(seed, n, words):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-50, 3 * n), n):
        order = rng.sample([None, *range(12)], rng.randint(1, 9))
        rows += [(c, t, rng.choice([None, "", "user"]), rng.choice(words)) for t in order]
    rows += [(None, 1, "user", "lost")] * 3
    hot = [(t, "user", rng.choice(words)) for t in range(6)]
    rows += [(10_000 + c, *t) for c in range(n // 3) for t in hot]  # one large group of copies
    return rows


@pytest.mark.parametrize("n,words", [(4, ["a"]), (60, ["a", "", "bé", None]), (60, [f"w{i}" for i in range(400)])])
@pytest.mark.parametrize("width", [64, 1 << 20])
def test_trie(spark, clashing, spread_out, n, words, width):
    """A sketch of 64 counters proves hardly anything: the result is the same."""
    rows = conversation_rows(n, n, words)
    df = clashing(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert trie_of(df, max_width=width) == plain_trie(rows)


def test_trie_of_one_long_conversation_and_of_nothing(spark, spread_out):
    rows = [(7, t, "user", f"t{t % 3}") for t in range(300)] + [(8, t, "user", f"t{t % 3}") for t in range(200)]
    assert trie_of(spark.createDataFrame(rows, SCHEMA)) == plain_trie(rows)
    assert trie_of(spark.createDataFrame([], SCHEMA)) == []
    assert trie_of(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)) == []


def test_ids_of_a_node_are_hashed_in_chunks(spark, spread_out):
    ids = list(range(500_000, 530_000))
    df = spark.createDataFrame([(1, 2, 3, c) for c in ids], "d long, p1 long, p2 long, c long")
    (row,) = prefix_trie._joined(df).collect()
    assert row.ends == H(",".join(map(str, ids)))


def test_screening_proves_singletons_only():
    rng = np.random.default_rng(1)
    p = rng.integers(0, 1 << 63, (2, 500), dtype=np.uint64)
    slots = prefix_trie._slots(1 << 12, np.ones(500, int), *p)
    assert len(slots) == prefix_trie.ROWS and all(0 <= s.min() and s.max() < 1 << 12 for s in slots)
    assert np.mean(slots[0] == slots[1]) < 0.02

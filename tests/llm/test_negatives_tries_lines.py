"""Hard negatives, prefix trie and line dedup against brute force: nulls, ties, repeated rows, large values, many shards."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peerpanel.llm import hard_negatives, line_dedup, prefix_trie

# hard negatives


def brute_negatives(rows, every, n_positives, n_negatives, low, high):
    rows = [r for r in rows if r[1] is not None and r[2] is not None and None not in r[2]]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    order = lambda x: (-x[1], x[0] is None, x[0] or 0)
    out = []
    for a in {(k, label, tuple(v)) for k, label, v in rows if k is not None and k % every == 0}:
        others = [(k, dot(a[2], v), label) for k, label, v in rows if k != a[0]]
        for p, s, _ in sorted((x for x in others if x[2] == a[1]), key=order)[:n_positives]:
            fits = sorted((x for x in others if x[2] != a[1] and low * s <= 100 * x[1] <= high * s), key=order)
            out += [(a[0], p, rank, k, s, t) for rank, (k, t, _) in enumerate(fits[:n_negatives], 1)]
    return out


def mined(spark, rows, every=5, n_positives=3, n_negatives=4, low=30, high=90):
    frame = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>").withColumn("rank", F.lit("x")).repartition(3)
    out = hard_negatives.mine(frame, F.col("vec_id") % every == 0, "vec_id", "label", "vector", n_positives, n_negatives, low, high)
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, out.collect()), key=key), sorted(brute_negatives(rows, every, n_positives, n_negatives, low, high), key=key)


@pytest.mark.parametrize("size", [4, 1 << 28])
def test_negatives_with_ties_nulls_and_large_values(spark, size, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    rng = random.Random(size)
    rows = [(k, rng.randrange(3), [rng.randrange(-size, size) for _ in range(rng.choice([3, 5, 5]))]) for k in range(120)]
    rows += [(200, None, [1, 2]), (205, 1, None), (210, 1, [None, 3]), (None, 1, [size - 1] * 5), (None, 2, [size // 2] * 5), (215, 2, []), (220, -1, [size] * 5)]
    rows += rows[10:20]
    got, want = mined(spark, rows)
    assert want and got == want


def test_negatives_of_nothing(spark):
    assert mined(spark, [])[0] == []
    assert mined(spark, [(1, 1, [3]), (0, 1, [0]), (5, 2, [0])], every=5, low=0)[0] == mined(spark, [(1, 1, [3]), (0, 1, [0]), (5, 2, [0])], every=5, low=0)[1]
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1 << 40]), (1, 1, [1 << 40])])


def test_residue_scores_are_exact():
    rng = np.random.default_rng(3)
    for width, size in ((1, 2**30), (64, 256), (700, 2**20), (2500, 2**18)):
        a, b = (rng.integers(-size, size, (n, width)) for n in (9, 6))
        a[0], b[0], b[1] = size, size, -size
        primes = hard_negatives.choose_primes(width, int(width * size * size))
        got = hard_negatives.scores(hard_negatives.residues(a, primes), hard_negatives.residues(b, primes), primes)
        assert (got == a.astype(object) @ b.astype(object).T).all()


# prefix trie


def brute_trie(convs):
    """convs: (key, list of (role, text))."""
    nodes = {}
    for key, turns in convs:
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((key, len(turns) == d))
    words = lambda t: len(t.split())
    kids = {}
    for n in nodes:
        if n:
            kids[n[:-1]] = kids.get(n[:-1], 0) + 1
    out = []
    for n, members in nodes.items():
        below = [m for m in nodes if m[:len(n)] == n]
        out.append((min(k for k, _ in members), len(n), min(k for k, _ in nodes[n[:-1]]) if n else None, len(members), kids.get(n, 0),
                    sum(m not in kids for m in below), sum((len(nodes[m]) - 1) * words(m[-1][1]) for m in below if m),
                    hashlib.sha256(",".join(str(k) for k in sorted(k for k, end in members if end)).encode()).hexdigest()))
    return out


def as_rows(convs):
    return [(key, k if k else None, role, text) for key, turns in convs for k, (role, text) in enumerate(turns)]


def grown(spark, convs):
    frame = spark.createDataFrame(as_rows(convs), "conv_id long, turn long, role string, text string").withColumn("depth", F.lit(1))
    out = prefix_trie.trie(prefix_trie.paths_of(frame))
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, out.collect()), key=key), sorted(brute_trie([c for c in convs if c[1]]), key=key)


@pytest.mark.parametrize("seed", range(3))
def test_trie_over_many_shards(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 7)
    monkeypatch.setattr(prefix_trie, "PANEL", 3)
    monkeypatch.setattr(prefix_trie, "HELD_NODES", 0 if seed == 1 else 1000)
    rng = random.Random(seed)
    turn = lambda: (rng.choice("ua"), rng.choice(["", "one", "two words", "and three words"]))
    convs = [(k * 7 - 300, [turn() for _ in range(rng.choice([1, 2, 3, 4, 7]))]) for k in range(150)]
    convs += [(5000 + k, [("u", "hot"), ("a", "and hot")]) for k in range(80)]  # a third of all, one path
    convs += [(9000, [turn() for _ in range(40)]), (9001, [("u", "hot")] * 30), (9002, [("u", "hot")] * 31)]
    got, want = grown(spark, convs)
    assert got == want


def test_trie_of_few_and_of_odd_rows(spark):
    got, want = grown(spark, [(3, [("u", "a")])])
    assert got == want
    frame = spark.createDataFrame([(1, 0, None, None), (1, 0, None, None), (2, 0, "", ""), (None, 0, "u", "x")], "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r)[:5] for r in prefix_trie.trie(prefix_trie.paths_of(frame)).collect() if r["depth"])
    assert got == [(1, 1, 1, 2, 1), (1, 2, 1, 1, 0)]
    assert prefix_trie.trie(prefix_trie.paths_of(frame.where("false"))).count() == 0
    turnless = spark.createDataFrame([(4, []), (2, []), (None, []), (7, None)], f"conv_id long, path array<{prefix_trie.TURN}>")
    assert [tuple(r) for r in prefix_trie.trie(turnless).collect()] == [(2, 0, None, 2, 0, 1, 0, hashlib.sha256(b"2,4").hexdigest())]


# lines


def brute_lines(rows, min_docs, min_chars):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    seen = {}
    for _, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("held", [line_dedup.HELD_KEYS, 40, 0])
def test_lines_by_every_route(spark, held, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 16)
    rng = random.Random(1)
    line = lambda: rng.choice(["", " ", "Hot line", "hOT LINE \t", "É", "é", "x" * 5000, f"line {rng.randrange(200)}", f"rare {rng.randrange(10**6)}"])
    rows = [(k, "\n".join(line() for _ in range(rng.randrange(12)))) for k in range(300)]
    rows += [(None, None), (1, ""), (1, "\n\n"), (2, "Hot line"), (2, "Hot line"), (3, "a\r\nHot line\r\n"), (4, "\n".join(f"line {k % 50}" for k in range(20_000)))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_lines", "gone", "row", "doc", "first")}).repartition(3).checkpoint()
    out = line_dedup.drop_repeated_lines(frame, 6, 1, held_keys=held)
    assert out.columns == ["doc_id", "text", "gone", "row", "doc", "first", "n_lines", "n_dropped"]
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted(map(tuple, out.select("doc_id", "text", "n_lines", "n_dropped").collect()), key=key)
    assert got == sorted(brute_lines(rows, 6, 1), key=key)
    assert line_dedup.drop_repeated_lines(frame.where("false"), 6, held_keys=held).count() == 0


def test_perfect_hash_is_minimal_and_rejects_strangers():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 20_000):
        keys = rng.integers(-2**63, 2**63 - 1, (n, 2))
        keys[:n // 2, 0] = 7  # equal first hashes are told apart by the second ones
        made = line_dedup.PerfectHash.build(keys[:, 0], keys[:, 1])
        assert sorted(made.slots(keys[:, 0], keys[:, 1])) == list(range(n))
        assert 64 * len(made.bits) < 6 * n + 1000
    shard = line_dedup.Shard(made.sizes, made.bits.tobytes(), keys[np.argsort(made.slots(keys[:, 0], keys[:, 1])), 1].tobytes(), np.full(n, 9, np.uint32).tobytes())
    assert (shard.documents(keys[:, 0], keys[:, 1]) == 9).all()
    assert not shard.documents(rng.integers(-2**63, 2**63 - 1, 5000), rng.integers(-2**63, 2**63 - 1, 5000)).any()

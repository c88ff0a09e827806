"""The prefix trie against a brute-force version that compares whole prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from assayframe.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, path string"


def brute(rows, block=100, most=6):
    own = collections.defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most if most else 0
        whole[c] = tuple(own.get(c - c % block, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    sha = lambda p, m: hashlib.sha256(",".join(str(c) for c in m if len(whole[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p], sha(p, m)) for p, m in members.items())


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(rng, n, vocab):
    rows = []
    for c in rng.sample(range(-250, 3 * n), n):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t if rng.random() < 0.97 else None, rng.choice(["user", "user", "assistant", None]), rng.choice(vocab), "x", "y"))
        if rows[-1][1] is None or sum(r[0] == c and r[1] is None for r in rows[-8:]) > 1:  # ties of different turns are not compared
            rows = [r for r in rows if r[0] != c or r[1] is not None]
    return rows


@pytest.mark.parametrize("convs,turns", [(4096, 1 << 17), (7, 1 << 17), (4096, 25)])
def test_against_brute_force(spark, monkeypatch, convs, turns):
    rng = random.Random(3)
    rows = made(rng, 150, ["a", "b", "", None, "é🙂", "long " * 300])
    rows += [(None, 0, "user", "lost", "x", "y"), rows[0], rows[5]]
    rows += [(1000 + k, 0, "user", "same", None, None) for k in range(60)] + [(5000, t, "user", f"t{t % 3}", None, None) for t in range(300)]
    monkeypatch.setattr(prefix_trie, "CONVERSATIONS", convs)
    monkeypatch.setattr(prefix_trie, "TURNS", turns)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(prefix_trie.prefix_trie(df)) == brute(rows)
    assert found(prefix_trie.prefix_trie(df, most=0)) == brute(rows, most=0)
    assert found(prefix_trie.prefix_trie(df, block=7, most=3)) == brute(rows, 7, 3)


def test_empty_and_turnless(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    taken = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)  # its base is absent, its turns are few
    rows = [(taken, 0, "user", "x", "", "")]
    assert found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows) == [(taken, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(taken).encode()).hexdigest())]


def test_ties_are_whole_turns(spark):
    rows = [(1, 0, "user", "a", "", ""), (1, 0, "user", "b", "", ""), (2, 0, "user", "b", "", ""), (2, 0, "user", "a", "", "")]
    out = found(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), most=0))
    assert [(r[1], r[3]) for r in out] == [(0, 2), (1, 2), (2, 2)]

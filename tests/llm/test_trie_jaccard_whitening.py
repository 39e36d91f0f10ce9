"""Operators 11 to 13 against brute force, on small fixtures with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from pennybrook.llm import jaccard, prefix_trie, whitening

from . import plain

F = pytest.importorskip("pyspark.sql.functions")


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def plain_trie(rows, branch):
    """{(conv_id, depth): the other columns}, every node's members and subtree by plain loops."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())} {role or ''}{text or ''}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, digest), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    built = own
    if branch:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        built = {c: own.get(c - int(np.fmod(c, 20)), [])[: h[c]] + own[c][h[c] :] for c in own}
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = {}
    for node, cs in members.items():
        children = [m for m in members if len(m) == len(node) + 1 and m[: len(node)] == node]
        below = [m for m in members if m[: len(node)] == node]
        leaves = sum(not any(len(x) == len(m) + 1 and x[: len(m)] == m for x in members) for m in below)
        saved = sum((len(members[m]) - 1) * len(words(m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in cs if len(built[c]) == len(node))
        out[cs[0], len(node)] = (members[node[:-1]][0] if node else None, len(cs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


CONVERSATIONS = "conv_id long, turn long, role string, text string, depth string, name string"


@pytest.mark.parametrize("branch", [True, False])
def test_prefix_trie(spark, branch):
    rng = random.Random(5)
    texts = ["hello there", "yes", "no, thanks", "", None, "a\tb\nc  d", "Élan über"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in [*range(30), 61, 79, -7, -25, 5_000_000_000] for t in range(rng.randint(1, 6))]
    rows += [(40, None, "user", "first"), (40, 1, "user", "then"), (40, 1, "user", "then"), (40, 1, "user", "tie"), (None, 0, "user", "nobody's"), (41, 0, "user", "alone")]
    rows += [(c, t, "user", f"long {min(t, 40 + c)} " + "word " * 30) for c in (100, 101, 102) for t in range(70)]  # parts of one long conversation
    rows += [(c, 0, "user", "copy") for c in range(200, 240)]  # exact copies
    df = spark.createDataFrame([(*r, "d", "n") for r in rows], CONVERSATIONS).repartition(5)
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in prefix_trie.conversation_trie(df, branch).collect()}
    assert got == plain_trie(rows, branch)


def test_prefix_trie_of_little(spark):
    one = spark.createDataFrame([(43, 0, "user", "cut away", "", "")], CONVERSATIONS)  # its base is absent, and it has fewer turns than are taken
    assert zlib.crc32(b"43") % 4 > 0
    (row,) = prefix_trie.conversation_trie(one, True).collect()
    assert tuple(row) == (43, 0, None, 1, 0, 1, 0, hashlib.sha256(b"43").hexdigest())
    assert prefix_trie.conversation_trie(one.limit(0), True).count() == 0
    assert prefix_trie.conversation_trie(one.withColumn("conv_id", F.lit(None).cast("long"))).count() == 0


def test_ends_of_many_are_streamed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    ids = [*range(-30, 100), 10**15]
    ends = spark.createDataFrame([(n, 2, c) for n in (1, 5) for c in ids], "node_id long, depth long, conv_id long").repartition(4)
    want = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert sorted(map(tuple, prefix_trie.ends_digests(ends).collect())) == [(1, 2, want), (5, 2, want)]


def shingles(text):
    w = words(plain.lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def plain_jaccard(docs):
    rows = [(d, shingles(t)) for d, t in docs if d is not None]
    groups = plain.Groups(len(rows))
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                groups.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[groups.of(i)] = min(d, least.get(groups.of(i), d))
    return sorted((d, len(s), least[groups.of(i)]) for i, (d, s) in enumerate(rows))


DOCS = "doc_id long, text string, n int, sid string, token string"


def edited(rng, w, k):
    w = list(w)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"edit{rng.randint(0, 10**9)}"
    return " ".join(w)


def jaccard_fixture():
    rng = random.Random(11)
    prose = lambda n: [rng.choice("the of to and is was in it on as".split()) + rng.choice(["", "", str(rng.randint(0, 300))]) for _ in range(n)]
    docs = [(i, " ".join(prose(rng.randint(0, 120)))) for i in range(60)]
    base = prose(150)
    docs += [(100 + i, edited(rng, base, rng.randint(0, 8))) for i in range(80)]  # on both sides of the threshold, around one document
    drift = prose(200)
    for i in range(40):  # a chain of small changes
        drift[(5 * i) % 200] = f"drift{i}"
        docs.append((200 + i, " ".join(drift)))
    passage = prose(100)
    docs += [(300 + i, " ".join(passage + prose(rng.randint(5, 30)))) for i in range(50)]  # one passage that many share
    docs += [(400 + i, " ".join(w)) for w in [prose(3)] for i in range(4)] + [(410, "One two"), (411, "one\ttwo"), (412, "two one"), (413, "one"), (414, " "), (415, None), (416, ""), (417, "a b c d e"), (418, "A B C D E")]
    docs += [(500, " ".join(base)), (500, " ".join(base)), (500, "another text of the same number"), (None, " ".join(base)), (501, " ".join(drift * 40)), (502, edited(rng, drift * 40, 30))]
    return docs


@pytest.mark.parametrize("options", [{}, {"longest": 1, "frequent": 0, "broadcast_rows": 0}, {"longest": 12, "frequent": 50}])
def test_jaccard_components(spark, options):
    docs = jaccard_fixture()
    df = spark.createDataFrame([(d, t, 1, "s", "t") for d, t in docs], DOCS).repartition(4)
    assert sorted(map(tuple, jaccard.components(df, **options).collect())) == plain_jaccard(docs)


def test_jaccard_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert jaccard.components(empty).count() == 0
    two = spark.createDataFrame([(1, None, 1, "", ""), (2, "", 1, "", ""), (3, "lonely", 1, "", "")], DOCS)
    assert sorted(map(tuple, jaccard.components(two).collect())) == [(1, 0, 1), (2, 0, 2), (3, 1, 3)]


def test_prefixes_of_linked_sets_share_enough():
    """For every l: n - t + l first shingles of both sets hold at least l common ones, whatever the order."""
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randint(5, 60)
        a = set(range(n))
        b = a - set(rng.sample(range(n), rng.randint(0, n // 8))) | {1000 + i for i in range(rng.randint(0, n // 10))}
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        order = {x: rng.random() for x in a | b}
        for k in range(1, min(jaccard.least_overlap(len(s), 80) for s in (a, b)) + 1):
            first = [set(sorted(s, key=order.get)[: len(s) - jaccard.least_overlap(len(s), 80) + k]) for s in (a, b)]
            assert len(first[0] & first[1]) >= k


def test_word_hashes_are_of_words():
    texts = ["Hello  hello\tHELLO", "", "x", " hello", "hellohello", "Ünï ünï", "a" * 3000]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    got, counts = jaccard.word_hashes(np.frombuffer(b"".join(raw), np.uint8), offs)
    flat = [w for t in texts for w in words(plain.lower(t))]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert {(flat[i] == flat[j]) == (got[i] == got[j]) for i in range(len(flat)) for j in range(len(flat))} == {True}


VECTORS = "vec_id long, embedding array<float>, x string, n int"


def plain_whitening(rows):
    vectors = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows]
    fit = np.array(sorted({tuple(x) for _, x in vectors}), float)
    n, sums = len(fit), [sum(int(c) for c in col) for col in fit.T]
    e, u = np.linalg.eigh(np.cov(fit.T, bias=True))
    e, u = e[::-1][:4], u[:, ::-1][:, :4]
    out = []
    for i, x in vectors:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = (np.array(x) - np.array(sums) / n) @ u / np.sqrt(e)
        out += [(i, k + 1, n, dev, y[k], e[k] / np.trace(np.cov(fit.T, bias=True))) for k in range(4)]
    return out


def test_whitening(spark):
    rng = np.random.default_rng(4)
    scale = np.array([9.0, 5, 3, 2, 0.5, 0.2])
    rows = [(i, (rng.normal(size=6) * scale + 40).tolist()) for i in range(200)]
    rows += [(500 + i, rows[0][1]) for i in range(100)] + [(500, rows[1][1]), (None, rows[2][1])]
    bad = [(900, None), (901, []), (902, [None] + [1.0] * 5), (903, [float("nan")] + [1.0] * 5), (904, [float("inf")] + [1.0] * 5), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + bad], VECTORS).repartition(5)
    got = whitening.whiten(df).collect()
    want = plain_whitening(rows)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    sign = {k: np.sign(next(g[4] * w[4] for g, w in zip(got, want) if g[1] == k)) for k in range(1, 5)}  # either sign, the same for all rows
    assert np.allclose([g[4] for g in got], [sign[w[1]] * w[4] for w in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-9


def test_whitening_without_variance(spark):
    one = spark.createDataFrame([(7, [0.5, 0.25], "x", 1), (8, [0.5, 0.25], "x", 1)], VECTORS)
    assert sorted(map(tuple, whitening.whiten(one).collect())) == [(i, k, 1, 0, 0.0, 0.0, 0.0) for i in (7, 8) for k in (1, 2)]
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0], "x", 1) for i in range(10)], VECTORS)
    got = whitening.whiten(line).collect()
    assert {r["explained"] for r in got if r["component"] > 1} == {0.0} and {r["whitened"] for r in got if r["component"] > 1} == {0.0}
    assert abs(next(r["explained"] for r in got if r["component"] == 1) - 1) < 1e-12 and got[0]["identity_error"] < 1e-9
    assert whitening.whiten(one.limit(0)).count() == 0


def test_chan_merge_is_exact_beyond_longs():
    rng = np.random.default_rng(6)
    x = rng.integers(-(1 << 61), 1 << 61, (50, 3))
    state = None
    for part in np.array_split(x, [1, 9, 30]):
        state = whitening.merge(state, whitening.state_of(part))
    assert state[1] == [int(v) for v in x.astype(object).sum(0)]
    assert np.allclose(state[3] / 50, np.cov(x.T.astype(float), bias=True), rtol=1e-9)
    dev = whitening.deviations(x, 50, state[1]).to_pylist()
    assert dev == [None] * 50  # beyond a long
    small = rng.integers(-9, 9, (20, 3))
    assert whitening.deviations(small, 20, [int(v) for v in small.sum(0)]).to_pylist() == [sum((20 * int(c) - int(s)) ** 2 for c, s in zip(r, small.sum(0))) for r in small]

import hashlib
import random
import zlib
from collections import defaultdict

from quantloom.llm import queries, trie


def plain(convs):
    """convs: id -> [(role, text)]. Nodes by walking every prefix."""
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
        ends[tuple(convs[c])].append(c)
    out = {}
    for p in members:
        below = [q for q in members if q[: len(p)] == p]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in members)]
        children = [q for q in below if len(q) == len(p) + 1]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        ids = ",".join(map(str, ends[p]))
        out[(members[p][0], len(p))] = (members[p[:-1]][0] if p else None, len(members[p]), len(children), len(leaves), saved, hashlib.sha256(ids.encode()).hexdigest())
    return out


def ordered(rows):
    """id -> turns, ties by their digests."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, key, role, text))
    return {c: [x[3:] for x in sorted(t)] for c, t in convs.items()}


def made(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "'x' as pos", "1 as name", "2 as d")


def conversations(rng, n, deep=12):
    rows = []
    for c in range(n):
        for k in range(rng.randint(1, deep)):
            rows.append((c, k if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "", "ü" * 3])))
    return rows


def test_nodes_equal_walking_every_prefix(spark):
    rng = random.Random(3)
    rows = conversations(rng, 60)
    rows += [(c, k, "user", "same") for c in range(100, 160) for k in range(3)]  # a third are copies
    rows += [(200, k, "user", "ab"[k % 2]) for k in range(70)] + [(201, k, "user", "ab"[k % 2]) for k in range(65)]
    rows += [(None, 0, "user", "nobody's"), (200, 3, "user", "a"), (200, 3, "user", "a")]
    rng.shuffle(rows)
    nodes, ends = trie.trie(trie.turns(made(spark, rows)))
    convs = ordered(rows)
    want = plain(convs)
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in nodes.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    last = {r.conv: (r.conv_id, r.depth) for r in ends.collect()}
    assert len(last) == len(convs)
    for c, t in convs.items():
        assert last[c] == (min(x for x in convs if convs[x][: len(t)] == t), len(t))


def test_query_rebuilds_conversations(spark, tmp_path):
    rng = random.Random(5)
    rows = [(c + 100 * (c % 3), *x) for c, *x in conversations(rng, 40, 7)]  # some have no conversation c - c % 100
    rows += [(c, 0, "user", "one") for c in range(200, 230)]  # most are left without a turn of their own
    made(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    convs = ordered(rows)
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    assert [] in rebuilt.values()
    got = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in queries.op12_conversation_trie(spark, str(tmp_path)).collect()}
    assert got == plain(rebuilt)


def test_nothing(spark):
    assert trie.trie(trie.turns(made(spark, [])))[0].collect() == []
    one = trie.trie(trie.turns(made(spark, [])), spark.createDataFrame([(4,), (2,)], "conv long"))
    assert [tuple(r) for r in one[0].collect()] == [(2, 0, None, 2, 0, 1, 0)]
    assert sorted(tuple(r) for r in one[1].collect()) == [(2, 2, 0), (4, 2, 0)]


def test_numbers_are_dense(spark):
    df = spark.range(1000).repartition(7).selectExpr("id * 3 as v")
    rows = trie.numbered(df, "n").collect()
    assert sorted(r.n for r in rows) == list(range(1000)) and len({r.v for r in rows}) == 1000

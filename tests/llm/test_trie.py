"""The prefix trie against a dictionary of all prefixes."""

import collections
import hashlib
import random
import zlib

import pytest

from quillframe.llm import queries, trie

SPACE = "\x20\t\n\x0b\x0c\r"


def n_words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return len([w for w in text.split(" ") if w])


def ordered(turns):
    """conv_id -> [(role, text)] as documented: by turn, null first, then by the MD5 of role and text."""
    groups = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            groups[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [x[3:] for x in sorted(rows)] for c, rows in groups.items()}


def brute(convs):
    """Rows of the trie over conv_id -> [(role, text)]."""
    members, children, ends = collections.defaultdict(list), collections.defaultdict(set), collections.defaultdict(list)
    for c in sorted(convs):
        path = tuple(convs[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[:d - 1]].add(path[:d])
        ends[path].append(c)
    leaves, saved = collections.Counter(), collections.Counter()
    for path in sorted(members, key=len, reverse=True):
        leaves[path] += not children[path]
        saved[path] += (len(members[path]) - 1) * (n_words(path[-1][1]) if path else 0)
        if path:
            leaves[path[:-1]] += leaves[path]
            saved[path[:-1]] += saved[path]
    return sorted(
        (members[p][0], len(p), members[p[:-1]][0] if p else -1, len(members[p]), len(children[p]), leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p in members)


def found(rows):
    return sorted((*r[:2], -1 if r[2] is None else r[2], *r[3:]) for r in rows.collect())


COLUMNS = "conv_id long, turn long, role string, text string, name string, root string, words int"


def frame(spark, turns):
    return spark.createDataFrame([(*t, "n", "r", 0) for t in turns], COLUMNS)


def random_turns(seed, convs, most):
    rng = random.Random(seed)
    role_text = [(r, t) for r in ("user", "assistant", None) for t in ("Hi there.", "  ", None, "a b\nc", "yes")]
    turns = []
    for c in range(convs):
        for t in range(rng.randrange(1, most)):
            turns.append((c * 7 - 50, rng.choice([t, t, t, None, t // 2]), *rng.choice(role_text[:3] if t < 2 else role_text)))
    return turns


def nodes_of(spark, turns):
    seq = trie.sequences(frame(spark, turns))
    return found(trie.nodes(seq, seq.select("conv_id")))


@pytest.mark.parametrize("chunk", [1, 3, 2048])
def test_nodes_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(trie, "CHUNK", chunk)
    turns = random_turns(chunk, 60, 7) + [(None, 0, "user", "lost")]
    turns += [(9000 + i, 0, "system", "same") for i in range(20)] + [(9000 + i, 1, "user", "long " * 100_000) for i in range(0, 20, 2)]
    assert nodes_of(spark, turns) == brute(ordered(turns))


def test_long_conversations_share_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 5)
    monkeypatch.setattr(trie, "SPAN", 2)
    rng = random.Random(4)
    texts = [("user" if i % 2 == 0 else "assistant", f"text {i} " * (i % 5)) for i in range(500)]
    turns = []
    for c in range(60):
        length = rng.choice([1, 63, 64, 65, 127, 128, 129, 192, 300, 400])
        fork = rng.choice([0, 10, 63, 64, 65, 100, 128, 191, 500])
        turns += [(c, t, r, x + ("" if t < fork else f"fork{rng.choice('ab') if t == fork else ''}")) for t, (r, x) in enumerate(texts[:length])]
    assert nodes_of(spark, turns) == brute(ordered(turns))


def test_conversations_without_turns(spark):
    seq = trie.sequences(frame(spark, [(3, 0, "user", "one two")]))
    ids = spark.createDataFrame([(3,), (1,), (1,), (None,)], "conv_id long")
    digest = [hashlib.sha256(x).hexdigest() for x in (b"1", b"3")]
    assert found(trie.nodes(seq, ids)) == [(1, 0, -1, 2, 1, 1, 0, digest[0]), (3, 1, 1, 1, 0, 1, 0, digest[1])]
    assert found(trie.nodes(seq.limit(0), ids.limit(0))) == []


def test_query_on_its_table(spark, tmp_path):
    turns = [t for t in random_turns(8, 150, 6)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own, convs = ordered(turns), {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - abs(c) % 20 * (1 if c >= 0 else -1)
        convs[c] = own.get(base, [])[:h] + rows[h:]
    assert found(queries.QUERIES["op11_trie"](spark, str(tmp_path))) == brute(convs)

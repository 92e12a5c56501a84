"""SimHash groups, decontamination, quality rules and tool calls against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash

from quillframe.llm import decontamination, quality, simhash, toolcalls

LONG = " ".join(f"w{i % 977}" for i in range(30_000))


def union(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    runs = [b" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "a b c a b c a b", "É é   x y z", "𝄞 a\x0bb\x0cc d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == brute_fingerprint(text)


def planted(rng, n, copies):
    """Random fingerprints, each with copies some bits away, so that chains of links form."""
    found = set()
    for _ in range(n):
        at = rng.getrandbits(64)
        found.add(at)
        for _ in range(rng.randrange(copies)):
            for _ in range(rng.randrange(1, 5)):
                at ^= 1 << rng.randrange(64)
            found.add(at)
    return sorted(found)


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_forest_connects_what_lies_within_the_radius(radius):
    rng = random.Random(radius)
    fps = planted(rng, 12, 60)
    fps = fps + [fps[0] ^ 1 << b for b in range(64)]  # a dense star
    groups = np.array(sorted(rng.randrange(5) for _ in fps))
    array = np.array(fps, np.uint64)
    a, b = simhash.forest(groups, array, radius)
    at = collections.defaultdict(list)
    for i, f in enumerate(fps):
        at[f].append(i)
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if groups[i] == groups[j] and (fps[i] ^ fps[j]).bit_count() <= radius]
    near = {(f, g) for f, g in zip(a.tolist(), b.tolist())}
    assert len(near) <= len(fps)
    want = union(len(fps), pairs)
    place = {}
    for i, f in enumerate(fps):
        place.setdefault((groups[i], f), i)
    got = union(len(fps), [(i, j) for f, g in near for i in at[f] for j in at[g] if groups[i] == groups[j] and want[i] == want[j]])
    assert [want.index(x) for x in want] == [got.index(x) for x in got]


@pytest.mark.parametrize("tile", [4096, 4])
def test_links_and_components(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    fps = planted(random.Random(3), 60, 12)
    fps += [f ^ 3 for f in fps[:20]] + [1 << b for b in range(40)]
    fps = sorted(set(fps))
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    roots = {r["fp"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame(signed, "fp bigint"))).collect()}
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    want = union(len(fps), pairs)
    got = [roots.get(s[0], s[0]) for s in signed]
    assert [want.index(x) for x in want] == [got.index(x) for x in got]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 2000)], "a bigint, b bigint")
    got = {r["fp"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 2000: 1000}


def test_report_and_deduplication(spark):
    base = "the quick brown fox jumps over the lazy dog near the old river bank while seven wise owls watch from tall trees"
    rows = [(5, base, 1, "p"), (9, base.upper(), 2, "p"), (3, base + "\n", 3, "p"), (7, "something else", 4, "p"), (None, base, 5, "p")]
    rows += [(20, None, 6, "p"), (11, "", 7, "p"), (12, " \t", 8, "p"), (30, LONG, 9, "p"), (31, LONG, 10, "p"), (40, "twin", 11, "p"), (40, "twin", 11, "p")]
    rows += [(None, "no id", 12, "p")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp int, root string")
    got = collections.Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.report(docs).collect())
    one = {i: f"{brute_fingerprint(t):016x}" for i, t, *_ in rows if i is not None}
    comp = {5: 3, 9: 3, 3: 3, 7: 7, 20: 11, 11: 11, 12: 11, 30: 30, 31: 30, 40: 40}
    want = collections.Counter((i, one[i], comp[i]) for i, *_ in rows if i is not None)
    want.update([(None, one[5], 3), (None, f"{brute_fingerprint('no id'):016x}", None)])
    assert got == want
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r["fp"] for r in kept.collect()) == [3, 4, 7, 9, 11, 12]
    assert simhash.report(docs.limit(0)).count() == 0 and simhash.deduplicated(docs.limit(0)).count() == 0


def test_distinct_runs_count_once():
    assert simhash.fingerprint("b a a a", 1, repeats=False) == simhash.fingerprint("a b", 1)


def item_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    spaced = "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in low)
    return [x for x in spaced.split(" ") if x]


def brute_report(docs, items):
    windows = collections.defaultdict(set)
    for item, text in items:
        w = item_words(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i:i + n])].add(item)
    lengths = {len(k) for k in windows}
    for doc, text in docs:
        w, hit, found = item_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if items_here := windows.get(tuple(w[i:i + n])):
                    hit.update(range(i, i + n))
                    found |= items_here
        ids = sorted(str(x) for x in found if x is not None)
        yield (doc, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["a", "B", "c1", "Über", "д", "e", "f"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(i, text(rng.choice([1, 3, 4, 5, 7, 9, 10, 11, 14, 25]))) for i in range(60)]
    items += [(100, None), (101, ""), (102, " ,. "), (103, items[0][1]), (7, "extra row of item seven"), (None, text(12))]
    passages = [t for _, t in items if t and len(item_words(t)) > 2]
    docs = [(i, text(rng.randrange(0, 60)) + rng.choice(passages) * rng.randrange(2) + text(rng.randrange(5))) for i in range(150)]
    docs += [(500, None), (501, ""), (None, passages[3]), (502, LONG + " " + passages[5]), (503, passages[2]), (503, passages[2])]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id int, text string, w string, text_key int")
    bench = spark.createDataFrame([(*i, "y") for i in items], "item_id int, text string, mark string")
    got = collections.Counter(tuple(r) for r in decontamination.report(table, bench).collect())
    assert got == collections.Counter(brute_report(docs, items))
    clean = decontamination.clean(table, bench)
    assert clean.columns == table.columns
    assert collections.Counter(r["doc_id"] for r in clean.collect()) == collections.Counter(
        r[0] for r in brute_report(docs, items) if not r[5])


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words of a text"), (2, None)], "doc_id int, text string")
    none = spark.createDataFrame([], "item_id int, text string")
    assert [r["contaminated"] for r in decontamination.report(docs, none).collect()] == [False, False]
    assert decontamination.clean(docs, none).count() == 2
    assert decontamination.report(docs.limit(0), spark.createDataFrame([(1, "some words")], "item_id int, text string")).count() == 0


def brute_quality(docs, least_docs):
    blank = " \t\n\x0b\x0c\r"

    def split(t):
        return [x for x in "".join(" " if c in blank else c for c in t or "").split(" ") if x]

    def norm(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(split(line)))

    seen = collections.defaultdict(set)
    for _, text, host in docs:
        for line in (text or "").split("\n"):
            if split(line):
                seen[host or "", norm(line)].add(text)
    common = {k for k, v in seen.items() if len(v) > least_docs}
    for doc, text, host in docs:
        w = split(text)
        lines = [x for x in (text or "").split("\n") if split(x)]
        runs = collections.defaultdict(list)
        for i in range(len(w) - 2):
            runs[tuple(w[i:i + 3])].append(i)
        repeated = {p + j for v in runs.values() if len(v) > 1 for p in v for j in range(3)}
        removed = sum(len(split(x)) for x in lines if (host or "", norm(x)) in common)
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        yield (doc, len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)),
               len(repeated), removed, failed, not failed and 4 * (len(w) - removed) >= 3 * len(w))


def test_quality_equals_brute_force(spark):
    rng = random.Random(8)
    shared = ["Subscribe   NOW to our list", "subscribe now To our\tlist", "A footer line that many pages carry at their end " * 4]
    docs = []
    for i in range(200):
        lines = [" ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(0, 25))) for _ in range(rng.randrange(1, 6))]
        lines += rng.sample(shared, rng.randrange(3)) + rng.sample(["*** | $5 & <b>", "", "  "], 1)
        rng.shuffle(lines)
        docs.append((i, "\n".join(lines), rng.choice(["h1", "h1", "h1", "h2", None])))
    docs += [(300, None, "h1"), (301, "", None), (302, LONG, "h1"), (None, "𝄞𝄞 é", "h2")] + [(303, "copy of one text\n" * 30, "h2")] * 30
    docs += [(400 + i, docs[0][1], "h1") for i in range(50)]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id int, text string, source string, host string, lines int")
    got = collections.Counter(tuple(r) for r in quality.judge(table).collect())
    want = collections.Counter(brute_quality(docs, quality.LEAST_DOCS))
    assert got == want
    assert any(r[6] and not r[7] and not r[8] for r in want) and any(r[8] for r in want)
    assert quality.judge(table.limit(0)).count() == 0


CALLS = "conv_id int, turn int, call_id string, name string, arguments string, after string"
SCHEMAS = [("go", "to", "string", True), ("go", "far", "number", False), ("go", "list", "array", False), ("go", "o", "object", False)]


def linked(spark, calls, results):
    schemas = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean")
    rows = toolcalls.link(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, "conv_id int, turn int, call_id string, content string"), schemas)
    return {r["call_id"]: r for r in rows.collect()}


def test_tool_calls(spark):
    calls = [
        (1, 0, "a", "go", '{"to":"x","far":1.5,"o":{"z":1,"b":[ 1, null]}}', None), (1, 2, "b", "go", '{"far":"no","odd":1}', "a"),
        (1, 4, "c", "fly", "{}", "b"), (2, 0, "d", "go", "not json", "unknown"), (2, 1, "e", "go", '["to"]', "f"), (2, 2, "f", "go", None, "e"),
        (2, 3, "g", "go", '{"to":null}', "f"), (3, 9, "h", "go", '{"to":"second"}', None), (3, 1, "h", "go", '{"to":"first"}', None),
        (3, 1, None, "go", "{}", None)]
    results = [(1, 1, "a", 'said "yes"\n'), (1, 3, "b", None), (9, 1, "z", "late"), (3, 2, "h", "r1"), (3, 3, "h", "r2"), (3, 3, None, "r")]
    got = linked(spark, calls, results)
    assert {k: r["status"] for k, r in got.items()} == {
        "a": "linked", "b": "linked", "c": "unanswered", "d": "unanswered", "e": "unanswered", "f": "unanswered", "g": "unanswered",
        "h": "linked", "z": "orphan"}
    assert {k: r["depth"] for k, r in got.items()} == {
        "a": 0, "b": 1, "c": 2, "d": 0, "e": None, "f": None, "g": None, "h": 0, "z": None}
    assert [k for k, r in got.items() if r["cyclic"]] and {k for k, r in got.items() if r["cyclic"]} == {"e", "f", "g"}
    assert got["a"]["record"] == (
        '{"arguments":{"far":1.5,"o":{"b":[1,null],"z":1},"to":"x"},"call_id":"a","errors":[],"name":"go",'
        '"result":"said \\"yes\\"\\n","status":"linked"}')
    assert '"errors":["missing parameter to","not of type number: far","unknown parameter odd"]' in got["b"]["record"]
    assert '"errors":["unknown tool"]' in got["c"]["record"]
    assert '"errors":["arguments are not an object"]' in got["d"]["record"] and '"arguments":null' in got["d"]["record"]
    assert got["h"]["n_calls"] == 2 and got["h"]["n_results"] == 2 and '"to":"first"' in got["h"]["record"] and '"r1"' in got["h"]["record"]
    assert got["g"]["n_errors"] == 1
    assert linked(spark, [], []) == {}


def test_depth_of_a_long_chain(spark):
    calls = [(1, i, f"c{i}", "go", '{"to":"x"}', f"c{i - 1}") for i in range(200)]
    got = linked(spark, calls, [])
    assert all(got[f"c{i}"]["depth"] == i for i in range(200))

"""Language identification, toxicity, token counts and archives."""

import base64
import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from quillframe.llm import langid, tokens, toxicity, warc
from quillframe.llm.queries import QUERIES
from quillframe.session import scratch_path

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = "lorem ipsum " * 20_000


def is_held_out(doc_id, parts, part):
    return zlib.crc32(str(doc_id).encode()) % parts == part


def test_presence_rows_give_kernel_values():
    a, b = langid.presence(["abc", "abd"])
    grams = [{x[i:i + n] for n in range(1, 5) for i in range(len(x) - n + 1)} for x in ("abc", "abd")]
    assert a @ b == pytest.approx(len(grams[0] & grams[1]) / np.sqrt(len(grams[0]) * len(grams[1])), abs=1e-6)
    assert not langid.presence([""]).any()


def test_collapsed_weights_score_like_the_kernel():
    rng = random.Random(0)
    texts = ["".join(rng.choice("abcde " if i % 2 else "cdefg ") for _ in range(80)) for i in range(40)]
    langs = ["x" if i % 2 else "y" for i in range(40)]
    model = langid.train(texts, langs, landmarks_per_lang=20, ridge=1e-6)
    values = langid.presence(texts) @ model.weights
    assert [model.langs[i] for i in values.argmax(axis=1)] == langs


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op6_language"](spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == is_held_out(r["doc_id"], 5, 0) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert np.mean([r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held]) > 0.95


def test_language_edge_rows(spark):
    schema = "doc_id int, text string, lang string, score string, _row int, lang_pred int"
    rows = [(i, "the cat sat on that mat" if i % 2 else "der Hund und die Katze", "en" if i % 2 else "de", "s", 1, 2) for i in range(40)]
    rows += [(50, None, "en", None, None, None), (51, "", None, None, None, None), (52, "12 !? 34", "de", None, None, None),
             (None, "die und der", None, None, None, None), (53, LONG, "en", None, None, None), (53, LONG, "en", None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    found = langid.identify(docs, langid.fit(docs))
    assert found.columns == ["doc_id", "text", "lang", "_row", "lang_pred", "score"]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found.collect()}
    assert got[50] == got[51] == got[52] == ("und", 0.0)
    assert got[None][0] == "de" and got[1][0] == "en" and found.count() == len(rows)
    nothing = langid.identify(docs, langid.fit(docs.limit(0)))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}
    assert langid.identify(docs.limit(0), langid.fit(docs)).count() == 0


def brute_subwords(text):
    words = text.encode().lower().split()
    return collections.Counter((i, n) for i, w in enumerate(words) for n in toxicity.GRAMS for _ in range(max(0, len(w) + 3 - n)))


@pytest.mark.parametrize("text", ["", " ", "a", "ab cd", " Über  die\nBrücke ", "abcdefgh i jk lmno"])
def test_subwords_stay_inside_words(text):
    buckets, words, n = toxicity.subwords(text)
    assert n == len(text.split()) and len(buckets) == len(words)
    want = collections.Counter()
    for (i, _), c in brute_subwords(text).items():
        want[i] += c
    assert collections.Counter(words.tolist()) == want


def test_same_word_has_the_same_subwords():
    one, two = toxicity.subwords("xx TOXIC yy")[0], toxicity.subwords("toxic")[0]
    assert set(two.tolist()) <= set(one.tolist())


@pytest.mark.parametrize("text", ["", "one", "Ber " * 60, " ".join(f"w{i % 23} x{i}" for i in range(100)), "a b c d e f g h i j k l m n o p a q r"])
def test_scores_equal_brute_force(text):
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(0, 1, 1 << toxicity.BUCKET_BITS), 0.25, 0.1)
    words = text.lower().split()
    sums = [sum(model.weights[b] for b in toxicity.subwords(w)[0]) if w not in words[max(0, i - 15):i] else 0.0 for i, w in enumerate(words)]
    sizes = [len(toxicity.subwords(w)[0]) for w in words]
    found = [sum(sums[a:a + 16]) / max(sum(sizes[a:a + 16]), 100) for a in range(0, max(1, len(words) - 8), 8)] if words else []
    got = toxicity.logit(model, text)
    assert got is None if not found else abs(got - max(found) - 0.25) < 1e-9


def test_most_toxic_rows_that_were_held_out_are_found():
    """Recall at 0.7 of 0.85 or more (0.9 as measured) with at most 2 % false alarms on the rows of the largest test table."""
    folder = "/root/testdata/sf0.1"
    text = dict(zip(*pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict().values()))
    toxic = {i: y for i, y in zip(*pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values()) if text.get(i)}
    learned = sorted(i for i in toxic if not is_held_out(i, 3, 1))
    model = toxicity.calibrated([text[i] for i in learned], [toxic[i] for i in learned])
    hit = {i: (toxicity.logit(model, text[i]) or -9) >= np.log(0.7 / 0.3) for i in toxic if is_held_out(i, 3, 1)}
    assert np.mean([hit[i] for i in hit if toxic[i]]) >= 0.85
    assert np.mean([hit[i] for i in hit if not toxic[i]]) <= 0.02


def corpus(n, seed):
    rng = random.Random(seed)
    clean = ["".join(rng.choice(["ka", "lo", "mi", "te", "su"]) for _ in range(rng.randrange(1, 4))) for _ in range(300)]
    rows = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(20, 300))]
        toxic = int(rng.random() < 0.3)
        for _ in range(2 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["vile", "scum"]) + rng.choice(["x", "y", "zz", ""])
        rows.append((i, " ".join(words), toxic))
    return rows


def test_toxicity_learns_and_generalises():
    train, test = corpus(400, 1), corpus(300, 2)
    model = toxicity.train([r[1] for r in train], [r[2] for r in train])
    scores = np.array([toxicity.logit(model, r[1].replace("vile", "vileq")) for r in test])
    labels = np.array([r[2] for r in test])
    assert scores[labels == 1].min() > np.quantile(scores[labels == 0], 0.95)


def test_toxicity_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 10)
    rows = [(i, t, y, "a", 0.5) for i, t, y in corpus(120, 4)]
    rows += [(900, None, 0, "a", 0.5), (901, "", 1, None, None), (902, "x", None, None, None), (903, LONG, 0, None, None), (None, "y", 1, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, toxic int, label string, score double")
    labels = docs.select("doc_id", "toxic", "label")
    found = toxicity.score(docs, toxicity.fit(docs, labels))
    assert found.columns == ["doc_id", "text", "toxic", "label", "score"] and found.count() == len(rows)
    got = {r["doc_id"]: r["score"] for r in found.collect()}
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    untrained = toxicity.score(docs, toxicity.fit(docs.limit(0), labels))
    assert {round(r["score"], 6) for r in untrained.collect()} == {0.5}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_toxicity_query(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = QUERIES["op4_toxicity"](spark, FOLDER).collect()
    assert all(r["held_out"] == is_held_out(r["doc_id"], 3, 1) and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    learned = [r for r in rows if not r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in learned]) > 0.9


def library():
    return Tokenizer.from_file(VOCABULARY)


def test_token_counts_equal_the_library_on_odd_texts():
    rng, merger, other = random.Random(1), tokens.Merger(VOCABULARY), library()
    parts = [*"ab Z1'\n\t\x1c\x85 é漢🙂٣½_", "'ll", "  ", "<|endoftext|>", "<|endoftext", "don't", "\r\n", " the", "12345"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert merger.count(text) == len(other.encode(text, add_special_tokens=False).ids), repr(text)


def test_token_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 4)
    merger = tokens.Merger(VOCABULARY)
    assert merger.count("one two three four five six seven") == 7 and len(merger.known) <= 4


def test_token_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    want = {i: len(e.ids) for i, e in zip(texts, library().encode_batch(list(texts.values()), add_special_tokens=False))}
    for r in QUERIES["op7_tokens"](spark, FOLDER).collect():
        assert (r["n_tokens"], r["n_bytes"]) == (want[r["doc_id"]], len(texts[r["doc_id"]].encode()))
        assert r["over_limit"] == (r["n_tokens"] > 1024)


def test_token_edge_rows(spark):
    rows = [(1, None, 5), (2, "", 5), (3, LONG, 5), (3, LONG, 5), (None, "\x00 ퟿", 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_tokens int")
    got = tokens.count_tokens(docs, VOCABULARY)
    assert got.columns == ["doc_id", "text", "n_tokens"]
    other = library()
    assert sorted(r["n_tokens"] for r in got.collect()) == sorted(len(other.encode(t or "").ids) for _, t, _ in rows)
    assert tokens.count_tokens(docs.limit(0), VOCABULARY).count() == 0


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def brute_archive(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    for i, _, html in rows:
        other = first.get(html or "")
        again = other is not None and other != i
        yield (i, len((html or "").encode()), digest(html), "revisit" if again else "response", other if again else None)


PAGES = "page_id bigint, url string, html string, sha1 string, first int"


def test_archives_round_trip(spark):
    rng = random.Random(2)
    bodies = [f"<html><body>{' '.join(rng.choice(['alpha', 'beta', 'é', '漢']) for _ in range(rng.randrange(200)))}</body></html>" for _ in range(150)]
    rows = [(i, f"http://h{i % 3}/a b?q={i}\n", rng.choice(bodies)) for i in range(400)]
    rows += [(1000, None, None), (999, None, ""), (1001, "u", LONG), (1002, "u", "\r\n\r\nWARC/1.1\r\n\x00"), (None, "x", bodies[0]), (None, None, "only")]
    rows += [(2000, "twice", "twin"), (2000, "twice", "twin")]
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows], PAGES).repartition(3)
    got = collections.Counter(tuple(r) for r in warc.round_trip(pages).collect())
    assert got == collections.Counter(brute_archive(rows))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_smaller_payloads_are_responses(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa"), (-7, "u", "aaaa")]
    got = {r["page_id"]: r["refers_to"] for r in warc.round_trip(spark.createDataFrame([(*r, "s", 1) for r in rows], PAGES), 3).collect()}
    assert got == {1: None, 2: None, 3: -7, 4: -7, -7: None}


def test_archive_layout(spark):
    """A leading skippable frame holds the dictionary; every record is a frame that needs no other."""
    rows = [(i, f"http://h/{i}", f"<html><title>page {i}</title>{'same words on every page ' * 8}{i * 7919}</html>") for i in range(300)]
    path = scratch_path(spark, "layout")
    warc.write(spark.createDataFrame([(*r, "s", 1) for r in rows], PAGES).coalesce(1), path)
    files = [bytes(r["content"]) for r in spark.read.format("binaryFile").load(path).collect() if r["length"]]
    assert len(files) == 1 and files[0].startswith(warc.DICT_MAGIC)
    size = int.from_bytes(files[0][4:8], "little")
    trained = zstandard.ZstdCompressionDict(files[0][8:8 + size])
    assert trained.dict_id()
    body = files[0][8 + size:]
    whole = zstandard.ZstdDecompressor(dict_data=trained).stream_reader(body, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 300
    records = list(warc.unframed(files[0]))
    assert len(records) == 300 and b"".join(records) == whole
    plain = zstandard.ZstdCompressor(level=warc.LEVEL)
    assert len(body) < 0.5 * sum(len(plain.compress(r)) for r in records)
    with pytest.raises(ValueError):
        list(warc.unframed(files[0][:-40]))
    with pytest.raises(ValueError):
        warc.parsed(records[0].replace(b"same words", b"some words"))

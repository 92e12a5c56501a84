"""The texts without common lines, from which op9_quality derives its figures."""

from quillframe.llm import quality


def test_cleaned_texts_lose_the_common_lines_only(spark):
    rows = [(i, f"own  line {i}\nSubscribe   NOW\n\nlast {i}\nsubscribe now", "h1", i) for i in range(12)]
    rows += [(20, "Subscribe now\nstays here", "h2", 0), (21, None, "h1", 0), (22, "subscribe now", "h1", 0), (23, "own", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, source string, n int")
    clean = quality.cleaned(docs)
    assert clean.columns == docs.columns
    want = {i: (f"own  line {i}\n\nlast {i}", "h1", i) for i in range(12)}
    want |= {20: ("Subscribe now\nstays here", "h2", 0), 21: (None, "h1", 0), 22: ("", "h1", 0), 23: ("own", None, 0)}
    assert {r[0]: tuple(r[1:]) for r in clean.collect()} == want
    removed = {r["doc_id"]: r["removed_words"] for r in quality.judge(docs).collect()}
    assert removed == {i: 4 if i < 12 else 2 if i == 22 else 0 for i in want}

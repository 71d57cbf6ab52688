"""The pipeline's stages against plain Python."""

import corpus_pipeline as P
from feedloom.llm import line_dedup
from test_operators import brute_components, edit


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        rows = {r["doc_id"]: r for r in out.collect()}
        assert set(rows) <= set(seen)
        if name.startswith("SentencePiece"):
            assert set(rows) == set(seen) and all(r["ids"][-1] == 2 for r in rows.values())
            assert all(r["decoded"] == seen[k].replace("▁", " ") for k, r in rows.items())
            break
        assert out.columns == P.COLUMNS
        if name == "line dedup":
            before = []
            for k in sorted(seen):
                kept = []
                for line in seen[k].split("\n"):
                    long = len(line) >= line_dedup.LEAST
                    again = line and line in before or long and any(len(o) >= line_dedup.LEAST and ((abs(len(line) - len(o)) <= 2 and line[:8] == o[:8] and edit(line, o) <= 2) or line_dedup.within(line, o, 2)) for o in before)
                    if not again:
                        kept.append(line)
                    before.append(line)
                stays = kept == seen[k].split("\n") or any(map(str.strip, kept))
                assert (k in rows) == stays and (not stays or rows[k]["text"] == "\n".join(kept))
        if name.startswith("n-gram"):
            want = brute_components([(k, t) for k, t in seen.items()])
            assert set(rows) == {k for k, (_, root) in want.items() if root == k}
        docs = P.saved(out, "stage")
        seen = {k: r["text"] for k, r in rows.items()}


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_near_duplicates_of_rows_that_share_ids(spark, sf):
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "abc")
    rows = [(1, one), (1, one), (2, two), (2, one), (None, three), (None, three), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = [(r["doc_id"], r["text"]) for r in P.near_duplicates(spark, docs, sf).collect()]
    assert sorted(out, key=str) == sorted([(1, one), (2, two), (None, three), (7, None), (7, None)], key=str)

import re

import pytest

import corpus_pipeline
from stratacut.llm import packing


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        seen.append({r.doc_id: r for r in docs.select("doc_id", "text", "n_chars").collect()})
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and docs.where("n_chars <> length(text)").count() == 0
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all((d in seen[1]) == (y == 1) for d, y in labels.items() if d in seen[0])
    assert seen[1].keys() == seen[2].keys() and len(seen[3]) < len(seen[2]) and seen[3].keys() == seen[4].keys()
    words = lambda t: re.findall(r"[0-9a-z]+|[^\x00-\x7f]+", t.lower())
    bench = {" ".join(words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    assert not any(b in " ".join(words(r.text)) for r in seen[4].values() for b in bench)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == seen[4].keys()
    expect = sorted(tuple(r) for r in packing.pieces(spark.read.parquet(f"{tmp_path}/3")).select("doc_id", "piece", "ids_crc32").collect())
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in docs.collect()) == expect


LONG = "a line that several documents share, word for word and to the end"


def odd_rows(spark, sf):
    """Rows of every odd kind, with columns whose names the stages use themselves."""
    texts = [(1, None), (2, ""), (3, LONG), (3, LONG), (4, f"{LONG}\nown words of the fourth"), (5, f"{LONG}\n" + "many words follow here " * 5000), (None, "no id, but a text"), (None, None), (6, " \n\t\n ")]
    rows = [(d, t, "en", "s", None if t is None else len(t), 0.5, 7, 8, 9, b"x", "y", 1) for d, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, quality_score double, n_lines int, class_id int, _id int, _gone binary, n_words string, _class int")


@pytest.mark.parametrize("k", range(5))
def test_stages_take_odd_rows(spark, sf, k):
    docs, (_, stage) = odd_rows(spark, sf), corpus_pipeline.STAGES[k]
    out = stage(spark, docs, sf)
    rows = out.collect()
    if k < 4:
        assert out.columns == docs.columns
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows) and all(r.class_id == 8 and r._id == 9 and r._class == 1 for r in rows)
    ids = sorted(r.doc_id or 0 for r in rows)
    if k in (1, 3):
        assert ids == [0, 0, 1, 2, 3, 3, 4, 5, 6]
    if k == 1:
        assert [r.text for r in rows if r.doc_id == 4] == ["own words of the fourth"] and [r.text for r in rows if r.doc_id == 3] == ["", ""]
    if k == 2:
        assert ids == [0, 0, 1, 2, 3, 4, 5, 6]  # equal rows of one id are one document
    if k == 4:
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) and set(ids) == {0, 1, 2, 3, 4, 5, 6}
    assert stage(spark, docs.limit(0), sf).count() == 0


def test_registered(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 14)} == {m[0] for x in names if (m := re.match(r"op\d+_", x))} and "pipeline" in names
    assert __spark_entry__.oracle_sql().keys() <= names.keys()

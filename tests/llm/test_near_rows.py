import corpus_pipeline as P

A, B = (" ".join(f"{c}{i}" for i in range(80)) for c in "ab")


def test_one_row_of_a_group(spark):
    """Repeated rows, null ids, and a row that shares its id with a dropped copy but has another text."""
    rows = [(1, A), (1, A), (1, A), (None, A + " x"), (None, A + " x"), (2, A + " y"), (2, B), (None, B + " z"), (7, None), (7, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.keep_one_of_near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted([(1, A), (2, B), (7, None), (7, None)], key=repr)

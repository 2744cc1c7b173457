from opinaria.llm import secrets as S


def test_repositories_enter_the_verdict(spark):
    """One owner's values, in one, three, four and very many repositories; two owners' in very many; repeated rows in one."""
    rows = [("wide", "o", f"r{i}") for i in range(200)] + [("some", "o", f"r{i}") for i in range(4)] + [("threes", "o", f"r{i}") for i in range(3)]
    rows += [("one", "o", "r")] * 30 + [("double", f"o{i % 2}", f"r{i}") for i in range(40)]
    docs = spark.createDataFrame([(i, f"password={v}value99", r, o) for i, (v, o, r) in enumerate(rows)], "doc_id long, text string, repo string, source string")
    got = {}
    for r in S.scan(docs, repo="repo").collect():
        got.setdefault(rows[r.doc_id][0], set()).update(r.verdicts.values())
    assert got == {"wide": {"example"}, "some": {"shared"}, "threes": {"live"}, "one": {"live"}, "double": {"example"}}

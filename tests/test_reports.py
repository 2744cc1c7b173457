from opinaria import plans as P


def test_reports_name_every_user(spark):
    """More users than the 10,000 that the reports once named, in order."""
    rows = spark.range(24_000).selectExpr("cast(id % 12000 as string) user_id", "5.0 stars", "'same' text").union(spark.range(3).selectExpr("'most'", "5.0", "'same'"))
    want = ["most (3)", *(f"{u} (2)" for u in sorted(map(str, range(12_000))))]
    for report in (P.report_best_users(rows, 2), P.report_bot_users(rows, 2)):
        assert report.first()[0].split(": ", 1)[1].split(" ; ") == want
    assert P.report_best_users(rows, 9).first()[0] == "Users with +9 reviews (only 5-stars): no users accomplish that requirements."

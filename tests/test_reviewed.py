from opinaria.plans import catalog, testviews as V

SF = "/root/testdata/sf0.01"


def test_all_reviews_count(spark):
    """Every review's business is found, those of the order keys from 10 on too."""
    named = {x.business_id for x in V.reviews(spark, SF).select("business_id").distinct().collect()}
    few = {x.business_id for x in V.reviews_by_order(spark, SF).where("user_id < 10").select("business_id").distinct().collect()}
    got = [x.business_id for x in catalog.queries()["reviewed_businesses_all"](spark, SF).collect()]
    assert sorted(got) == sorted(named) and len(few) < len(named)
    print(len(few), len(named))

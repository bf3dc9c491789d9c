from driver import candidate_queries as Q


def test_terms_are_numbered_without_gaps(spark):
    rows = Q.union_terms(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.load_order for r in rows) == list(range(1, len(rows) + 1))
    by_place = sorted(rows, key=lambda r: r.load_order)
    assert [r.tier for r in by_place] == sorted((r.tier for r in rows), key=["stable", "experimental", "temporary"].index)

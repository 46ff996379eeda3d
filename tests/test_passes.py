"""Key passes over business records, and densities of a country without labels."""

from loamweave.operators import blocking, decide

FIELDS = "entity_id long, country string, name_compact string, name_key string, addr_key string, addr_norm string"


def test_record_passes(spark):
    q = [(1, "US", "redbakery", "red bakery", "5 elm st", "5 elm st"), (2, "US", "abcde", "abcde", "elm st main", "elm st main"), (3, "US", "", "", "7 elm", "7 elm")]
    p = [
        (10, "US", "other", "other", "5 elm st", "5 elm st"), (11, "US", "redbakery", "x", "", "z"), (12, "US", "y", "red bakery", "", ""),
        (13, "US", "abcde", "y", "elm st main", "z"), (14, "India", "redbakery", "red bakery", "5 elm st", ""), (15, "US", "", "", "7 elm", ""),
    ]
    got = {tuple(r) for r in blocking.record_passes(spark.createDataFrame(q, FIELDS), spark.createDataFrame(p, FIELDS)).collect()}
    assert got == {(1, 10, 1, 0, 0), (1, 11, 0, 1, 0), (1, 12, 0, 0, 1)}


def test_density_of_a_country_without_labels(spark):
    schema = "s1_id long, country string, prob double, label int"
    val = spark.createDataFrame([(1, "a", 0.9, 1), (2, "a", 0.9, 0), (3, "b", 0.9, 1), (4, "b", 0.2, 0)], schema)
    test = spark.createDataFrame([(5, "a", 0.9, 0), (6, "b", 0.9, 0), (7, "c", 0.9, 0), (8, "c", 0.2, 0)], schema)
    n_val, n_test = (spark.createDataFrame(rows, f"country string, {n} long") for n, rows in (("n_val", [("a", 2), ("b", 2)]), ("n_test", [("a", 1), ("b", 1), ("c", 2)])))
    got = {(r.country, r.band): r.rate for r in decide.density(val, test, n_val, n_test, [0.5]).collect()}
    assert got == {("a", 1): 0.5, ("b", 1): 0.5, ("c", 1): 1.0, ("c", 0): 0.0}

from presswork.operators.skew import heavy_keys, key_shares, per_key_summary

SCHEMA = "a string, b string, story string, at timestamp, field_name string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def test_hot_key_missing_values_and_exact_threshold(spark):
    data = [("hot", "x", f"s{i % 3}", None, "clash") for i in range(40)] + [(None, " ", None, None, None), ("", "y", "s", None, None)] + [(f"k{i}", None, None, None, None) for i in range(58)]
    got = {(r.field_name, r.key_value): (r["items"], r.total) for r in key_shares(rows(spark, data), ["a", "b"]).collect()}
    assert got[("a", "hot")] == (40, 100) and ("a", "") not in got and ("b", " ") not in got
    assert {r.key_value for r in heavy_keys(rows(spark, data), ["a"], 0.4).collect()} == {"hot"}
    assert heavy_keys(rows(spark, data), ["a"], 0.41).count() == 0


def test_summary_counts_distinct_stories_and_ignores_null_times(spark):
    got = {r.key_value: r for r in per_key_summary(rows(spark, [("h", None, "s1", None, None), ("h", None, "s1", None, None), ("h", None, None, None, None)]), ["a"], "story", "at").collect()}
    assert (got["h"]["items"], got["h"].stories, got["h"].first_at) == (3, 1, None)


def test_empty_table(spark):
    empty = rows(spark, [])
    assert key_shares(empty, ["a"]).count() == 0 and per_key_summary(empty, ["a"], "story", "at").count() == 0

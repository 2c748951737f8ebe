"""Alias candidates: blocks of keys meet once, and equal names count once, with the results of all pairs."""

from pyspark.sql import functions as F

from pricelens.plans import joins as J


def _grams(key):
    return {f" {key} "[i:i + 2] for i in range(len(key) + 1)}


def _alike(a, b):
    return 2.0 * len(_grams(a) & _grams(b)) / (len(_grams(a)) + len(_grams(b)))


def test_blocks_give_the_most_alike_of_all_pairs(spark):
    keys, others = [f"kalor{chr(97 + i)}en" for i in range(9)], [f"kal{chr(97 + i)}ren" for i in range(23)]
    x = lambda rows, *more: spark.createDataFrame(rows, ", ".join(["league int", "key string", *more])).withColumn("grams", J.name_grams(F.col("key")))
    got = J.most_alike(x([(1, k) for k in keys]), x([(1, k, i) for i, k in enumerate(others)], "first int"), 0.4, 3, block=1).collect()
    for k in keys:
        best = sorted(((-_alike(k, o), i, o) for i, o in enumerate(others) if _alike(k, o) >= 0.4))[:3]
        mine = sorted((-r.similarity, others.index(r.other), r.other) for r in got if r.key == k)[:3]
        assert mine == best


def test_equal_names_and_aliases(spark):
    """Clubs of one name are candidates by their numbers, for every feed that writes it the same way."""
    names = [(100 - i, 1, "Kalor United") for i in range(20)] + [(200, 1, "Kalor Town"), (7, 2, "Kalor United")]
    got = J.alias_candidates(spark.createDataFrame([(1, 1, "Kalor Unite"), (2, 1, "Kalor Unite"), (3, 1, "")], "feed int, league int, alias string"), spark.createDataFrame(names, "club int, league int, name string")).collect()
    assert sorted((r.feed, r.place, r.club) for r in got) == [(f, p + 1, 81 + p) for f in (1, 2) for p in range(8)]

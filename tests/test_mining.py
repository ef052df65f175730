import random

from pyspark.sql import functions as F

from conftest import SF_SMALL
from setscope.operators import mining
from setscope.sources import bindings as B
from setscope.sources.memberships import itemsets


def test_predict_missing_equals_mllib_transform(spark):
    m, _ = B.order_parttype(spark, SF_SMALL)
    items = itemsets(m)
    model = mining.fit_fpgrowth(items, 0.05, 0.5)
    ours = {(tuple(r.archives), tuple(r.prediction))
            for r in mining.predict_missing(items, mining.association_rules(model)).collect()}
    ref = {(tuple(r.archives), tuple(sorted(r.prediction)))
           for r in model.transform(items.select("archives")).filter(F.size("prediction") >= 1).distinct().collect()}
    assert ours == ref and len(ours) > 0


def brute_fired(sets, rules):
    out = {}
    for s in set(sets):
        got = {c for a, cq in rules if set(a) <= set(s) for c in cq} - set(s)
        if got:
            out[s] = tuple(sorted(got))
    return out


def frames(spark, sets, rules):
    return (spark.createDataFrame([(list(s) if s is not None else None,) for s in sets], "archives array<int>"),
            spark.createDataFrame([(list(a), list(c), 1.0) for a, c in rules],
                                  "antecedent array<int>, consequent array<int>, confidence double"))


def test_predict_missing_equals_loops_over_random_rules(spark):
    rnd = random.Random(9)
    sets = [tuple(sorted(rnd.sample(range(12), rnd.randrange(0, 8)))) for _ in range(150)] + [(0,)] * 40
    rules = [(rnd.sample(range(13), rnd.randrange(1, 6)), [rnd.randrange(14)]) for _ in range(60)]
    items, frame = frames(spark, [*sets, None], rules)
    got = {tuple(r.archives): tuple(r.prediction) for r in mining.predict_missing(items, frame).collect()}
    assert got == brute_fired(sets, rules) and got


def test_predict_missing_without_rules_or_itemsets(spark):
    items, none = frames(spark, [(1, 2)], [])
    assert mining.predict_missing(items, none).collect() == []
    nothing, rules = frames(spark, [], [((1,), (2,))])
    assert mining.predict_missing(nothing, rules).collect() == []


def test_an_itemset_meets_only_the_rules_whose_prefix_it_holds(spark):
    # all 200 rules begin with the hot code, and 100 itemsets hold one second code each, so that all codes but it are rare
    rules = [((1, 100 + i, 500 + i % 7), (900,)) for i in range(200)]
    sets = [(1, 100 + i, 500 + i % 7) for i in range(100)] + [(1, 2, 3000 + i) for i in range(300)]
    items, frame = frames(spark, sets, rules)
    spread = items.select(F.explode("archives").alias("code")).groupBy("code").count().withColumnRenamed("count", "n")
    tree = mining.rule_tree(frame, spread)
    # rules with a code that no itemset holds are gone; every path is three edges, none shared with another one
    assert tree.count() == 300
    met = mining.descend(items, tree, spread)
    assert met.count() == 300 and met.where("ends").count() == 100
    # turned round: one rare code with 200 rules behind it; an itemset that holds it meets its own one only
    rules = [((1, 100 + i), (900,)) for i in range(200)]
    sets = [(1, 100 + i) for i in range(200)] + [(100 + i, 2000 + j) for i in range(200) for j in range(2)]
    items, frame = frames(spark, sets, rules)
    spread = items.select(F.explode("archives").alias("code")).groupBy("code").agg(F.lit(1).cast("long").alias("n"))
    tree = mining.rule_tree(frame, spread)
    assert tree.count() == 201
    assert mining.descend(items, tree, spread).count() == 200 + 200


def test_frequent_itemsets_sorted_and_min_size(spark):
    m, _ = B.order_parttype(spark, SF_SMALL)
    model = mining.fit_fpgrowth(itemsets(m), 0.05, 0.5)
    rows = mining.frequent_itemsets(model).collect()
    assert rows and all(len(r.item) >= 2 and list(r.item) == sorted(r.item) for r in rows)


def test_rules_report_columns(spark):
    m, reg = B.order_parttype(spark, SF_SMALL)
    rep = mining.rules_report(itemsets(m), reg)
    assert rep["frequencies"].columns == ["item", "freq", "item_description"]
    assert rep["confidences"].columns == ["antecedent", "consequent", "confidence",
                                          "antecedent_description", "consequent_description"]
    assert rep["predictions"].columns == ["archives", "prediction", "archives_description",
                                          "prediction_description"]


def test_weighted_mining_equals_mllib(spark):
    rnd = random.Random(2)
    codes = [f"c{i:02d}" for i in range(9)]
    sets = [tuple(sorted(c for i, c in enumerate(codes) if rnd.random() < 0.8 / (1 + i / 2))) for _ in range(400)] + [(), None]
    items = spark.createDataFrame([(list(s) if s is not None else None,) for s in sets], "archives array<string>")
    for support, confidence in ((0.02, 0.3), (0.3, 0.5), (1.0, 0.9)):
        ref = mining.fit_fpgrowth(items, support, confidence)
        got = mining.mine(mining.weighted_itemsets(items), support, confidence)
        own = lambda rows: sorted((*map(tuple, map(sorted, r[:-1])), r[-1]) for r in rows)
        assert own(got.freqItemsets.collect()) == own(ref.freqItemsets.select("items", "freq").collect())
        assert own(got.associationRules.collect()) == own(ref.associationRules.select(
            "antecedent", "consequent", "confidence").collect())
    none = mining.mine(mining.weighted_itemsets(items.limit(0)), 0.1, 0.1)
    assert none.freqItemsets.collect() == none.associationRules.collect() == []


def test_reports_read_the_subjects_once(spark):
    """Mining and prediction read the written distinct itemsets: a million equal subjects are one row."""
    m, reg = B.order_parttype(spark, SF_SMALL)
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    items = itemsets(m).select("archives")
    rep = mining.rules_report(items.mapInArrow(counted, items.schema), reg)
    assert sum(df.count() > 0 for df in rep.values()) == 3
    assert reads.value == items.count()

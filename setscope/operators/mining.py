"""Frequent itemsets, association rules and rule-based predictions (M1-M3, T5)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth, FPGrowthModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setscope.functions.arrays import array_text
from setscope.operators.describe import describe_array
from setscope.session import materialize

#: The datasets of ``rules_report``.
REPORTS = ("frequencies", "confidences", "predictions")


def fit_fpgrowth(items: DataFrame, min_support: float, min_confidence: float,
                 items_col: str = "archives") -> FPGrowthModel:
    """MLlib parallel FP-growth over one transaction per subject.

    Items must be distinct within a transaction, which ``itemsets`` ensures.
    The support threshold counts transactions: ceil(min_support * n).
    """
    fp = FPGrowth(itemsCol=items_col, minSupport=min_support, minConfidence=min_confidence)
    return fp.fit(items.select(items_col))


@dataclass
class MinedRules:
    """What ``mine`` finds, named as in MLlib's model."""

    #: items (sorted array), freq
    freqItemsets: DataFrame
    #: antecedent, consequent (one code), confidence
    associationRules: DataFrame


def weighted_itemsets(items: DataFrame, items_col: str = "archives") -> DataFrame:
    """(archives, weight): every distinct itemset with its number of subjects; null ones are left out."""
    return (items.where(F.col(items_col).isNotNull()).groupBy(F.col(items_col).alias("archives"))
            .agg(F.count(F.lit(1)).alias("weight")))


def mine(sets: DataFrame, min_support: float, min_confidence: float) -> MinedRules:
    """Frequent itemsets and rules of (archives, weight), as FP-growth finds them over one transaction per subject.

    Equal itemsets are one row throughout, so the work follows the distinct
    ones and not the subjects, which MLlib's FP-growth cannot do. Codes of
    an itemset lie rarest first. A level extends every frequent path by one
    of the codes behind it; rows that have the same path and the same codes
    left are one row with the sum of their weights, as the conditional bases
    of FP-growth. Each level is written before the next.
    """
    total = sets.agg(F.sum("weight")).first()[0] or 0
    least = math.ceil(min_support * total)
    held = (sets.select("weight", F.explode("archives").alias("code")).groupBy("code").agg(F.sum("weight").alias("n"))
            .where(F.col("n") >= least))
    front = (sets.select("archives", "weight", F.explode("archives").alias("code")).join(held, "code")
             .groupBy("archives", "weight").agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("_p"))
             .select("weight", F.transform("_p", lambda x: x["code"]).alias("rest"))
             .groupBy("rest").agg(F.sum("weight").alias("weight")))
    path, found = F.array("code"), None
    while True:
        grown = materialize(front.select("*", F.posexplode("rest").alias("_at", "code")).select(
            path.alias("path"), F.slice("rest", F.col("_at") + 2, F.greatest(F.size("rest"), F.lit(1))).alias("rest"), "weight")
            .groupBy("path", "rest").agg(F.sum("weight").alias("weight")), "mined-level")
        level = materialize(grown.groupBy("path").agg(F.sum("weight").alias("freq")).where(F.col("freq") >= least), "mined-itemsets")
        found = level if found is None else found.unionByName(level)
        if level.isEmpty():
            break
        front = grown.where(F.size("rest") > 0).join(level.select("path"), "path", "left_semi")
        path = F.concat("path", F.array("code"))
    frequent = found.select(F.array_sort("path").alias("items"), "freq")
    rules = (frequent.where(F.size("items") > 1).select("items", "freq", F.explode("items").alias("_cq"))
             .select(F.array_remove("items", F.col("_cq")).alias("antecedent"), F.array("_cq").alias("consequent"), "freq")
             .join(frequent.select(F.col("items").alias("antecedent"), F.col("freq").alias("_n")), "antecedent")
             .select("antecedent", "consequent", (F.col("freq") / F.col("_n")).alias("confidence"))
             .where(F.col("confidence") >= min_confidence))
    return MinedRules(frequent, rules)


def frequent_itemsets(model: FPGrowthModel | MinedRules, min_size: int = 2) -> DataFrame:
    """(item sorted array, freq int) of itemsets with at least ``min_size`` codes."""
    return (model.freqItemsets
            .filter(F.size("items") >= min_size)
            .select(F.array_sort("items").alias("item"), F.col("freq").cast("int").alias("freq")))


def association_rules(model: FPGrowthModel | MinedRules) -> DataFrame:
    """(antecedent sorted array, consequent array, confidence) rules (M2).

    Confidence is rounded to 3 digits as stored by the reference; lift and
    support are dropped from the report.
    """
    return model.associationRules.select(
        F.array_sort("antecedent").alias("antecedent"),
        F.col("consequent"),
        F.round("confidence", 3).alias("confidence"))


def rule_tree(rules: DataFrame, spread: DataFrame) -> DataFrame:
    """(level, node, code, child, ends): the edges of the prefix tree of all antecedents.

    The codes of an antecedent are its path, those that fewest itemsets hold
    (``spread``: code, n) first; a node is the path that leads to it, so
    antecedents with equal beginnings share their upper nodes. ``ends`` says
    that a whole antecedent ends at the child.
    """
    paths = (rules.select(F.array_sort("antecedent").alias("antecedent")).distinct()
             .select("antecedent", F.explode("antecedent").alias("code")).join(spread, "code")
             .groupBy("antecedent").agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("path"))
             # an antecedent with a code that no itemset holds never fires
             .where(F.size("path") == F.size("antecedent"))
             .select(F.transform("path", lambda x: x["code"]).alias("path")))
    steps = paths.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("level"))
    return (steps.groupBy("level", F.slice("path", F.lit(1), F.col("level")).alias("child"))
            .agg(F.max(F.size("path") == F.col("level")).alias("ends"))
            .select("level", F.slice("child", F.lit(1), F.col("level") - 1).alias("node"),
                    F.element_at("child", -1).alias("code"), "child", "ends"))


def descend(sets: DataFrame, tree: DataFrame, spread: DataFrame) -> DataFrame:
    """(archives, child, ends): every itemset with every node of the rule tree whose path it holds.

    One join a level, on the node and the next code: an itemset meets one
    edge for each node that it reaches, whatever the number of rules below.
    Its codes lie in the order of the paths, so below a node only the codes
    behind the last one can follow. Each level is written before the next.
    """
    used = spread.join(tree.select("code").distinct(), "code", "left_semi")
    front = (sets.select("archives", F.explode("archives").alias("code")).join(used, "code")
             .groupBy("archives").agg(F.array_sort(F.collect_list(F.struct("n", "code"))).alias("_p"))
             .select("archives", F.transform("_p", lambda x: x["code"]).alias("rest")))
    levels = [r[0] for r in tree.select("level").distinct().orderBy("level").collect()]
    out = None
    for level in levels:
        at = [] if level == levels[0] else ["node"]
        edges = tree.where(F.col("level") == level).select(*at, "code", "child", "ends")
        probes = front.select("archives", "rest", *at, F.posexplode("rest").alias("_at", "code"))
        met = materialize(probes.join(edges, [*at, "code"]).select(
            "archives", "child", "ends", F.slice("rest", F.col("_at") + 2, F.size("rest")).alias("rest")), "rule-level")
        front = met.select("archives", "rest", F.col("child").alias("node"))
        reached = met.select("archives", "child", "ends")
        out = reached if out is None else out.unionByName(reached)
    return sets.sparkSession.createDataFrame([], sets.select(
        "archives", F.col("archives").alias("child"), F.lit(True).alias("ends")).schema) if out is None else out


def predict_missing(items: DataFrame, rules: DataFrame, items_col: str = "archives") -> DataFrame:
    """(archives, prediction): consequents of fired rules a subject lacks.

    Same result as FPGrowthModel.transform followed by distinct and a
    non-empty filter, computed as distributed joins instead of a rule list
    broadcast from the driver: the itemsets (deduplicated first, since the
    prediction depends on the itemset alone) descend the prefix tree of the
    antecedents, rarest code first, and only an itemset that reaches the end
    of an antecedent, so holds it, meets the rule. A code that most itemsets
    hold lies below the rarer codes of its rules. Rules have at least one
    code in the antecedent; null itemsets are left out.
    """
    sets = materialize(items.where(F.col(items_col).isNotNull()).select(F.col(items_col).alias("archives")).distinct(),
                       "distinct-itemsets")
    spread = materialize(sets.select(F.explode("archives").alias("code")).groupBy("code").agg(
        F.count(F.lit(1)).alias("n")), "spread")
    tree = materialize(rule_tree(rules, spread), "rule-tree")
    ends = descend(sets, tree, spread).where("ends").select("archives", "child")
    consequents = rules.select(F.array_sort("antecedent").alias("_ante"), F.explode("consequent").alias("_cq"))
    # paths are in rarity order; sorted they are the antecedents again
    fired = (ends.select("archives", F.array_sort("child").alias("_ante")).join(consequents, "_ante")
             .filter(~F.array_contains(F.col("archives"), F.col("_cq"))))
    return (fired.groupBy("archives")
            .agg(F.array_sort(F.collect_set("_cq")).alias("prediction")))


def rules_report(items: DataFrame, registry: DataFrame, min_support: float = 0.05,
                 min_confidence: float = 0.5, model: FPGrowthModel | MinedRules | None = None,
                 reports: Sequence[str] = REPORTS) -> dict[str, DataFrame]:
    """The three rule datasets with descriptions (T5): frequencies, confidences, predictions.

    Frequencies come from the highest down, confidences too (O1, O2), by a
    range sort. Pass a fitted ``model`` to reuse one fit for all three
    reports, and ``reports`` to get some of them only. Subjects' itemsets
    are read once; ``items`` may be weighted ones already.
    """
    if "weight" not in items.columns:
        items = materialize(weighted_itemsets(items), "weighted-itemsets")
    if model is None:
        model = mine(items, min_support, min_confidence)
    out = {}
    if "frequencies" in reports:
        out["frequencies"] = describe_array(frequent_itemsets(model), ["item"], registry).select(
            array_text("item").alias("item"), "freq", "item_description").orderBy(F.desc("freq"), "item")
    rules = association_rules(model)
    if "confidences" in reports:
        out["confidences"] = describe_array(rules, ["antecedent", "consequent"], registry).select(
            array_text("antecedent").alias("antecedent"), array_text("consequent").alias("consequent"),
            "confidence", "antecedent_description", "consequent_description").orderBy(
            F.desc("confidence"), "antecedent", "consequent")
    if "predictions" in reports:
        preds = predict_missing(items, rules)
        out["predictions"] = describe_array(preds, ["archives", "prediction"], registry).select(
            array_text("archives").alias("archives"), array_text("prediction").alias("prediction"),
            "archives_description", "prediction_description")
    return out

"""Naive Bayes over a grid of settings, test sets and taxonomies from one count of all texts; loss curves from prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .written import written

#: Terms with one in so many of all counted rows are joined by broadcast: they are at most as many.
HOT_TERMS = 4_096


def grid_predictions(rows: DataFrame, key: str, split: str, role: str, tokens: str, settings: DataFrame, tests: DataFrame) -> DataFrame:
    """setting, test, key, role, predicted: every row of a test's splits under every setting's multinomial model (add one).

    settings (setting, split) and tests (test, split) are small tables of names. Texts are read once: terms are counted
    by split and role, and a setting's model is the sum over its splits. Rows without terms aren't predicted. Ties go to
    the smaller role.
    """
    rows = rows.select(F.col(key).alias("key"), F.col(split).alias("split"), F.col(role).alias("role"), F.col(tokens).alias("ts"))
    terms = written(rows.repartition("key").select("key", "split", "role", F.explode("ts").alias("term")).groupBy("key", "split", "role", "term").agg(F.count("*").alias("k")))
    cube = terms.groupBy("split", "role", "term").agg(F.sum("k").alias("n"))
    model = written(cube.join(F.broadcast(settings), "split").groupBy("setting", "role", "term").agg(F.sum("n").alias("n")))
    docs = rows.groupBy("split", "role").agg(F.count("*").alias("docs")).join(F.broadcast(settings), "split").groupBy("setting", "role").agg(F.sum("docs").alias("docs"))
    vocabulary = model.groupBy("setting").agg(F.count_distinct("term").alias("v"))
    totals = model.groupBy("setting", "role").agg(F.sum("n").alias("t"))
    # settings x roles rows
    heads = docs.join(totals, ["setting", "role"], "left").join(vocabulary, "setting").withColumn("prior", F.log(F.col("docs") / F.sum("docs").over(Window.partitionBy("setting"))))
    heads = heads.select("setting", F.col("role").alias("predicted"), "prior", F.log(F.coalesce("t", F.lit(0)) + F.col("v")).alias("floor"))
    # A text's scores don't hang on the test: tests that share a split meet its predictions only.
    asked = terms.join(F.broadcast(tests.select("split").distinct()), "split", "left_semi")
    gains = model.select("setting", F.col("role").alias("predicted"), "term", F.log(F.col("n") + F.lit(1.0)).alias("gain"))
    counted = terms.groupBy("term").agg(F.count("*").alias("rows"))
    least = (terms.count() or 1) / HOT_TERMS
    hot = F.broadcast(counted.filter(F.col("rows") >= least).select("term"))
    often = asked.join(hot, "term", "left_semi").join(F.broadcast(gains.join(hot, "term", "left_semi")), "term")
    seldom = asked.join(hot, "term", "left_anti").join(gains, "term")
    fields = ["setting", "key", "split", "predicted", "k", "gain"]
    found = often.select(*fields).unionByName(seldom.select(*fields)).groupBy("setting", "key", "split", "predicted").agg(F.sum(F.col("k") * F.col("gain")).alias("gain"))
    sizes = asked.groupBy("key", "split", "role").agg(F.sum("k").alias("size"))
    scored = sizes.crossJoin(F.broadcast(heads)).join(found, ["setting", "key", "split", "predicted"], "left")
    scored = scored.withColumn("score", F.coalesce("gain", F.lit(0.0)) - F.col("size") * F.col("floor") + F.col("prior"))
    best = F.min_by("predicted", F.struct(-F.round("score", 6), F.col("predicted"))).alias("predicted")
    said = scored.groupBy("setting", "key", "split", "role").agg(best)
    return said.join(F.broadcast(tests), "split").select("setting", "test", "key", "role", "predicted")


def grid_metrics(predictions: DataFrame, taxonomies: DataFrame) -> DataFrame:
    """setting, test, metric, label, value: accuracy under every taxonomy (taxonomy, role, name) and the F1 of every role, from counts of (role, predicted)."""
    counts = predictions.groupBy("setting", "test", "role", "predicted").agg(F.count("*").alias("n"))
    own = taxonomies.select("taxonomy", "role", F.col("name").alias("own"))
    said = taxonomies.select("taxonomy", F.col("role").alias("predicted"), F.col("name").alias("said"))
    mapped = counts.join(F.broadcast(own), "role").join(F.broadcast(said), ["taxonomy", "predicted"])
    accuracy = mapped.groupBy("setting", "test", "taxonomy").agg((F.sum(F.when(F.col("own") == F.col("said"), F.col("n")).otherwise(0)) / F.sum("n")).alias("value"))
    sides = F.explode(F.array(F.struct(F.col("role").alias("label"), F.lit(1).alias("gold"), F.lit(0).alias("pred")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("gold"), F.lit(1).alias("pred"))))
    each = counts.select("setting", "test", "n", (F.col("role") == F.col("predicted")).alias("hit"), sides.alias("s"))
    f1 = each.groupBy("setting", "test", "s.label").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("twice"), F.sum("n").alias("both"))
    return accuracy.select("setting", "test", F.concat("taxonomy", F.lit("_accuracy")).alias("metric"), F.lit("ALL").alias("label"), "value").unionByName(f1.select("setting", "test", F.lit("per_role_f1").alias("metric"), "label", (F.col("twice") / F.col("both")).alias("value")))


def loss_curve(rows: DataFrame, score: Column, needed: Column) -> DataFrame:
    """threshold, token_reduction, recall, recall_loss for each score that occurs (six digits) as the threshold under which rows are dropped.

    Rows are added up by score, and prefix sums over the scores, a million at most between 0 and 1, give all thresholds at
    once. Where nothing is needed the recall is 1.
    """
    held = rows.select(F.round(score, 6).alias("threshold"), needed.cast("int").alias("needed")).groupBy("threshold").agg(F.count("*").alias("n"), F.sum("needed").alias("needed"))
    upto = Window.orderBy("threshold").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    summed = held.select("threshold", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("cheap"), F.coalesce(F.sum("needed").over(upto), F.lit(0)).alias("lost"), F.sum("n").over(every).alias("all"), F.sum("needed").over(every).alias("wanted"))
    loss = F.when(F.col("wanted") == 0, 0.0).otherwise(F.col("lost") / F.col("wanted"))
    return summed.select("threshold", (F.col("cheap") / F.col("all")).alias("token_reduction"), (1 - loss).alias("recall"), loss.alias("recall_loss"))


def ordered_drop(rows: DataFrame, order: list[str], place: str, needed: str, share: float) -> tuple[float, float]:
    """Reduction and recall after dropping round(share x rows) rows (a half to the even number) in the order of the columns order, then place."""
    return ordered_drops(rows, order, place, needed, [share])[0]


def ordered_drops(rows: DataFrame, order: list[str], place: str, needed: str, shares: list[float]) -> list[tuple[float, float]]:
    """As ordered_drop, for several shares of the same rows, which are made once.

    Groups of one order are added up; only the group in which a drop ends is looked at row by row, dealt by its places
    into parts, of which the one that holds the end is sorted.
    """
    rows = written(rows.select(*order, place, F.col(needed).cast("long").alias(needed)))
    groups = written(rows.groupBy(*order).agg(F.count("*").alias("n"), F.sum(needed).alias("wanted")))
    total, wanted = groups.agg(F.sum("n"), F.sum("wanted")).first()
    if not total:
        return [(0.0, 1.0)] * len(shares)
    w = Window.orderBy(*order)
    placed = groups.withColumn("upto", F.sum("n").over(w)).withColumn("lost", F.sum("wanted").over(w))
    return [_dropped(rows, placed, order, place, needed, round(total * share), total, wanted) for share in shares]


def _dropped(rows: DataFrame, placed: DataFrame, order: list[str], place: str, needed: str, drop: int, total: int, wanted: int | None) -> tuple[float, float]:
    edge = placed.filter(F.col("upto") >= drop).orderBy(*order).limit(1).collect()  # one group
    if not drop or not edge:
        return drop / total, 1.0
    last = edge[0]
    rest, lost = drop - (last["upto"] - last["n"]), last["lost"] - last["wanted"]
    same = F.lit(True)
    for c in order:
        same = same & F.col(c).eqNullSafe(F.lit(last[c]))
    inside = written(rows.filter(same).repartitionByRange(place).withColumn("part", F.spark_partition_id()))
    # A row for each part, in the order of places.
    for part in inside.groupBy("part").agg(F.count("*").alias("n"), F.sum(needed).alias("wanted")).orderBy("part").collect():
        if rest < part["n"]:
            lost += inside.filter(F.col("part") == part["part"]).orderBy(place).limit(rest).agg(F.sum(needed)).first()[0] or 0
            break
        rest, lost = rest - part["n"], lost + part["wanted"]
    return drop / total, 1.0 if not wanted else 1 - lost / wanted

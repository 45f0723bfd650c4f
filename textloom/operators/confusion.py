"""Confusion matrices in long form (actual, predicted, n) and what follows from them.

Labels are the sorted union of both columns. One class is the positive one:
the negative is the first label that begins with -, n, h or 0 (or else the
last), and the positive the first other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import maths


def confusion(table: DataFrame, actual: str, predicted: str) -> DataFrame:
    """actual, predicted and n for every pair of labels, also those that don't occur. Rows with a null are left out."""
    t = table.select(F.col(actual).cast("string").alias("actual"), F.col(predicted).cast("string").alias("predicted")).dropna()
    counts = t.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    labels = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).distinct()
    grid = labels.select(F.col("label").alias("actual")).crossJoin(labels.select(F.col("label").alias("predicted")))
    return grid.join(counts, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("n"))


def as_pairs(matrix: DataFrame) -> DataFrame:
    """A row for each counted observation."""
    return matrix.where("n > 0").select("actual", "predicted", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).drop("i")


def positive_label(labels: list[str]):
    """The positive label of sorted labels."""
    negative = next((x for x in labels if str(x)[:1].lower() in "-nh0"), labels[-1] if labels else None)
    rest = [x for x in labels if x != negative]
    return rest[0] if rest else maths.opposite_label(negative)


def class_counts(matrix: DataFrame) -> DataFrame:
    """For each label: tp, fn, fp and tn (one label against the rest), n, and correct_others, the other labels' diagonal."""
    total = matrix.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("diagonal"))
    sides = matrix.select(F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(True).alias("row")), F.struct(F.col("predicted").alias("label"), F.lit(False).alias("row")))).alias("s"), "actual", "predicted", "n").select("s.*", "actual", "predicted", "n")
    own = sides.groupBy("label").agg(
        F.sum(F.when(F.col("row"), F.col("n")).otherwise(0)).alias("row_sum"),
        F.sum(F.when(~F.col("row"), F.col("n")).otherwise(0)).alias("column_sum"),
        F.sum(F.when(F.col("row") & (F.col("actual") == F.col("predicted")), F.col("n")).otherwise(0)).alias("tp"),
    )
    t = own.crossJoin(F.broadcast(total))  # one row
    return t.select("label", "tp", (F.col("row_sum") - F.col("tp")).alias("fn"), (F.col("column_sum") - F.col("tp")).alias("fp"), (F.col("n") - F.col("row_sum") - F.col("column_sum") + F.col("tp")).alias("tn"), "n", (F.col("diagonal") - F.col("tp")).alias("correct_others"))


def class_stats(matrix: DataFrame) -> DataFrame:
    """For each label accuracy (its share of correct ones among all), sensitivity, specificity, mcc, chi_squared,
    false_positive (its own that were missed, as a share of its own) and false_negative (these, as a share of all others)."""
    c = class_counts(matrix)
    row = F.col("tp") + F.col("fn")
    false_here = F.col("fp")
    phi = maths.mcc(F.col("tp"), F.col("tn"), F.col("fp"), F.col("fn"))
    return c.select(
        "label",
        F.try_divide(F.col("tp"), F.col("n")).alias("accuracy"),
        F.try_divide(F.col("tp"), row).alias("sensitivity"),
        F.try_divide(F.col("correct_others"), F.col("correct_others") + false_here).alias("specificity"),
        phi.alias("mcc"),
        maths.chi_squared(phi, F.col("n")).alias("chi_squared"),
        F.try_divide(F.col("fn"), row).alias("false_positive"),
        F.try_divide(F.col("fn"), F.col("n") - row).alias("false_negative"),
    )


def binary_stats(matrix: DataFrame, positive: str) -> DataFrame:
    """One row for the positive label. Of more than two labels, tn is the diagonal without tp, and fn all others that
    weren't taken for positive less tn; so rates differ from those of one label against the rest."""
    pos = F.lit(positive)
    n = F.col("n")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, n).otherwise(0)).cast("double")

    a, p = F.col("actual"), F.col("predicted")
    s = matrix.agg(total((a == pos) & (p == pos)).alias("tp"), total(a == pos).alias("row"), total(p == pos).alias("col"), total(a == p).alias("diagonal"), F.sum(n).cast("double").alias("samples"))
    s = s.withColumn("tn", F.col("diagonal") - F.col("tp")).withColumn("fp", F.col("col") - F.col("tp")).withColumn("fn", F.col("samples") - F.col("col") - F.col("tn"))
    negatives = F.col("samples") - F.col("row")
    s = s.withColumns({"tpr": F.try_divide("tp", "row"), "tnr": F.try_divide(F.col("tn"), negatives), "fnr": F.try_divide("fn", "row")}).withColumn("fpr", F.try_divide(F.col("fp"), negatives))
    return s.select(
        F.lit(positive).alias("label"), "samples", "tp", "tn", "fp", "fn", "tpr", "tnr", "fpr", "fnr",
        F.try_divide("tpr", "fpr").alias("plr"), F.try_divide("fnr", "tnr").alias("nlr"),
        F.try_divide(F.col("tp") + F.col("tn"), F.col("samples")).alias("accuracy"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
        F.try_divide(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
    )


def stats_json(matrix: DataFrame) -> DataFrame:
    """All labels' statistics as one JSON text."""
    s = class_stats(matrix)
    return s.agg(F.to_json(F.array_sort(F.collect_list(F.struct(*s.columns)))).alias("json"))


def displayed(matrix: DataFrame) -> DataFrame:
    """The square form: a row for each actual label, a column for each predicted one."""
    return matrix.groupBy("actual").pivot("predicted").agg(F.first("n"))


def at_threshold(table: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """sensitivity and specificity of 'score > threshold' for labels 0 and 1."""
    over, yes = F.col(score) > threshold, F.col(label) > 0
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return table.dropna(subset=[score, label]).agg(F.try_divide(count(over & yes), count(yes)).alias("sensitivity"), F.try_divide(count(~over & ~yes), count(~yes)).alias("specificity"))


def roc(table: DataFrame, score: str, label: str) -> DataFrame:
    """threshold, sensitivity and specificity of 'score > threshold' for every distinct score.

    Running sums over the distinct scores: by parts of the score range, then within each, so no task sees all. The parts
    are settled, as their sums and their rows have to be of the same."""
    from pyspark.sql import Window

    from ..sources.folders import settled

    per = table.dropna(subset=[score, label]).groupBy(F.col(score).alias("threshold")).agg(F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) > 0, 0).otherwise(1)).alias("neg"))
    parts = settled(per.repartitionByRange(F.col("threshold")).withColumn("__p", F.spark_partition_id()))
    sums = parts.groupBy("__p").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__p", F.coalesce(F.sum("p").over(before), F.lit(0)).alias("p0"), F.coalesce(F.sum("q").over(before), F.lit(0)).alias("q0"), F.sum("p").over(Window.partitionBy()).alias("pt"), F.sum("q").over(Window.partitionBy()).alias("qt"))
    inside = Window.partitionBy("__p").orderBy("threshold")
    run = parts.withColumn("pr", F.sum("pos").over(inside)).withColumn("nr", F.sum("neg").over(inside)).join(F.broadcast(bases), "__p")
    return run.select("threshold", F.try_divide(F.col("pt") - F.col("p0") - F.col("pr"), F.col("pt")).alias("sensitivity"), F.try_divide(F.col("q0") + F.col("nr"), F.col("qt")).alias("specificity"))


def threshold_for(curve: DataFrame, specificity: float) -> DataFrame:
    """The row of a ROC curve whose specificity is nearest to the target, the lowest threshold of equals."""
    best = curve.agg(F.min(F.struct(F.abs(F.col("specificity") - specificity).alias("gap"), "threshold", "sensitivity", "specificity")).alias("b"))
    return best.select("b.threshold", "b.sensitivity", "b.specificity")


def inverse(fun, y: float, low: float, high: float, tolerance: float = 1e-10) -> float:
    """x from low to high where a monotonic function of the program (not of rows) gives y, by bisection."""
    rising = fun(high) >= fun(low)
    while high - low > tolerance * max(1.0, abs(low)):
        middle = (low + high) / 2
        if (fun(middle) < y) == rising:
            low = middle
        else:
            high = middle
    return (low + high) / 2

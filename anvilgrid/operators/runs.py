"""Run analytics: last-wins records, resume, summaries, slices, overlaps, regions, progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from anvilgrid.functions.text import CATEGORIES


def percent(part, whole):
    return F.bround(F.try_divide(100.0 * part, whole), 2)


def last_wins(records: DataFrame, key: str, order: str) -> DataFrame:
    """One row of each key: that with the greatest order. Combined before the shuffle."""
    row = F.struct(order, *[c for c in records.columns if c not in (key, order)])
    return records.groupBy(key).agg(F.max_by(row, order).alias("last")).select(key, "last.*")


def pending(ordered: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    return ordered.join(done.select(key), key, "left_anti")


def summary(runs: DataFrame, dataset: DataFrame) -> DataFrame:
    """category (null: overall), run_rows, dataset_questions, scored, correct, accuracy, coverage, unscored."""
    own = dataset.join(runs, "question_id", "left").select("category", F.col("run").isNotNull().alias("ran"), "is_correct")
    out = own.groupingSets([["category"], []], "category").agg(
        F.count_if("ran").alias("run_rows"), F.count(F.lit(1)).alias("dataset_questions"), F.count("is_correct").alias("scored"),
        F.coalesce(F.count_if(F.col("is_correct")), F.lit(0)).alias("correct"), F.count_if(F.col("ran") & F.col("is_correct").isNull()).alias("unscored"),
    )
    return out.withColumn("accuracy", percent(F.col("correct"), F.nullif(F.col("scored"), F.lit(0)))).withColumn("coverage", percent(F.col("scored"), F.col("dataset_questions")))


def slices(runs: DataFrame, dataset: DataFrame, kind: str, values: list) -> DataFrame:
    """Correct answers of each run in each of the given slice values, zero where there is none."""
    spark = runs.sparkSession
    grid = spark.createDataFrame([(v,) for v in values], [kind]).crossJoin(runs.select("run").distinct())
    found = runs.where("is_correct").join(dataset, "question_id").groupBy("run", kind).agg(F.count(F.lit(1)).alias("n"))
    return grid.join(found, ["run", kind], "left").select("run", kind, F.coalesce("n", F.lit(0)).alias("correct"))


def pairwise(runs: DataFrame) -> DataFrame:
    """Overlap of every two runs on questions that both scored."""
    a, b = (runs.where("is_correct is not null").select("question_id", F.col("run").alias(f"{s}_run"), F.col("is_correct").alias(s)) for s in ("left", "right"))
    both = a.join(b, "question_id").where("left_run < right_run")
    return both.groupBy("left_run", "right_run").agg(
        F.count_if(F.col("left") & ~F.col("right")).alias("left_only"), F.count_if(~F.col("left") & F.col("right")).alias("right_only"),
        F.count_if(F.col("left") & F.col("right")).alias("both_correct"), F.count_if(~F.col("left") & ~F.col("right")).alias("both_wrong"),
    )


def compare(candidate: DataFrame, baseline: DataFrame) -> DataFrame:
    both = candidate.select("question_id", F.col("is_correct").alias("c")).join(baseline.select("question_id", F.col("is_correct").alias("b")), "question_id").where("c is not null and b is not null")
    n = F.count(F.lit(1))
    return both.agg(
        n.alias("shared"), F.count_if("c").alias("candidate_correct"), F.count_if("b").alias("baseline_correct"), F.count_if(F.col("c") & ~F.col("b")).alias("improved"),
        F.count_if(~F.col("c") & F.col("b")).alias("regressed"), F.count_if(F.col("c") == F.col("b")).alias("unchanged"), F.round(F.try_divide(F.count_if("c"), n), 6).alias("candidate_accuracy"),
    )


def regions(runs: DataFrame, names: list[str]) -> DataFrame:
    """mask (a digit for each run), questions: exclusive regions of the runs' correct sets."""
    bits = [F.max(F.when((F.col("run") == n) & F.col("is_correct"), 1).otherwise(0)).cast("string") for n in names]
    return runs.groupBy("question_id").agg(F.concat(*bits).alias("mask")).where(F.col("mask").contains("1")).groupBy("mask").agg(F.count(F.lit(1)).alias("questions"))


def coverage_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """side, question_id of ids that only one side has."""
    x, y = a.select("question_id").distinct(), b.select("question_id").distinct()
    return x.exceptAll(y).select(F.lit("missing").alias("side"), "question_id").unionByName(y.exceptAll(x).select(F.lit("extra").alias("side"), "question_id"))


def progress(records: DataFrame, every: int, buckets: int = 64) -> DataFrame:
    """Completed, evaluated, correct and accuracy after every so many rows (group, seq, is_correct), in each group."""
    upto = Window.partitionBy("group").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("group")
    out = records.select(
        "group", F.count(F.lit(1)).over(upto).alias("completed"), F.count("is_correct").over(upto).alias("evaluated"),
        F.coalesce(F.sum(F.col("is_correct").cast("long")).over(upto), F.lit(0)).alias("correct"), F.count(F.lit(1)).over(whole).alias("total"),
    )
    out = out.where((F.col("completed") % every == 0) | (F.col("completed") == F.col("total"))).drop("total")
    return out.withColumn("accuracy", F.round(F.coalesce(F.try_divide(F.col("correct"), F.col("evaluated")), F.lit(0.0)), 6))


def duplicates(records: DataFrame, key: str) -> DataFrame:
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def summary_by_category(records: DataFrame, dataset: DataFrame) -> DataFrame:
    """summary() with the rows that failed, for the known categories (also those without questions), then the others by name.

    Its ratios round halves up at two digits, those of summary() to even."""
    known = records.sparkSession.createDataFrame([(c, i) for i, c in enumerate(CATEGORIES)], "category string, known int")
    own = dataset.join(records, "question_id", "left").select("category", F.col("run").isNotNull().alias("ran"), "is_correct", F.col("status").isin("error", "failed").alias("bad"))
    out = own.groupBy("category").agg(
        F.count_if("ran").alias("run_rows"), F.count(F.lit(1)).alias("dataset_questions"), F.count("is_correct").alias("scored"),
        F.count_if(F.col("is_correct")).alias("correct"), F.count_if(F.col("ran") & F.col("is_correct").isNull()).alias("unscored"), F.count_if(F.col("ran") & F.col("bad")).alias("failed"),
    )
    counts = ["run_rows", "dataset_questions", "scored", "correct", "unscored", "failed"]
    out = out.join(F.broadcast(known), "category", "full").fillna(0, counts)
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("known"), "category"))  # a row for each category
    ratio = lambda a, b: F.round(F.try_divide(100.0 * F.col(a), F.col(b)) * 100) / 100
    return out.select("category", place.cast("long").alias("position"), *counts, ratio("correct", "scored").alias("accuracy"), ratio("scored", "dataset_questions").alias("coverage"))


def totals(runs: DataFrame) -> DataFrame:
    """run, rows, scored, correct of each run."""
    return runs.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.count("is_correct").alias("scored"), F.count_if(F.col("is_correct")).alias("correct"))


def completed(ordered: DataFrame, done: DataFrame, key: str = "question_id") -> DataFrame:
    """The ids of a run that are done already."""
    return ordered.join(done.select(key), key, "left_semi")

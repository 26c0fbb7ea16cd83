"""Training dynamics: what happens to each sample from epoch to epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sampleworks.functions.values import is_finite


def deduplicated(df: DataFrame, keys: list[str], epoch: str, seq: str) -> DataFrame:
    """The last record of each sample and epoch."""
    last = Window.partitionBy(*keys, epoch).orderBy(F.desc(seq))
    return df.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def probability(recorded: Column, loss: Column) -> Column:
    """Probability of the true class, from the loss where it wasn't recorded."""
    return F.coalesce(F.nanvl(recorded, F.lit(None).cast("double")), F.exp(-loss))


def sample_dynamics(df: DataFrame, keys: list[str], epoch: str, correct: str, p: str) -> DataFrame:
    """One row for each sample: observations, first and last epoch, mean and spread of ``p``, share correct, first
    correct epoch, forgetting events, and the epoch from which it stays correct. One shuffle by sample."""
    along = Window.partitionBy(*keys).orderBy(epoch)
    before = F.lag(correct).over(along)
    marked = df.withColumn("__forgot", (before & ~F.col(correct)).cast("int")).withColumn("__gap", F.col(epoch) - F.lag(epoch).over(along))
    whole = Window.partitionBy(*keys)
    marked = marked.withColumn("__wrong", F.max(F.when(~F.col(correct), F.col(epoch))).over(whole))
    found = marked.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.min(epoch).alias("first_epoch"),
        F.max(epoch).alias("last_epoch"),
        F.max("__gap").alias("max_gap"),
        F.avg(p).alias("mean_p"),
        F.stddev_pop(p).alias("std_p"),
        F.avg(F.col(correct).cast("double")).alias("correctness"),
        F.min(F.when(F.col(correct), F.col(epoch))).alias("first_correct"),
        F.coalesce(F.sum("__forgot"), F.lit(0)).alias("forgetting"),
        F.min(F.when(F.col("__wrong").isNull() | (F.col(epoch) > F.col("__wrong")), F.col(epoch))).alias("learned_epoch"),
    )
    return found.withColumn("unstable", F.col("forgetting") >= 2)


def with_speed(dynamics: DataFrame) -> DataFrame:
    """``speed`` by the run's quartiles of learned epochs: early and late are strictly outside them."""
    cuts = _quartiles(dynamics.groupBy("learned_epoch").agg(F.count("*").alias("n")))
    joined = dynamics.crossJoin(F.broadcast(cuts))  # one row
    speed = F.when(F.col("learned_epoch").isNull(), "never").when(F.col("learned_epoch") < F.col("__q1"), "early").when(F.col("learned_epoch") > F.col("__q3"), "late").otherwise("middle")
    return joined.withColumn("speed", speed).drop("__q1", "__q3", "__end")


def _quartiles(epochs: DataFrame) -> DataFrame:
    """One row ``__q1, __q3, __end`` of learned epochs (``learned_epoch, n``): linear quartiles by counting epochs, of which there are
    as many as a run has, and the last epoch; null without any."""
    placed = epochs.filter("learned_epoch IS NOT NULL").select("learned_epoch", "n", (F.sum("n").over(Window.orderBy("learned_epoch")) - 1).alias("last"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("all"))
    at = lambda position: F.min(F.when(F.col("last") >= position, F.col("learned_epoch"))).cast("double")
    ends = []
    for name, share in (("q1", 0.25), ("q3", 0.75)):
        position = F.lit(share) * (F.col("all") - 1)
        ends += [at(F.floor(position)).alias(f"{name}a"), at(F.ceil(position)).alias(f"{name}b"), F.max(position - F.floor(position)).alias(f"{name}s")]
    found = placed.agg(*ends, F.max("learned_epoch").alias("__end"))
    cut = lambda name: (F.col(f"{name}a") + (F.col(f"{name}b") - F.col(f"{name}a")) * F.col(f"{name}s")).alias(f"__{name}")
    return found.select(cut("q1"), cut("q3"), "__end")


def image_scores(df: DataFrame, keys: list[str], epoch: str, score: str, good: float = 0.5) -> DataFrame:
    """Rows with a finite score, with ``correct`` where it reaches ``good``, for :func:`sample_dynamics`."""
    return df.filter(is_finite(F.col(score)) & F.col(epoch).isNotNull()).withColumn("correct", F.col(score) >= good)


def image_learning(dynamics: DataFrame, min_observations: int = 3, unstable: int = 2) -> DataFrame:
    """``category`` of each sample; a boolean column ``empty`` marks those without anything labelled or predicted.

    The quartiles are those of samples that were learned for good, seen often enough and not empty. Early is at or
    before the first; late is after the last, or at it where the last quarter all falls on the final round.
    """
    empty = F.coalesce(F.col("empty"), F.lit(False)) if "empty" in dynamics.columns else F.lit(False)
    most = dynamics.agg(F.max("observations").alias("__most"))
    judged = dynamics.crossJoin(F.broadcast(most))  # one row
    few = (F.col("observations") < min_observations) | (F.col("observations") * 2 < F.col("__most"))
    judged = judged.withColumn("category", F.when(empty, "empty").when(few, "insufficient"))
    learned = F.when(F.col("category").isNull() & (F.col("forgetting") < unstable), F.col("learned_epoch"))
    bounds = _quartiles(judged.groupBy(learned.alias("learned_epoch")).agg(F.count("*").alias("n")))
    joined = judged.crossJoin(F.broadcast(bounds))  # one row
    final = (F.col("__q3") > F.col("__q1")) & (F.col("__q3") == F.col("__end")) & (F.col("learned_epoch") == F.col("__q3"))
    category = (
        F.when(F.col("category").isNotNull(), F.col("category"))
        .when(F.col("first_correct").isNull(), "never")
        .when(F.col("learned_epoch").isNull() | (F.col("forgetting") >= unstable), "forgotten")
        .when(F.col("learned_epoch") <= F.col("__q1"), "early")
        .when((F.col("learned_epoch") > F.col("__q3")) | final, "late")
        .otherwise("steady")
    )
    return joined.withColumn("category", category).drop("__most", "__q1", "__q3", "__end")


def uncertainty(margin: Column, confidence: Column, narrow: float = 0.25, unsure: float = 0.6) -> Column:
    """Whether a prediction was uncertain: by its margin where recorded, else by its confidence, else null."""
    return F.when(is_finite(margin), margin < narrow).when(is_finite(confidence), confidence < unsure)


def holds_from(df: DataFrame, keys: list[str], epoch: str, test: Column) -> DataFrame:
    """``from_epoch`` of each sample: the first epoch of the last run of epochs that pass a test, null if the last fails."""
    bad = F.max(F.when(~F.coalesce(test, F.lit(False)), F.col(epoch))).over(Window.partitionBy(*keys))
    kept = df.withColumn("__bad", bad).withColumn("__good", F.col("__bad").isNull() | (F.col(epoch) > F.col("__bad")))
    return kept.groupBy(*keys).agg(F.min(F.when(F.col("__good"), F.col(epoch))).alias("from_epoch"))


def evaluation_round(df: DataFrame, keys: list[str], epoch: str, has_boxes: str, seq: str) -> DataFrame:
    """One row for each sample of the round to be judged: the last epoch with stored boxes, else the last; of
    repeated rows one with boxes wins, then the latest."""
    last = df.agg(F.coalesce(F.max(F.when(F.col(has_boxes), F.col(epoch))), F.max(epoch)).alias("__round"))
    inside = df.join(F.broadcast(last), F.col(epoch) == F.col("__round")).drop("__round")  # one row
    first = Window.partitionBy(*keys).orderBy(F.desc(has_boxes), F.desc(seq))
    return inside.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")


def round_history(df: DataFrame, sample: Column, epoch: str, seq: str) -> DataFrame:
    """One sample's rows in order of epoch, the latest of each."""
    latest = Window.partitionBy(epoch).orderBy(F.desc(seq))
    return df.filter(sample).withColumn("__n", F.row_number().over(latest)).filter("__n = 1").drop("__n").orderBy(epoch)


def epoch_summary(df: DataFrame, dynamics: DataFrame, epoch: str, correct: str, p: str, confident: float = 0.6) -> DataFrame:
    """Per epoch over raw rows: evaluated, confident and right, uncertain, confident and wrong, newly learned."""
    sure = F.col(p) >= confident
    counts = df.groupBy(epoch).agg(F.count("*").alias("evaluated"), F.count_if(sure & F.col(correct)).alias("confident_correct"), F.count_if(~sure).alias("uncertain"), F.count_if(sure & ~F.col(correct)).alias("confident_wrong"))
    learned = dynamics.filter("learned_epoch IS NOT NULL").groupBy(F.col("learned_epoch").alias(epoch)).agg(F.count("*").alias("newly_learned"))
    return counts.join(learned, epoch, "left").fillna(0, ["newly_learned"])


def competent_from(df: DataFrame, epoch: str, correct: str, share: float = 0.9) -> DataFrame:
    """The first epoch whose recall reaches a share of the best."""
    recall = df.groupBy(epoch).agg(F.avg(F.col(correct).cast("double")).alias("recall"))
    best = recall.agg(F.max("recall").alias("__best"))
    return recall.crossJoin(F.broadcast(best)).filter(F.col("recall") >= share * F.col("__best")).agg(F.min(epoch).alias(epoch))  # one row


def trajectory_edges(df: DataFrame, group: str, order: str) -> DataFrame:
    """Consecutive observations of a group; a repeated order value has no edge on either side."""
    along, same = Window.partitionBy(group).orderBy(order), Window.partitionBy(group, order)
    placed = df.withColumn("__n", F.count("*").over(same)).withColumn("to", F.lead(order).over(along)).withColumn("__m", F.lead("__n").over(along))
    return placed.filter((F.col("__n") == 1) & (F.col("__m") == 1)).select(group, F.col(order).alias("from"), "to")

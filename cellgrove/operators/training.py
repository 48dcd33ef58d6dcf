"""Rules of training runs over their history: when to stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def early_stopping(history: DataFrame, patience: int, min_delta: float = 0.0) -> DataFrame:
    """epoch, loss, best, counter and stop of each epoch up to the one that stops the run.

    An epoch whose loss is above best - min_delta raises the counter; another one becomes the best and sets it back. At
    patience the run stops. Each step needs the one before, so the history (a row per epoch) is folded as one array.
    """
    state = "array<struct<epoch:int,loss:double,best:double,counter:int,stop:boolean>>"
    epochs = F.sort_array(F.collect_list(F.struct("epoch", "loss")))

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        worse = x["loss"] > last["best"] - min_delta
        counter = F.when(worse, last["counter"] + 1).otherwise(0)
        row = F.struct(x["epoch"].alias("epoch"), x["loss"].alias("loss"), F.when(worse, last["best"]).otherwise(x["loss"]).alias("best"), counter.alias("counter"), (worse & (counter >= patience)).alias("stop"))
        first = F.struct(x["epoch"].alias("epoch"), x["loss"].alias("loss"), x["loss"].alias("best"), F.lit(0).alias("counter"), F.lit(False).alias("stop"))
        return F.when(F.size(done) == 0, F.array(first).cast(state)).when(last["stop"], done).otherwise(F.concat(done, F.array(row).cast(state)))

    walk = history.agg(F.aggregate(epochs, F.array().cast(state), step).alias("walk"))
    return walk.select(F.inline("walk"))

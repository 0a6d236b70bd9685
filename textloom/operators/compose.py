"""Queries that drive each other, and control over batches of tasks and their logs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def chain(first: DataFrame, column: str, then: DataFrame, key: str, keep: bool = True) -> DataFrame:
    """Rows of ``then`` whose key is (or, with keep False, isn't) among the values of a column of ``first``."""
    values = first.select(F.col(column).alias(key)).distinct()
    return then.join(values, key, "left_semi" if keep else "left_anti")


def union_values(*columns: DataFrame) -> DataFrame:
    """The distinct values of frames with one column each."""
    out = columns[0]
    for df in columns[1:]:
        out = out.union(df)
    return out.distinct()


def pluck(records: Column, field: str) -> Column:
    return F.transform(records, lambda x: x.getField(field))


def task_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def dedup_tasks(tasks: DataFrame, key: str, order: str) -> DataFrame:
    """Tasks with the first task of the same key, which runs for all of them."""
    first = tasks.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("runs_as"))
    return tasks.join(first, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def fan_out(tasks: DataFrame, key: str, order: str, results: DataFrame) -> DataFrame:
    """Every task with the result (order, ...) of the task that ran for it, see dedup_tasks; null where it has none."""
    return dedup_tasks(tasks, key, order).join(results.withColumnRenamed(order, "runs_as"), "runs_as", "left")


def greedy_budget(tasks: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """tasks (key, order, cost: long) with runs: whether, in order, each task's cost still fits its key's budget; a task that
    doesn't fit is skipped and later ones may fit. Ties go by cost. Each key's rows stream by in order; only the sum used so
    far is held, whatever the number of a key's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used = None, 0
        for batch in batches:
            runs = []
            for k, c in zip(batch[key].tolist(), batch[cost].tolist(), strict=True):
                if k != now:
                    now, used = k, 0
                fits = used + c <= budget
                used += c if fits else 0
                runs.append(fits)
            yield batch.assign(runs=runs)

    rows = tasks.select(key, order, cost)
    return rows.repartition(key).sortWithinPartitions(key, order, cost).mapInPandas(run, StructType([*rows.schema.fields]).add("runs", "boolean"))


def cached_batch(tasks: DataFrame, key: str, work: Callable[[DataFrame], DataFrame], cache: DataFrame | None, store: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(tasks with result, error and from_cache; the cache for the next batch). ``work`` adds result and error to rows of
    (key, and tasks' other columns), one for each key that the cache (key, result, error) lacks: tasks of a key are alike, and
    any one runs for all. A failing task is a row with its error and doesn't end the batch; it is not kept in the cache, so
    a later batch tries it again. Null keys are never cached and each run on their own."""
    known = cache if cache is not None else None
    new = tasks.where(F.col(key).isNotNull())
    new = new if known is None else new.join(known.select(key), key, "left_anti")
    done = store(work(new.dropDuplicates([key])).select(key, "result", "error"))
    results = done.withColumn("from_cache", F.lit(False))
    good = done.where("error is null")
    if known is not None:
        results = results.union(known.select(key, "result", "error").withColumn("from_cache", F.lit(True)))
        good = known.select(key, "result", "error").union(good)
    alone = work(tasks.where(F.col(key).isNull())).withColumn("from_cache", F.lit(False))
    return tasks.join(results, key).select(*alone.columns).union(alone), good


def step_trends(log: DataFrame, key: str, order: str, steps: str) -> DataFrame:
    """trends of each step of each key's runs: log has ``steps``, an array of (step, duration_ms)."""
    each = log.select(key, order, F.explode(steps).alias("s")).select(F.struct(F.col(key), F.col("s.step").alias("step")).alias("_k"), order, F.col("s.duration_ms").alias("duration_ms"))
    return trends(each, "_k", order, "duration_ms").select(F.col(f"_k.{key}").alias(key), "_k.step", "n", "older", "newer", "trend")


class Profiled:
    """Counts of a run, taken while its rows are written, and its times, appended to a log of runs.

        with Profiled(df, "search_regex", log_path, most=1000) as run:
            run.rows.write.parquet(out)

    The log's rows: skill, began and ended (Unix milliseconds), duration, rows, truncated (whether the rows reach ``most``)
    and steps, those named by ``step``. Nothing is read a second time."""

    def __init__(self, df: DataFrame, skill: str, log_path: str, most: int | None = None):
        self.counts = Observation()
        self.spark, self.skill, self.path, self.most, self.steps = df.sparkSession, skill, log_path, most, []
        self.rows = df.observe(self.counts, F.count(F.lit(1)).alias("rows"))

    def __enter__(self) -> Profiled:
        self.began = self.last = time.time()
        return self

    def step(self, name: str) -> None:
        """Ends a step that began with the run or with the end of the one before."""
        now = time.time()
        self.steps.append((name, 1000 * (now - self.last)))
        self.last = now

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            return
        ended, n = time.time(), self.counts.get["rows"]
        row = (self.skill, int(1000 * self.began), int(1000 * ended), int(1000 * (ended - self.began)), n, self.most is not None and n >= self.most, self.steps)
        shape = "skill string, began long, ended long, duration long, rows long, truncated boolean, steps array<struct<step:string,duration_ms:double>>"
        self.spark.createDataFrame([row], shape).write.mode("append").parquet(self.path)


#: Tasks of a block of the global budget, about: what one task puts in order.
BUDGET_BLOCK = 200_000


def global_budget(tasks: DataFrame, order: str, cost: str, budget: int) -> DataFrame:
    """tasks with runs: whether, in one order over all of them, each one's cost (0 or more) still fits; one that doesn't is
    skipped and later ones may fit. ``order``: different longs; null orders and costs don't run.

    Once a task doesn't fit, only cheaper ones than what is left can: each round takes those, behind that task, as far as
    their sum fits. Sums of blocks of the order say in which block that ends, and only this block is put in order. A round
    uses up some of the budget or lowers the cost that fits, so rounds don't grow with the tasks. tasks are read once for
    each round and should be a table."""
    rows = tasks.where(F.col(order).isNotNull() & F.col(cost).isNotNull()).select(F.col(order).cast("long").alias("at"), F.col(cost).cast("long").alias("cost"))
    n = rows.count()
    cuts = rows.agg(F.percentile_approx("at", [i / max(1, -(-n // BUDGET_BLOCK)) for i in range(1, max(2, -(-n // BUDGET_BLOCK)))], 10_000)).first()[0] or []
    block = F.lit(0)
    for c in cuts if n > BUDGET_BLOCK else []:
        block = block + (F.col("at") > c).cast("int")
    rows = rows.withColumn("block", block)
    taken, after, left = [], None, budget
    while left >= 0:
        open_ones = rows.where(F.col("cost") <= left) if after is None else rows.where((F.col("cost") <= left) & (F.col("at") > after))
        used, ends = 0, None
        for b, total in open_ones.groupBy("block").agg(F.sum("cost")).orderBy("block").collect():  # one row a block
            if used + total > left:
                ends = b
                break
            used += total
        if ends is None:  # all that is left fits
            taken.append((after, None, left))
            break
        so_far = open_ones.where(F.col("block") == ends).withColumn("sum", F.sum("cost").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
        first = so_far.where(F.col("sum") > left - used).orderBy("at").first()
        taken.append((after, first["at"], left))
        left, after = left - (used + first["sum"] - first["cost"]), first["at"]
    place, price, runs = F.col(order), F.col(cost), F.lit(False)
    for lo, hi, most in taken:
        fits = price <= most
        fits = fits if lo is None else fits & (place > lo)
        runs = runs | (fits if hi is None else fits & (place < hi))
    return tasks.withColumn("runs", F.coalesce(runs & place.isNotNull(), F.lit(False)))


def reachable(starts: DataFrame, edges: DataFrame, most: int, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, depth): what can be reached from the starts (node) over edges (src, dst) in at most ``most`` steps, with the
    least number of steps, 0 for the starts. Each round follows the edges of the nodes found last and leaves out those known
    before, so circles end; what a round finds is written by ``store``, and no plan grows. Null nodes lead nowhere."""
    found = store(starts.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)))
    last = found
    for depth in range(1, most + 1):
        following = last.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).where("node is not null").distinct()
        last = store(following.join(found, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if last.isEmpty():
            break
        found = found.union(last)
    return found


def at_least(df: DataFrame, column: str, level: str, levels: dict[str, int]) -> DataFrame:
    """Rows whose level, a name, ranks no lower than the given one; unknown names rank lowest."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[F.col(column)], F.lit(-1))
    return df.where(rank >= levels[level])


def classified(text: Column, rules: tuple[tuple[str, str], ...], otherwise: str = "unknown") -> Column:
    """The name of the first (pattern, name) whose pattern a text matches."""
    out = F.lit(otherwise)
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    return out


def with_fallback(df: DataFrame, primary: dict[str, Column], fallback: dict[str, Column], failed: Column, warning: str) -> DataFrame:
    """df with the primary columns, or where they ``failed`` the fallback's: what it doesn't fill is null, used_fallback is
    true and warnings says so."""
    own = {n: F.when(failed, fallback[n] if n in fallback else F.lit(None)).otherwise(c) for n, c in primary.items()}
    empty = F.expr("cast(array() as array<string>)")
    return df.withColumns(own | {"used_fallback": failed, "warnings": F.when(failed, F.array(F.lit(warning))).otherwise(empty)})


class StepFailed(ValueError):
    """A step of a pipeline that could not be built: no later one is."""


def pipeline(start: DataFrame, steps: Sequence[tuple[str, Callable[..., DataFrame], str, dict]]) -> DataFrame:
    """Steps (name, build(values, ...), column, given) one after the other. Each gets, as ``values``, the distinct values of
    a column of the rows before, unless ``given`` has its own. The first step that fails ends the chain."""
    rows = start
    for name, build, column, given in steps:
        try:
            rows = build(**({"values": rows.select(column).distinct()} | given))
        except Exception as e:
            raise StepFailed(f"step {name}: {e}") from e
    return rows


def last_runs(log: DataFrame, key: str, order: str, most: int) -> DataFrame:
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= most).drop("_n")


def trends(log: DataFrame, key: str, order: str, value: str, band: float = 0.1, least: int = 4) -> DataFrame:
    """Per key: averages of the older and the newer half of its runs and what that says; halves split at floor(n / 2)."""
    w = Window.partitionBy(key)
    rows = log.withColumns({"_i": F.row_number().over(w.orderBy(order)), "_n": F.count("*").over(w)})
    old = F.col("_i") <= F.floor(F.col("_n") / 2)
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.when(old, F.col(value))).alias("older"), F.avg(F.when(~old, F.col(value))).alias("newer"))
    word = F.when(F.col("n") < least, "insufficient_data").when(F.col("newer") < F.col("older") * (1 - band), "improving").when(F.col("newer") > F.col("older") * (1 + band), "degrading").otherwise("stable")
    return out.withColumn("trend", word)


def backoff_ms(attempt: Column, base: int) -> Column:
    return (F.lit(base) * F.pow(F.lit(2), attempt - 1)).cast("long")

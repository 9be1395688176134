"""Latest rows, tallies, trailing windows, runs and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last by ``order``; combined before the exchange."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    row = F.struct(*order, *rest)
    return df.groupBy(*keys).agg(F.max(row).alias("__row")).select(*keys, *(F.col("__row")[c].alias(c) for c in [*order, *rest]))


def exact_avg(value: str) -> Column:
    """The mean of a column of doubles, the same in whatever order rows come: values count as the decimals that they print
    as, up to ten places; only what is beyond that (other digits, huge values, no numbers) is added up in doubles."""
    d = F.coalesce(F.col(value).try_cast("decimal(28,10)"), F.when(F.col(value).isNotNull(), F.lit(0).cast("decimal(28,10)")))
    return F.avg(d).cast("double") + F.avg(F.col(value) - d.cast("double"))


def completion(plan: DataFrame, outcomes: DataFrame, key: str, by: str, done: Column) -> DataFrame:
    """Planned, done and untouched rows of each group; ``outcomes`` has one row for a key."""
    joined = plan.join(outcomes.withColumn("__seen", F.lit(True)), key, "left")
    counts = joined.groupBy(by).agg(F.count("*").alias("planned"), F.count_if(done).alias("done"), F.count_if(F.col("__seen").isNull()).alias("untouched"))
    return counts.withColumn("ratio", F.round(F.col("done") / F.col("planned"), 6))


def trailing(df: DataFrame, key: str, at: str, span_ms: int, cap: int) -> DataFrame:
    """Rows of the key in the ``span_ms`` before each row (itself included, the far end not), and what the cap leaves.

    A window lies in two stretches of ``span_ms`` at most, so each row is sent to its own
    and the next one, and a key with very many rows is spread over as many tasks as it has stretches.
    Rows without a time are in no window and go.
    """
    own = F.floor(F.col(at) / span_ms)
    rows = df.withColumn("__own", own).withColumn("__part", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = Window.partitionBy(key, "__part").orderBy(at).rangeBetween(-(span_ms - 1), 0)
    rows = rows.withColumn("used", F.count("*").over(w)).where(F.col("__own") == F.col("__part")).drop("__own", "__part")
    return rows.withColumn("remaining", F.greatest(F.lit(0).cast("long"), cap - F.col("used")))


def _by_stretch(df: DataFrame, key: str, stretch: Column | None) -> DataFrame:
    """Rows with ``__part``, their key and stretch as one value, in which nulls equal each other."""
    return df.withColumn("__part", F.struct(F.col(key).alias("k"), (F.lit(0) if stretch is None else stretch).alias("p")))


def _earlier() -> Window:
    """The stretches of a key before a row's own, over one row for each."""
    return Window.partitionBy("__part.k").orderBy("__part.p").rowsBetween(Window.unboundedPreceding, -1)


def with_previous(df: DataFrame, key: str, order: list[str], value: str, stretch: Column | None = None) -> DataFrame:
    """Each row with the ``value`` of the row before it (``previous``).

    With ``stretch``, a column that grows with the order (a day, say; null where the order
    is), rows of one key and stretch are sorted together, and only the last value of each
    stretch is carried on. The result is the same: null keys are a key, and rows without a
    time come first.
    """
    if stretch is None:
        return df.withColumn("previous", F.lag(value).over(Window.partitionBy(key).orderBy(*order)))
    rows = _by_stretch(df, key, stretch)
    last = rows.groupBy("__part").agg(F.max(F.struct(*order, F.col(value).alias("__value")))["__value"].alias("__last"))
    before = last.select("__part", F.lag("__last").over(Window.partitionBy("__part.k").orderBy("__part.p")).alias("__before"))
    w = Window.partitionBy("__part").orderBy(*order)
    rows = rows.withColumn("__previous", F.lag(value).over(w)).withColumn("__first", F.row_number().over(w) == 1).join(before, "__part")
    return rows.select(*df.columns, F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__previous")).alias("previous"))


def greatest_so_far(df: DataFrame, key: str, order: list[str], names: list[str], stretch: Column | None = None, itself: bool = False) -> DataFrame:
    """Some columns replaced by their greatest value among the key's earlier rows, or up to the row ``itself``.

    ``stretch`` as in ``with_previous``: the greatest values of the stretches before are added.
    """
    rows = _by_stretch(df, key, stretch)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    out = rows.withColumns({n: F.max(n).over(w) for n in names})
    if stretch is not None:
        most = rows.groupBy("__part").agg(*(F.max(n).alias(f"{n}__most") for n in names))
        before = most.select("__part", *(F.max(f"{n}__most").over(_earlier()).alias(f"{n}__before") for n in names))
        out = out.join(before, "__part").withColumns({n: F.when(F.col(n).isNull() | (F.col(f"{n}__before") > F.col(n)), F.col(f"{n}__before")).otherwise(F.col(n)) for n in names})
    return out.select(*df.columns)


def _failures(df: DataFrame, key: str, order: list[str], failed: Column, stretch: Column | None) -> DataFrame:
    """The rows that failed, with the number of their key's successes before them (``__island``)."""
    rows = _by_stretch(df.withColumn("__failed", failed), key, stretch)
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("__island", F.count_if(~F.col("__failed")).over(w)).where("__failed")
    if stretch is not None:
        sums = rows.groupBy("__part").agg(F.count_if(~F.col("__failed")).alias("__n"))
        before = sums.select("__part", F.coalesce(F.sum("__n").over(_earlier()), F.lit(0)).alias("__n"))
        marked = marked.join(before, "__part").withColumn("__island", F.col("__island") + F.col("__n"))
    return marked.select(*df.columns, "__island")


def runs(df: DataFrame, key: str, order: list[str], failed: Column, stretch: Column | None = None) -> DataFrame:
    """Each run of consecutive failures: its key, first place and length.

    With ``stretch`` as in ``with_previous``: the successes of a key are counted in each
    stretch, and the sums over the stretches before are added.
    """
    found = _failures(df, key, order, failed, stretch).groupBy(key, "__island").agg(F.count("*").alias("length"), F.min(F.struct(*order)).alias("__first"))
    return found.select(key, "length", *(F.col("__first")[c].alias(f"first_{c}") for c in order))


def due(df: DataFrame, at: str, now: Column, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows that are due; a missing time is due."""
    return df.where(F.coalesce(F.col(at) <= now, F.lit(True))).orderBy(*(F.col(c).asc_nulls_first() for c in order)).limit(most)


def first_of_each(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each key; plans as a top-k inside each partition first."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def page_after(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """The next page by key."""
    return df.where(F.col(key) > after).orderBy(key).limit(size)


def until_failures(df: DataFrame, key: str, order: list[str], failed: Column, most: int, stretch: Column | None = None) -> DataFrame:
    """Rows of each key up to its ``most``-th failure in a row: ``sent``, and whether that came (``stopped``).

    ``order`` is unique within a key. ``stretch`` as in ``runs``; of each run only the first
    ``most`` failures are sorted, and the rows are compared with where their key stops.
    """
    run = F.row_number().over(Window.partitionBy(key, "__island").orderBy(*order))
    last = _failures(df, key, order, failed, stretch).withColumn("__run", run).where(F.col("__run") == most)
    stops = last.groupBy(F.struct(key).alias("__key")).agg(F.min(F.struct(*order)).alias("__stop"))
    rows = df.withColumn("__key", F.struct(key)).join(stops, "__key", "left")
    sent = rows.where(F.col("__stop").isNull() | (F.struct(*order) <= F.col("__stop")))
    return sent.groupBy(key).agg(F.count("*").alias("sent"), F.bool_or(F.col("__stop").isNotNull()).alias("stopped"))


def armed(df: DataFrame, key: str, order: list[str], arms: Column, uses: Column, span: str, stretch: Column | None = None) -> DataFrame:
    """Events that may use what an earlier one of their key armed: ``session`` is consumed,
    expired (the span passed), or none (not armed, or used since). ``stretch`` as in ``with_previous``."""
    at = order[0]
    rows = df.withColumn("__uses", uses).withColumn("__armed", F.when(arms, F.col(at))).withColumn("__used", F.when(F.col("__uses"), F.col(at)))
    rows = greatest_so_far(rows, key, order, ["__armed", "__used"], stretch)
    none = F.col("__armed").isNull() | F.coalesce(F.col("__used") >= F.col("__armed"), F.lit(False))
    session = F.when(none, "none").when(F.col(at) - F.col("__armed") <= F.expr(span), "consumed").otherwise("expired")
    return rows.where("__uses").withColumn("session", session).drop("__uses", "__armed", "__used")

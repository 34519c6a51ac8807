"""Triples by day with a state checkpoint per day: a point in time reads one checkpoint and what came since.

``days/run=<id>/date=<day>`` holds the triples of each day; ``state/run=<id>/asof=<day>`` the newest triple per (s, p)
before that day began. A point in time takes the last checkpoint that is not after it and the days from there to
the instant, so it costs the state plus at most ``every`` days of triples however long the history is.

Checkpoints of many days are made in one pass: the newest triple per key and day is valid from the next day to the
day of the key's next one. Triples that arrive late for days before a checkpoint are folded into every
checkpoint they concern; the checkpoints they do not concern stay as they are.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from otgraph.operators.triples import latest_by, latest_triples
from otgraph.sources.versions import File, Versions

DAY, STATE = "day", "state"
_COLS = ["s", "p", "o"]


class TripleHistory:
    """A history below ``base`` with a checkpoint every ``every`` days (counted from 1970-01-01)."""

    def __init__(self, spark: SparkSession, base: str, ts: str = "timestamp", every: int = 1):
        self.spark, self.ts, self.every = spark, ts, every
        self.versions = Versions(spark, base)

    def _write(self, rows: DataFrame, kind: str, column: str) -> list[File]:
        """Rows with a day column, written to one folder per day."""
        below = "days" if kind == DAY else "state"
        path = f"{below}/run={uuid.uuid4().hex[:12]}"
        full = f"{self.versions.base}/{path}"
        rows.write.partitionBy(column).parquet(full)
        found = self.spark.read.schema(f"{column} date").parquet(full).groupBy(column).count().collect()     # a row per day
        return [File(kind, str(r[column]), f"{path}/{column}={r[column]}", r["count"]) for r in found if r[column] is not None]

    def append(self, triples: DataFrame) -> None:
        """Bring triples in (those without a time have no place in a history), then bring the checkpoints up to the day
        after the newest triple."""
        number = self.versions.number()
        files = self.versions.files(number)
        rows = triples.select(*_COLS, self.ts).where(F.col(self.ts).isNotNull()).withColumn("date", F.to_date(self.ts))
        new = self._write(rows, DAY, "date")
        if not new:
            return
        days = [f for f in files if f.kind == DAY] + new
        states = {f.part: f for f in files if f.kind == STATE}
        states.update({f.part: f for f in self._checkpoints(new, states)})
        self.versions.commit(number, days + list(states.values()))

    def _checkpoints(self, new: list[File], states: dict[str, File]) -> list[File]:
        """Checkpoints that the new days change or add. Checkpoints stand on every grid day from the first after the oldest
        triple to the first after the newest, so no day lies further than ``every`` from one."""
        oldest, newest, known = min(f.part for f in new), max(f.part for f in new), sorted(states)
        last = max(_grid(newest, self.every), *known[-1:], "")
        changed = [d for d in known if d > oldest]
        first = min([_grid(oldest, self.every), *changed[:1]]) if changed or not known else _after(known[-1], self.every)
        if first > last:
            return []
        rows = self.versions.read(new, "days").select(*_COLS, self.ts, "date")
        for d in changed or known[-1:]:                  # all that was known before the checkpoints to be written
            rows = rows.unionByName(self._state(states[d]).withColumn("date", F.to_date(self.ts)))
        return self._write(_states(rows, first, last, self.every, self.ts), STATE, "asof")

    def _state(self, f: File) -> DataFrame:
        return self.versions.read([f], "state").where(F.col("asof") == F.lit(f.part).cast("date")).select(*_COLS, self.ts)

    def days(self) -> list[str]:
        return sorted({f.part for f in self.versions.files() if f.kind == DAY})

    def at(self, instant: dt.datetime | str) -> DataFrame:
        """Newest triple per (s, p) strictly before ``instant``."""
        when = F.to_timestamp(F.lit(instant)) if isinstance(instant, str) else F.lit(instant)
        day = self.spark.range(1).select(F.to_date(when).cast("string")).first()[0]
        files = self.versions.files()
        asof = max((f for f in files if f.kind == STATE and f.part <= day), key=lambda f: f.part, default=None)
        since = asof.part if asof else "0000-00-00"
        days = [f for f in files if f.kind == DAY and since <= f.part <= day]
        if not files:
            raise FileNotFoundError(f"no triples in {self.versions.base}")
        rows = None
        if days:
            rows = (self.versions.read(days, "days").where((F.col("date") >= F.lit(since if asof else days[0].part).cast("date")) & (F.col("date") <= F.lit(day).cast("date")))
                    .where(F.col(self.ts) < when).select(*_COLS, self.ts))
        if asof:
            rows = self._state(asof) if rows is None else rows.unionByName(self._state(asof))
        if rows is None:                                # before the first day
            rows = self.versions.read([f for f in files if f.kind == DAY][:1], "days").select(*_COLS, self.ts).limit(0)
        return latest_triples(rows, self.ts)

    def latest(self) -> DataFrame:
        """Newest triple per (s, p) of the whole history: the last checkpoint, which lies after every triple."""
        return self._state(max((f for f in self.versions.files() if f.kind == STATE), key=lambda f: f.part))


def _states(rows: DataFrame, first: str, last: str, every: int, ts: str) -> DataFrame:
    """The newest triple per (s, p) before each grid day from ``first`` to ``last``: of every key one row per day of
    change, valid from the next grid day to the day of its next change."""
    daily = latest_by(rows, ["s", "p", "date"], ts, ["o"])
    after = Window.partitionBy("s", "p").orderBy("date")
    day = lambda d: F.lit(d).cast("date")
    grid = F.date_from_unix_date((F.ceil((F.unix_date("date") + 1) / every) * every).cast("int"))
    span = (daily.withColumn("_next", F.lead("date").over(after))
            .withColumn("_from", F.greatest(grid, day(first))).withColumn("_to", F.least(F.coalesce("_next", day(last)), day(last))))
    return span.where("_from <= _to").select(*_COLS, ts, F.explode(F.sequence("_from", "_to", F.expr(f"INTERVAL {int(every)} DAYS"))).alias("asof"))


def _grid(day: str, every: int) -> str:
    """The first checkpoint day after ``day``."""
    n = (dt.date.fromisoformat(day) - dt.date(1970, 1, 1)).days + 1
    return (dt.date(1970, 1, 1) + dt.timedelta(days=-(-n // every) * every)).isoformat()


def _after(day: str, every: int) -> str:
    return (dt.date.fromisoformat(day) + dt.timedelta(days=every)).isoformat()

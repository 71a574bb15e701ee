"""Accounts and calendars: password age, single sessions, month grids, free variant ids."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def password_state(changed: Column, forced: Column, as_of: Column, days: int = 90) -> Column:
    """``forced`` where a change is demanded anyway, ``expired`` if never changed or too long ago, else ``valid``."""
    old = changed.isNull() | (as_of >= changed + F.make_dt_interval(F.lit(days)))
    return F.when(F.coalesce(forced, F.lit(False)), "forced").when(old, "expired").otherwise("valid")


def single_sessions(logins: DataFrame, user: str, order: list[Column], session: str) -> DataFrame:
    """Each login with ``ended_by``, the user's next one, which ends it; null for the live one."""
    return logins.withColumn("ended_by", F.lead(session).over(Window.partitionBy(user).orderBy(*order)))


def month_grid(day: Column) -> Column:
    """The days of a month, padded to whole weeks from Sunday to Saturday."""
    first, last = F.trunc(day, "MM").cast("date"), F.last_day(day)
    return F.sequence(F.date_sub(first, F.dayofweek(first) - 1), F.date_add(last, F.lit(7) - F.dayofweek(last)))


def variant_ids(new: DataFrame, taken: DataFrame, seed: str, order: list[Column]) -> DataFrame:
    """``variant_id``: ``<seed>-aug<k>``, counted on from the highest ``k`` that is taken. ``taken`` has the seed and ``k``."""
    top = taken.groupBy(F.col(seed).alias("__seed")).agg(F.max("k").alias("__top"))
    nth = F.row_number().over(Window.partitionBy(seed).orderBy(*order))
    met = new.withColumn("__nth", nth).join(top, F.col(seed) == F.col("__seed"), "left")
    k = F.coalesce("__top", F.lit(0)) + F.col("__nth")
    return met.withColumn("variant_id", F.concat(F.col(seed).cast("string"), F.lit("-aug"), k.cast("string"))).drop("__nth", "__seed", "__top")


def stale(status: Column, started: Column, as_of: Column, minutes: int = 60) -> Column:
    """Whether a job that is processing was started more than so many minutes ago."""
    return (status == "processing") & (as_of > started + F.make_dt_interval(mins=F.lit(minutes)))


def first_blank(fields: list[tuple[str, str]]) -> Column:
    """The label of the first required column that is null or blank; null if none is. ``fields`` are (column, label)."""
    blank = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    return F.coalesce(*(F.when(blank(c), label) for c, label in fields), F.lit(None).cast("string"))


def toggled(done: Column, hide: bool) -> Column:
    """All rows, or those that aren't done."""
    return ~F.coalesce(done, F.lit(False)) if hide else F.lit(True)


def allowed_path(path: Column, prefixes: list[str], exact: list[str]) -> Column:
    """Whether a path is one of some, or begins with one of others."""
    out = path.isin(exact)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def gate(path: Column, locked: Column, other_session: Column, expired: Column, must_change: Column, admin: Column, prefixes: list[str], exact: list[str]) -> Column:
    """What the first gate that closes asks for: ``locked``, ``other_session``, ``expired``, ``must_change``, ``not_allowed``; null if all are open.

    Administration pages have no gates.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = F.when(path.startswith("/admin/"), F.lit(None)).when(yes(locked), "locked").when(yes(other_session), "other_session").when(yes(expired), "expired")
    return out.when(yes(must_change) & ~path.isin(exact), "must_change").when(yes(admin) & ~allowed_path(path, prefixes, exact), "not_allowed")


def form_error(taken: Column, admin: Column, unit: Column, password: Column) -> Column:
    """Why a user's row is refused: the name is taken, an ordinary user has no unit, or the password lacks a letter, a digit or a sign."""
    weak = ~(password.rlike("[A-Za-z]") & password.rlike(r"\d") & password.rlike("[^A-Za-z0-9]"))
    return F.when(taken, "name_taken").when(~F.coalesce(admin, F.lit(False)) & unit.isNull(), "unit_missing").when(F.coalesce(weak, F.lit(True)), "weak_password")


def progress(items: DataFrame, key: str, kind: str, kinds: list[str], done: Column) -> DataFrame:
    """``n_done, n_all``: how many of the fixed kinds are done, each counted once."""
    hit = F.count_distinct(F.when(F.col(kind).isin(kinds) & done, F.col(kind)))
    return items.groupBy(key).agg(hit.alias("n_done")).withColumn("n_all", F.lit(len(kinds)))


def _blocking(user: int, at: int, micros: int):
    """Over rows in order of user and time: whether each is accepted. The last accepted one is all that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, last, started = None, None, False
        for b in batches:
            out = []
            for u, t in zip(b.column(user).to_pylist(), b.column(at).to_pylist(), strict=True):
                if not started or u != who:
                    who, last, started = u, None, True
                ok = last is None or t - last >= micros
                last = t if ok else last
                out.append(ok)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], [*b.schema.names, "accepted"])

    return run


def blocked_logins(logins: DataFrame, user: str, order: list[str], seconds: int, ts: str) -> DataFrame:
    """Logins under the rule that a live session blocks new ones: ``accepted`` where the last accepted one is at least ``seconds`` old.

    What is accepted depends on what was, so a user's logins go through one task in order, one after the other; none are gathered.
    """
    own = logins.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp")))
    dealt = own.repartition(user).sortWithinPartitions(user, *order)
    schema = StructType([*dealt.schema.fields, StructField("accepted", BooleanType())])
    return dealt.mapInArrow(_blocking(own.columns.index(user), own.columns.index("__at"), seconds * 1_000_000), schema).drop("__at")

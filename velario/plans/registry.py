"""The registry: what was done to each column, with which key, in which order.

A surrogate looks like a real value, so only the registry knows whether a column
was treated. It is an append-only table; the current state of a column is its entry
with the highest version.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velario.fixed import (CLEAR, ENCRYPT, ENCRYPTED, ERROR, HISTORY_LENGTH, NULLIFIED, NULLIFY,
                           RUNNING, WARNING)
from velario.plans.policy import _problems, place

ENTRY = ("database string, table string, column string, version bigint, state string, kind string, "
         "tweak string, key_id string, operation string, list string, rows bigint, "
         "last_key string, run string, updated timestamp")
_COLUMN = ["database", "table", "column"]
_AT = ["table", "column"]


class InconsistentState(RuntimeError):
    """The operation contradicts what the registry holds."""


def current(log: DataFrame) -> DataFrame:
    """The latest entry of each column; combined on the map side, nothing is collected."""
    rest = [c for c in log.columns if c not in _COLUMN]
    return (log.groupBy(*_COLUMN).agg(F.max_by(F.struct(*rest), "version").alias("__latest"))
            .select(*_COLUMN, *[F.col(f"__latest.{c}").alias(c) for c in rest]))


def listing(log: DataFrame, database: str) -> DataFrame:
    return current(log.where(F.col("database") == database)).orderBy("table", "column")


def state_of(log: DataFrame, columns: DataFrame) -> DataFrame:
    """``(database, table, column, state)``; a column never touched is in clear."""
    known = current(log).select(*_COLUMN, "state")
    return columns.select(*_COLUMN).join(known, _COLUMN, "left").withColumn(
        "state", F.coalesce("state", F.lit(CLEAR)))


def interrupted(log: DataFrame, database: str) -> DataFrame:
    """Entries of operations that began to write and never finished."""
    return listing(log, database).where(F.col("state") == RUNNING)


def history(log: DataFrame, length=HISTORY_LENGTH) -> DataFrame:
    """The states before the current one, newest first, at most ``length`` per column.

    The bound on the row number is applied before the shuffle too (a group limit in
    the plan), so a column with a very long history sends no more entries than that.
    """
    newest = Window.partitionBy(*_COLUMN).orderBy(F.col("version").desc())
    numbered = log.withColumn("__place", F.row_number().over(newest)).where(F.col("__place") <= length + 1)
    return numbered.where("__place > 1").select(
        *_COLUMN, (F.col("__place") - 1).alias("age"), "state", "key_id", "updated", "rows")


# -- new entries ------------------------------------------------------------------
def start(log: DataFrame, columns: DataFrame) -> DataFrame:
    """Entries that mark columns as being written.

    ``columns`` has database, table, column, kind, tweak, key_id, operation, list, run.
    """
    versions = current(log).select(*_COLUMN, F.col("version").alias("__before"))
    return columns.join(versions, _COLUMN, "left").select(
        *_COLUMN, (F.coalesce("__before", F.lit(0)) + 1).cast("bigint").alias("version"),
        F.lit(RUNNING).alias("state"), "kind", "tweak", "key_id", "operation", "list",
        F.lit(None).cast("bigint").alias("rows"), F.lit(None).cast("string").alias("last_key"), "run",
        F.current_timestamp().alias("updated"))


def conclude(log: DataFrame, results: DataFrame) -> DataFrame:
    """Entries that end operations; all but state and rows is taken from the start.

    ``results`` has database, table, column, state, rows. A column that was never
    started fails the job.
    """
    began = current(log).select(
        *_COLUMN, "version", "kind", "tweak", "key_id", "operation", "list", "last_key", "run")
    never = F.raise_error(F.concat(F.lit("no operation was started for "), place())).cast("bigint")
    return results.join(began, _COLUMN, "left").select(
        *_COLUMN, F.coalesce(F.col("version") + 1, never).alias("version"), "state", "kind", "tweak",
        "key_id", "operation", "list", F.col("rows").cast("bigint").alias("rows"), "last_key", "run",
        F.current_timestamp().alias("updated"))


def resolve(log: DataFrame, database, table, column, state) -> DataFrame:
    """Close an interrupted column by declaration; the interruption stays in history."""
    if state not in (CLEAR, ENCRYPTED):
        raise ValueError(f"declare '{CLEAR}' or '{ENCRYPTED}'")
    open_entry = interrupted(log, database).where((F.col("table") == table) & (F.col("column") == column))
    if open_entry.isEmpty():
        raise InconsistentState(f"{table}.{column} is not in state '{RUNNING}'")
    return conclude(log, open_entry.select(*_COLUMN, F.lit(state).alias("state"), "rows"))


def realign(log: DataFrame, database: str) -> DataFrame:
    """Entries that put all treated columns back to clear, after restoring a backup."""
    treated = listing(log, database).where(F.col("state").isin(ENCRYPTED, NULLIFIED))
    return conclude(log, treated.select(*_COLUMN, F.lit(CLEAR).alias("state"),
                                        F.lit(None).cast("bigint").alias("rows")))


# -- guards -------------------------------------------------------------------------
def _with_state(rules, log, database):
    latest = current(log.where(F.col("database") == database)).select(
        *_AT, "state", F.col("key_id").alias("used_key"), F.col("list").alias("used_list"))
    return rules.join(latest, _AT, "left")


def guard_encrypt(rules: DataFrame, log: DataFrame, database: str, resuming=()) -> DataFrame:
    """Problems that forbid encrypting. ``resuming`` are (table, column) pairs whose
    interrupted state is the starting point, not an error."""
    state = F.col("state")
    expected = F.lit(False)
    for table, column in resuming:
        expected = expected | ((F.col("table") == table) & (F.col("column") == column))
    reason = (F.when(state == ENCRYPTED, "already_encrypted")
              .when((state == RUNNING) & ~expected, "in_progress"))
    return _reasons(_with_state(rules, log, database), reason)


def guard_decrypt(rules: DataFrame, log: DataFrame, database: str, key_id: str, resuming=()) -> DataFrame:
    """Problems that forbid decrypting, the first that applies to each column.

    ``rules`` carry in ``list`` the fingerprint now in use.
    """
    state = F.col("state")
    expected = F.lit(False)
    for table, column in resuming:
        expected = expected | ((F.col("table") == table) & (F.col("column") == column))
    reason = (F.when(F.coalesce(state, F.lit(CLEAR)) == CLEAR, "not_encrypted")
              .when(state == NULLIFIED, "nullified")
              .when((state == RUNNING) & ~expected, "in_progress")
              .when(~F.col("used_key").eqNullSafe(F.lit(key_id)), "wrong_key")
              .when((F.coalesce("used_list", F.lit("")) != "")
                    & ~F.col("used_list").eqNullSafe(F.col("list")), "wrong_list"))
    return _reasons(_with_state(rules, log, database), reason)


_MESSAGES = {
    "already_encrypted": "already encrypted; encrypting again would encrypt surrogates",
    "in_progress": "an earlier operation never finished; the column has to be resolved or resumed",
    "not_encrypted": "not encrypted; there is nothing to bring back",
    "nullified": "emptied; no key brings the values back",
    "wrong_key": "encrypted with another key",
    "wrong_list": "encrypted with another word list or another treatment of off-list names",
}


def _reasons(rows, reason):
    found = rows.withColumn("__rule", reason).where(F.col("__rule").isNotNull())
    message = F.lit(None).cast("string")
    for rule, text in _MESSAGES.items():
        message = F.when(F.col("__rule") == rule, text).otherwise(message)
    return found.select(F.lit(ERROR).alias("level"), place().alias("place"),
                        F.col("__rule").alias("rule"), message.alias("message"))


def nullify_notices(rules: DataFrame, log: DataFrame, database: str, forward: bool) -> DataFrame:
    """What emptying means for each column: said aloud, not blocking."""
    rows = _with_state(rules.where(F.col("strategy") == NULLIFY), log, database)
    state = F.coalesce("state", F.lit(CLEAR))
    running = _problems(rows.where(state == RUNNING), place(), "in_progress", _MESSAGES["in_progress"])
    if forward:
        notice = _problems(rows.where(~state.isin(RUNNING, NULLIFIED)), place(), "will_be_nullified",
                           "the values will be removed and no key brings them back", WARNING)
    else:
        notice = _problems(rows.where(state == NULLIFIED), place(), "stays_nullified",
                           "was emptied and stays empty", WARNING)
    return running.unionByName(notice)


def resumable(log: DataFrame, policy: DataFrame, database: str, operation=ENCRYPT) -> DataFrame:
    """Interrupted entries that can go on from their last key."""
    encrypted = policy.where(F.col("strategy") == ENCRYPT).select(_AT)
    return (interrupted(log, database)
            .where(F.col("last_key").isNotNull() & (F.col("operation") == operation))
            .join(encrypted, _AT, "left_semi"))


def status(log: DataFrame, progress: DataFrame, database: str) -> DataFrame:
    """The listing with percentage done and seconds to go of running columns.

    ``progress`` has table, column, done, total, seconds (see ``sources.store``).
    """
    latest = progress.groupBy(*_AT).agg(
        F.max_by(F.struct("done", "total", "seconds"), "done").alias("__p"))
    running = (F.col("state") == RUNNING) & F.col("__p").isNotNull()
    done, total = F.col("__p.done"), F.col("__p.total")
    rate = F.try_divide(done, F.col("__p.seconds"))
    return (listing(log, database).join(latest, _AT, "left").select(
        *_AT, "state", "kind", "tweak", "key_id", "rows", "updated",
        F.when(running & (total > 0), F.floor(done * 100 / total)).alias("percent"),
        F.when(running, F.try_divide(total - done, rate)).alias("seconds_left"))
        .orderBy(*_AT))

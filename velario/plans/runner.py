"""Apply a policy: gate, check, mark, write, commit, conclude - one rewrite per table."""

import time
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from velario.fixed import CLEAR, DECRYPT, ENCRYPT, ENCRYPTED, LIST_TYPES, NULLIFIED, NULLIFY
from velario.operators import preview
from velario.operators.mapping import check_effect
from velario.operators.pseudonymise import Rule, context, replace_columns, with_surrogates
from velario.operators.ranges import numbered
from velario.plans import policy as P
from velario.plans import registry as R
from velario.plans.progress import Watched
from velario.session import saved
from velario.sources.store import FLAG, RANGE, TableStore
from velario.sources.tables import Constraints, describe
from velario.sources.wordlists import default_lists

# Rows per value from which a column is treated by its distinct values.
REPEATS = 20
# Seconds between two looks at the tasks of a running write.
LOOK = 10.0
REPORT = ("operation string, table string, column string, kind string, rows_updated bigint, "
          "n_untreatable bigint")


class GateFailed(RuntimeError):
    """Blocking problems; nothing was written."""

    def __init__(self, problems):
        self.problems = problems
        lines = [f"  [{p['level']}] {p['place']}: {p['message']}" for p in problems]
        super().__init__(f"{len(problems)} blocking problems:\n" + "\n".join(lines))


class UntreatableValue(ValueError):
    """A value cannot be treated; found before anything was written."""


class Report:
    """What a run did: ``columns`` rows, and the values it left in clear."""

    def __init__(self, direction, database, columns: DataFrame, untreatable: DataFrame):
        self.direction, self.database = direction, database
        self.columns, self.untreatable = columns, untreatable


class Runner:
    def __init__(self, store: TableStore, policy: DataFrame, key, database: str,
                 constraints: Constraints = None, lists=None, rows_per_range=None):
        self.store, self.policy, self.key, self.database = store, policy, key, database
        self.constraints = constraints or Constraints()
        self.lists = {**default_lists(), **(lists or {})}
        self.rows_per_range, self.look = rows_per_range, LOOK
        self.spark = store.spark

    # -- checks -------------------------------------------------------------------
    def schema(self) -> DataFrame:
        known = {r["table"] for r in self.store.tables().join(
            self.policy.select("table"), "table", "left_semi").toLocalIterator()}
        if not known:
            return self.spark.createDataFrame([], "table string, column string, type string, nullable boolean")
        return describe({t: self.store.read(t) for t in known}, self.constraints)

    def list_in_use(self, kind):
        which = LIST_TYPES.get(kind)
        return self.lists[which].treatment if which else None

    def _list_column(self):
        out = F.lit(None).cast("string")
        for kind in LIST_TYPES:
            out = F.when(F.col("kind") == kind, self.list_in_use(kind)).otherwise(out)
        return out

    def problems(self, direction=ENCRYPT, only: DataFrame = None, resuming=()) -> DataFrame:
        """Problems of policy (whole) and of schema and state (selected columns)."""
        schema, log = self.schema(), self.store.registry()
        chosen = P.select_columns(self.policy, only)
        encrypted = chosen.where(F.col("strategy") == ENCRYPT).withColumn("list", self._list_column())
        if direction == ENCRYPT:
            guard = R.guard_encrypt(encrypted, log, self.database, resuming)
        else:
            guard = R.guard_decrypt(encrypted, log, self.database, self.key.id(), resuming)
        parts = [P.check_policy(self.policy, schema, self.constraints.foreign_key_rows(self.spark)),
                 P.check_columns(self.policy, schema, self.lists, only), guard,
                 R.nullify_notices(chosen, log, self.database, direction == ENCRYPT)]
        return P.ordered_problems(reduce(DataFrame.unionByName, parts))

    def gate(self, direction, only=None, resuming=()):
        blocking = P.blocking(self.problems(direction, only, resuming))
        errors = list(blocking.toLocalIterator())      # as many as the schema has columns, at most
        if errors:
            raise GateFailed(errors)

    # -- runs -----------------------------------------------------------------------
    def _work(self, direction, only):
        """{table: (rules, columns to empty)}; as small as the policy."""
        work = {}
        for r in P.select_columns(self.policy, only).orderBy("table", "column").toLocalIterator():
            rules, empty = work.setdefault(r["table"], ([], []))
            if r["strategy"] == ENCRYPT:
                rules.append(Rule(r["column"], r["kind"], r["tweak"]))
            elif r["strategy"] == NULLIFY and direction == ENCRYPT:
                empty.append(r["column"])
        return {t: w for t, w in work.items() if w[0] or w[1]}

    def run(self, direction=ENCRYPT, on_bad="fail", only=None, on_range=None) -> Report:
        """Treat all columns of the policy, or those of ``only`` (table, column).

        ``on_bad='fail'`` finds an untreatable value before the first write;
        ``'skip'`` leaves it in clear and in the report.
        """
        if direction not in (ENCRYPT, DECRYPT) or on_bad not in ("fail", "skip"):
            raise ValueError("unknown direction or handling of untreatable values")
        self.gate(direction, only)
        results, left = [], []
        for table, (rules, empty) in self._work(direction, only).items():
            results += self._treat(table, rules, empty, direction, on_bad, self.store.new_run(),
                                   on_range, left)
        return self._report(direction, results, left)

    def resume(self, direction, table, on_bad="fail", on_range=None) -> Report:
        """Go on with an interrupted run of one table, range by range.

        The old version is unchanged, so the result equals an uninterrupted run.
        """
        wanted = (ENCRYPT, NULLIFY) if direction == ENCRYPT else (direction,)
        planned = self.store.range_plan().where(F.col("table") == table).select("run").distinct()
        # whatever range the run broke off in, the first one too: the plan says what is left
        entries = (R.interrupted(self.store.registry(), self.database)
                   .where((F.col("table") == table) & F.col("operation").isin(*wanted))
                   .join(planned, "run", "left_semi").toLocalIterator())
        by_run = {}
        for e in entries:
            by_run.setdefault(e["run"], []).append(e)
        if not by_run:
            raise LookupError(f"nothing to resume in {table}")
        run, entries = sorted(by_run.items())[0]
        nullified = sorted(e["column"] for e in entries if e["operation"] == NULLIFY)
        entries = [e for e in entries if e["operation"] != NULLIFY]
        plan = self.store.range_plan().where((F.col("run") == run) & (F.col("table") == table)).first()
        if plan is None or plan["base"] != self.store.current(table)["version"]:
            raise R.InconsistentState(f"{table} has a newer version than the interrupted run began with; "
                                      "see Runner.recover")
        columns = [e["column"] for e in entries]
        only = self.spark.createDataFrame([(table, c) for c in columns], "table string, column string")
        self.gate(direction, only, [(table, c) for c in columns])
        changed = [e for e in entries if (e["key_id"], e["list"]) != (self.key.id(), self.list_in_use(e["kind"]))]
        if changed:
            raise R.InconsistentState(f"{table} was begun with another key or word list")
        rules = [Rule(e["column"], e["kind"], e["tweak"]) for e in entries]
        left = []
        results = self._treat(table, rules, nullified, direction, on_bad, run, on_range, left, resumed=True)
        return self._report(direction, results, left)

    def _report(self, direction, results, left):
        columns = self.spark.createDataFrame(results, REPORT)
        none = self.spark.createDataFrame([], "table string, column string, value string, error string")
        return Report(direction, self.database, columns, reduce(DataFrame.unionByName, left, none))

    def _treat(self, table, rules, empty, direction, on_bad, run, on_range, left, resumed=False):
        forward, began = direction == ENCRYPT, time.time()
        base = self.store.current(table)["version"]
        df = self.store.read(table, base)
        ctx = context(self.spark, self.key, forward, self.lists)
        skipped, mapped = self._refused(table, with_surrogates(df, ctx, rules), rules, on_bad, run, began)
        wide = with_surrogates(df, ctx, rules, mapped=mapped)
        if rules and any(skipped.values()):
            left.append(preview.untreatable(df, ctx, rules).select(F.lit(table).alias("table"), "*"))

        places = self._ranges(table, df, run, resumed)
        if not resumed:
            self._start(table, rules, empty, direction, run)
        if places is None:
            counts = self._write(table, run, wide, df, rules, empty)
        else:
            counts = self._write_ranges(table, run, wide, df, rules, empty, places, on_range)
        for rule in rules:
            # every treatable value must have been replaced, or nothing is committed
            check_effect(counts[f"due_{rule.column}"], counts[f"new_{rule.column}"])
        self.store.commit(table, run, base)
        return self._conclude(table, rules, empty, direction, run, counts, skipped, began)

    def _refused(self, table, wide, rules, on_bad, run, began):
        """Untreatable values per column, and the columns whose values repeat enough to
        be treated once each. Reasons are expressions, so no surrogate is computed."""
        if not rules:
            return {}, set()
        row = wide.agg(F.count(F.lit(1)).alias("__rows"),
                       *[F.count(F.col(f"{r.column}__error")).alias(r.column) for r in rules],
                       *[F.max(f"{r.column}__error").alias(f"{r.column}__why") for r in rules],
                       *[F.approx_count_distinct(r.column).alias(f"{r.column}__distinct") for r in rules]).first()
        skipped = {r.column: row[r.column] for r in rules}
        distinct = {r.column: row[f"{r.column}__distinct"] for r in rules}
        for rule in rules:
            self.store.log_operation(run, table, rule.column, "checked", row["__rows"], distinct[rule.column],
                                     skipped[rule.column], time.time() - began)
        bad = [c for c, n in skipped.items() if n]
        if bad and on_bad == "fail":
            self.store.log_operation(run, table, bad[0], "refused", error_class="UntreatableValue")
            raise UntreatableValue(f"{table}.{bad[0]}: {skipped[bad[0]]} rows hold untreatable values "
                                   f"(for example: {row[bad[0] + '__why']}); nothing was written")
        return skipped, {c for c, n in distinct.items() if n * REPEATS <= row["__rows"]}

    def _start(self, table, rules, empty, direction, run):
        rows = [(self.database, table, r.column, r.kind, r.effective_tweak, self.key.id(), direction,
                 self.list_in_use(r.kind), run) for r in rules]
        rows += [(self.database, table, c, None, None, None, NULLIFY, None, run) for c in empty]
        columns = self.spark.createDataFrame(
            rows, "database string, table string, column string, kind string, tweak string, "
                  "key_id string, operation string, list string, run string")
        self.store.append_registry(R.start(self.store.registry(), columns))

    @staticmethod
    def _flags(rules, empty):
        """What is counted, as a test of each row: due and new by rule, gone by emptied column."""
        out = {}
        for r in rules:
            out[f"due_{r.column}"] = F.col(r.column).isNotNull() & F.col(f"{r.column}__error").isNull()
            out[f"new_{r.column}"] = F.col(f"{r.column}__new").isNotNull()
        return out | {f"gone_{c}": F.col(c).isNotNull() for c in empty}

    @staticmethod
    def _final(wide, columns, df, rules, empty):
        final = replace_columns(wide, columns, rules, "skip")
        return final.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in empty}) if empty else final

    def _write(self, table, run, wide, df, rules, empty):
        seen = Observation()
        flags = {f"{FLAG}{name}": test for name, test in self._flags(rules, empty).items()}
        measures = [F.count_if(test).alias(flag.removeprefix(FLAG)) for flag, test in flags.items()]
        counted = wide.observe(seen, F.count(F.lit(1)).alias("rows"), *measures).withColumns(flags)
        total = df.count()                                    # the files' footers tell

        def tell(share):
            self.store.log_progress(run, table, int(share * total), total)

        with Watched(self.spark, f"{run} {table}", tell, self.look):
            self.store.write(table, run, self._final(counted, [*df.columns, *flags], df, rules, empty))
        return seen.get

    # -- ranges ---------------------------------------------------------------------
    def _of_run(self, log, run, table):
        return log.where((F.col("run") == run) & (F.col("table") == table))

    def _ranges(self, table, df, run, resumed):
        """``(key, RANGE)`` of each row, or None for one write of it all. Their bounds go
        on record before a run begins; one that goes on must find the same."""
        key = self.constraints.single_key(table)
        if not resumed and not (self.rows_per_range and key):
            return None
        plan = self._of_run(self.store.range_plan(), run, table)
        if not df.where(F.col(key).isNull()).isEmpty():
            raise ValueError(f"{table}.{key} is declared a primary key but holds nulls")
        # the first range is as large as any
        size = plan.agg(F.max("n_rows").alias("n")).first()["n"] if resumed else self.rows_per_range
        places = saved(numbered(df.select(key), key).select(
            key, F.floor(F.col("__number") / size).cast("bigint").alias(RANGE)), "ranges_of_keys")
        bounds = places.groupBy(RANGE).agg(F.max(key).cast("string").alias("upto"), F.count(F.lit(1)).alias("n_rows"))
        if resumed:
            known = plan.select(F.col("number").alias(RANGE), "upto", "n_rows")
            if bounds.count() != known.count() or not bounds.exceptAll(known).isEmpty():
                raise R.InconsistentState(f"{table}: the ranges on record are not those of its keys")
        else:
            base = self.store.current(table)["version"]
            self.store._append("range_plan", bounds.select(
                F.lit(run).alias("run"), F.lit(table).alias("table"), F.lit(base).cast("bigint").alias("base"),
                F.col(RANGE).alias("number"), "upto", "n_rows"))
        return places

    def _write_ranges(self, table, run, wide, df, rules, empty, places, on_range):
        """All ranges that are not there yet, in one job; what the files hold goes on record."""
        began, key = time.time(), self.constraints.single_key(table)
        flags = {f"{FLAG}{name}": (name, test) for name, test in self._flags(rules, empty).items()}
        done = self._of_run(self.store.ranges_done(), run, table).select("number")
        left = self._of_run(self.store.range_plan(), run, table).join(done, "number", "left_anti").select(
            F.col("number").alias(RANGE), "upto", "n_rows")
        missing = left
        if (staged := self.store.staged_ranges(table, run)) is not None:
            found = staged.groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows")).join(left, RANGE)
            # only a range that several tasks wrote could be there in part
            for r in found.where(F.col("rows") != F.col("n_rows")).toLocalIterator():
                self.store.drop_staged_range(table, run, r[RANGE])
            missing = left.join(found.where(F.col("rows") == F.col("n_rows")), RANGE, "left_anti")
        missing = saved(missing.select(RANGE), "missing_ranges")
        if not missing.isEmpty():
            marked = wide.withColumns({flag: test for flag, (_, test) in flags.items()})
            placed = marked.join(places.join(missing, RANGE, "left_semi"), key)
            self.store.write(table, run, self._final(placed, [*df.columns, *flags, RANGE], df, rules, empty), by_range=True)
        counts = F.create_map(*[x for flag, (name, _) in flags.items() for x in (F.lit(name), F.count_if(flag))])
        held = self.store.staged_ranges(table, run).groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"), counts.alias("counts"))
        rows = saved(left.join(held, RANGE).where(F.col("rows") == F.col("n_rows")).select(
            F.lit(run).alias("run"), F.lit(table).alias("table"), F.col(RANGE).alias("number"), "upto", "rows", "counts",
            F.current_timestamp().alias("at")), "written_ranges")
        if on_range is None:
            self.store._append("ranges_done", rows)
        else:
            for r in rows.select("number").orderBy("number").toLocalIterator():
                self.store._append("ranges_done", rows.where(F.col("number") == r["number"]))
                on_range(r["number"])
        self.store.log_operation(run, table, None, "ranges", rows=rows.agg(F.sum("rows").alias("n")).first()["n"],
                                 seconds=time.time() - began)
        if rows.count() != left.count():
            raise R.InconsistentState(f"{table}: not every range of {run} was written")
        return self._range_totals(table, run, rules, empty)

    def _range_totals(self, table, run, rules, empty):
        """Counts over all ranges of a run, those of an earlier session included."""
        names = [f"{p}_{r.column}" for r in rules for p in ("due", "new")] + [f"gone_{c}" for c in empty]
        done = self.store.ranges_done().where((F.col("run") == run) & (F.col("table") == table))
        # a range written twice after a failure counts once
        last = done.groupBy("number").agg(F.max_by("counts", "at").alias("counts"))
        row = last.agg(F.count(F.lit(1)).alias("n"),
                       *[F.sum(F.element_at("counts", n)).alias(f"c{i}") for i, n in enumerate(names)]).first()
        return {n: row[f"c{i}"] or 0 for i, n in enumerate(names)}

    # -- end --------------------------------------------------------------------------
    def _conclude(self, table, rules, empty, direction, run, counts, skipped, began):
        entries, results = [], []
        for r in rules:
            rows = counts[f"new_{r.column}"]
            state = ENCRYPTED if direction == ENCRYPT and rows else CLEAR
            entries.append((self.database, table, r.column, state, rows))
            results.append((ENCRYPT, table, r.column, r.kind, rows, skipped.get(r.column, 0)))
        for c in empty:
            entries.append((self.database, table, c, NULLIFIED, counts[f"gone_{c}"]))
            results.append((NULLIFY, table, c, None, counts[f"gone_{c}"], 0))
        rows = self.spark.createDataFrame(
            entries, "database string, table string, column string, state string, rows bigint")
        self.store.append_registry(R.conclude(self.store.registry(), rows))
        for operation, _, column, _, n, bad in results:
            self.store.log_operation(run, table, column, "done", rows=n, skipped=bad,
                                     seconds=time.time() - began)
        return results

    # -- after a crash ------------------------------------------------------------------
    def recover(self) -> DataFrame:
        """Conclude interrupted columns whose fate the commit log tells; returns them.

        A committed run did finish; whether it touched a row its files tell. An uncommitted one that did not write by range
        changed nothing, so the column keeps the state it had before. Runs by range
        are left for ``resume``.
        """
        log = self.store.registry()
        committed = self.store.commits().select("run").where(F.col("run").isNotNull()).distinct()
        before = R.history(log).where(F.col("age") == 1).select(
            "database", "table", "column", F.col("state").alias("__before"))
        open_entries = R.interrupted(log, self.database).join(
            committed.withColumn("__done", F.lit(True)), "run", "left").join(
            before, ["database", "table", "column"], "left")
        finished = (F.when(F.col("operation") == ENCRYPT, ENCRYPTED)
                    .when(F.col("operation") == NULLIFY, NULLIFIED).otherwise(CLEAR))
        planned = self.store.range_plan().select("run").distinct().withColumn("__planned", F.lit(True))
        fate = (F.when(F.col("__done"), finished)
                .when(F.col("__planned").isNull(), F.coalesce("__before", F.lit(CLEAR))))
        told = open_entries.join(planned, "run", "left").withColumn("__fate", fate).where(
            F.col("__fate").isNotNull()).select("database", "table", "column", F.col("__fate").alias("state"), "rows", "run")
        names = ["database", "table", "column", "state", "rows"]
        rows = []
        for r in told.toLocalIterator():                       # as many as columns were open
            n = self.store.touched(r["table"], r["run"], f"new_{r['column']}") if r["state"] == ENCRYPTED else None
            rows.append((*[r[c] for c in names[:3]], CLEAR if n == 0 else r["state"], r["rows"] if n is None else n))
        told = self.spark.createDataFrame(rows, told.select(*names).schema)
        if not told.isEmpty():
            self.store.append_registry(R.conclude(log, told))
        return told

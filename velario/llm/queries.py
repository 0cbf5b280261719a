"""One query for each operator, with production parameters, over whole tables."""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.llm import (curve_packing, host_trust, language_codes, license_rules, paragraph_sketch, periodic_runs,
                         rule_cascade, simhash_trees, soft_mixing, superkmers, token_files, token_splice, turn_repair)
from velario.llm.shared import new_path, rows_of

SEQUENCE = 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_files_query(spark, sf_dir):
    """Encode, write the files, read them back."""
    path = new_path(spark, "token_files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.read_tokens(spark, path)


def paragraph_sketch_query(spark, sf_dir):
    return paragraph_sketch.compare(table(spark, sf_dir, "documents"))


def rule_cascade_query(spark, sf_dir):
    return rule_cascade.judge(table(spark, sf_dir, "documents"), counts=True)


def simhash_trees_query(spark, sf_dir):
    groups = simhash_trees.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash_trees.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def language_codes_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = language_codes.train(docs.where(~held_out).select("text", "lang"))
    found = language_codes.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def soft_mixing_query(spark, sf_dir):
    labels = soft_mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = soft_mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), labels)
    return mixed.select("doc_id", "n_tokens", "domain", "posterior", "rate")


def superkmers_query(spark, sf_dir):
    return superkmers.remove_repeats(table(spark, sf_dir, "documents"))


def curve_packing_query(spark, sf_dir):
    return curve_packing.pack(table(spark, sf_dir, "documents"), length=SEQUENCE)


def host_trust_query(spark, sf_dir):
    return host_trust.judge(table(spark, sf_dir, "pages"))


def token_splice_query(spark, sf_dir):
    counted = token_splice.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > SEQUENCE).alias("over_limit"))


def license_rules_query(spark, sf_dir):
    found = license_rules.scan(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda x: x["first_word"])
    base = F.transform("base", lambda x: x["label"])
    more = F.transform("detections", lambda x: x["label"])

    def listed(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed(F.concat(base, more)).alias("labels"),
        F.coalesce(F.array_max(F.transform("detections", lambda x: x["relevance"])), F.lit(0.0)).alias("score"))


def damaged(turns: DataFrame) -> DataFrame:
    """``conversations`` with the faults that a hash of id and turn deals out."""
    def plain(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    dealt = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn"))) % 20
    rows = turns.select("conv_id", "turn", dealt.alias("dealt"), plain("role").alias("role"), plain("text").alias("text"))
    rows = rows.where("dealt <> 0").withColumn("time", F.explode(F.sequence(F.lit(0), (F.col("dealt") == 3).cast("int"))))
    text = F.when(F.col("dealt") == 1, "").when(F.col("dealt") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("dealt") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"))


_REPAIRS = pa.schema([("conv_id", pa.int64()), *[(n, pa.int64()) for n in (
    "gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _digests(batches):
    """Adds up the blocks of each conversation, which follow each other."""
    out, now = {f.name: [] for f in _REPAIRS}, None

    def close():
        low, high, turns = now["span"]
        gaps = 0 if low is None else high - low + 1 - turns
        for name, value in zip(out, (now["conv_id"], gaps, *now["sums"], "".join(now["audit"]), now["sha"].hexdigest())):
            out[name].append(value)

    for batch in batches:
        for at in range(batch.num_rows):
            row = batch.slice(at, 1).to_pylist()[0]
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    close()
                now = {"conv_id": row["conv_id"], "span": (None, None, 0), "sums": [0] * 5, "audit": [], "sha": hashlib.sha256(),
                       "begun": False}
            low, high, turns = now["span"]
            if row["low_turn"] is not None:
                now["span"] = (row["low_turn"] if low is None else min(low, row["low_turn"]),
                               row["high_turn"] if high is None else max(high, row["high_turn"]), turns + row["turns"])
            now["sums"] = [a + row[n] for a, n in zip(now["sums"], ("blank", "duplicate", "truncated", "illegal", "cost"))]
            now["audit"].append(row["audit"])
            lines = "\n".join(f"{m['role']}:{m['text']}" for m in row["messages"])
            if row["messages"]:
                now["sha"].update((("\n" if now["begun"] else "") + lines).encode())
                now["begun"] = True
        yield rows_of(out, _REPAIRS)
        out = {f.name: [] for f in _REPAIRS}
    if now is not None:
        close()
        yield rows_of(out, _REPAIRS)


def repair_digests(repaired: DataFrame, every: DataFrame) -> DataFrame:
    """A row for each ``conv_id`` of ``every``. A conversation in one block needs no
    shuffle; of others the blocks are read in order, one at a time."""
    kind = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
    whole = repaired.where("alone").drop("alone").mapInArrow(_digests, kind)
    parts = (repaired.where(~F.col("alone")).drop("alone").repartition("conv_id").sortWithinPartitions("conv_id", "block")
             .mapInArrow(_digests, kind))
    found = whole.unionByName(parts).withColumnRenamed("conv_id", "found_id")
    ids = every.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    numbers = [F.coalesce(n, F.lit(0).cast("bigint")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, ids["conv_id"].eqNullSafe(found["found_id"]), "left").select(
        "conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def turn_repair_query(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return repair_digests(turn_repair.repair(damaged(turns)), turns)


def looped(docs: DataFrame) -> DataFrame:
    """``documents``, every tenth by a hash of its id with words that go round from some place on."""
    h = F.crc32(F.col("doc_id").cast("bigint").cast("string"))
    cut = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def turned(words):
        n, g = F.size(words), F.floor(F.col("h") / 10)
        a = (g % F.greatest(n, F.lit(1))).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        loop = F.flatten(F.array_repeat(F.slice(words, a + 1, F.greatest(p, F.lit(1))), F.ceil((n - a) / p).cast("int")))
        return F.concat(F.slice(words, F.lit(1), a), F.slice(loop, F.lit(1), n - a))

    # an array of one array: its words are cut once, not wherever they are named
    edited = F.array_join(F.transform(F.array(cut), turned)[0], " ")
    rows = docs.select("doc_id", "text", h.alias("h"))
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, edited).otherwise(F.col("text")).alias("text"))


def periodic_runs_query(spark, sf_dir):
    return run_digests(periodic_runs.periodic_runs(looped(table(spark, sf_dir, "documents"))))


def run_digests(found: DataFrame) -> DataFrame:
    none = F.get("runs", F.lit(0))
    # runs come by start, then period: a later one must have the greater exponent to be taken
    best = F.aggregate("runs", none, lambda best, r: F.when(
        r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))
    rows = found.select("doc_id", "n_words", "runs", "collapsed", best.alias("best"))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    lines = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return rows.select(
        "doc_id", "n_words", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000L * best.length div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {
    "op1_token_files": token_files_query,
    "op2_paragraph_sketch": paragraph_sketch_query,
    "op3_rule_cascade": rule_cascade_query,
    "op4_simhash_trees": simhash_trees_query,
    "op5_language_codes": language_codes_query,
    "op6_soft_mixing": soft_mixing_query,
    "op7_superkmers": superkmers_query,
    "op8_curve_packing": curve_packing_query,
    "op9_host_trust": host_trust_query,
    "op10_token_splice": token_splice_query,
    "op11_license_rules": license_rules_query,
    "op12_turn_repair": turn_repair_query,
    "op13_periodic_runs": periodic_runs_query,
}

# What SQL cannot express or not in time (models, graph iteration, tokenizers, windows
# of whole corpora) is held against brute force in tests/llm.
ORACLE_SQL = {}

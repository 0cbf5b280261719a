import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from velario.llm import soft_mixing


def soft(spark, p, n):
    names = [f"__p{d}" for d in range(p.shape[1])]
    return spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)],
                                 ", ".join(["__tokens bigint", *[f"{c} double" for c in names]]))


def test_production_steps_converge_on_soft_posteriors(spark):
    rng = np.random.default_rng(5)
    shares = np.array([0.75, 0.12, 0.11, 0.02])
    score = np.log(shares) + rng.normal(0, 1.5, (4000, 4))
    truth = np.array([rng.choice(4, p=q) for q in soft_mixing.softmax(score)])
    score[np.arange(4000), truth] += 2
    p, n = soft_mixing.softmax(score), rng.integers(20, 2000, 4000)
    targets = {"q1t0": 0.93, "q0t0": 0.05, "q1t1": 0.01, "q0t1": 0.01}
    rate, _ = soft_mixing.replay(p, soft_mixing.solve(soft(spark, p, n), list(targets), targets))
    assert (rate >= 0).all()
    assert (n * rate) @ p / n.sum() == pytest.approx(list(targets.values()), rel=0.01)


def test_unattainable_targets_give_least_squares(spark):
    """No document is surely of the first domain: the gradient leaves no rate to better."""
    p = np.array([[0.3, 0.7], [0.1, 0.9], [0.2, 0.8]] * 20)
    n = np.arange(1, 61)
    rate, _ = soft_mixing.replay(p, soft_mixing.solve(soft(spark, p, n), ["a", "b"], {"a": 0.9, "b": 0.1}))
    present = n @ p / n.sum()
    slope = p @ (((n * rate) @ p / n.sum() - [0.9, 0.1]) / present)
    assert (rate >= 0).all() and slope.min() > -1e-3 and np.abs(slope * rate).max() < 1e-2


def test_drawn_tokens_meet_the_targets(spark, monkeypatch):
    """The pipeline's stage on documents surely of one domain, in the shares of the labels."""
    targets, shares = soft_mixing.TARGETS, {"q1t0": 0.75, "q0t0": 0.12, "q1t1": 0.11, "q0t1": 0.02}
    n = 40_000
    bounds = np.cumsum(list(shares.values()))
    table = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    domain = F.lit(None).cast("string")
    for name, high in reversed(list(zip(shares, bounds.tolist()))):
        domain = F.when(F.col("doc_id") < round(high * n), name).otherwise(domain)
    rate = F.lit(None).cast("double")
    for name in shares:
        rate = F.when(F.col("domain") == name, targets[name] / shares[name]).otherwise(rate)
    mixed = table.withColumn("domain", domain).withColumn("fitted", rate).withColumn("rate", F.lit("own"))
    monkeypatch.setattr(soft_mixing, "label_domains", lambda labels: labels)
    monkeypatch.setattr(soft_mixing, "mix", lambda docs, labels: docs.withColumn("rate", F.col("own3")))
    drawn = corpus_pipeline.mixing(spark, mixed, "/root/testdata/sf0.001")
    found = {r["domain"]: r["n"] / n for r in drawn.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    for name, share in targets.items():
        assert found.get(name, 0) == pytest.approx(share, abs=0.003)
    assert drawn.columns == mixed.columns and drawn.select("rate").distinct().collect() == [("own",)]
    times = drawn.groupBy("doc_id", "domain").count().where("domain = 'q1t0'").agg(F.max("count")).first()[0]
    assert times == 2


def test_no_document_is_taken_more_often_than_allowed(spark):
    """A domain that hardly exists cannot serve its target: others share the rest, and rates stay small."""
    rng = np.random.default_rng(3)
    p = np.concatenate((rng.dirichlet([60, 3, 0.01], 3000), rng.dirichlet([1, 50, 0.01], 300), rng.dirichlet([1, 1, 50], 4)))
    n = rng.integers(20, 900, len(p))
    present = n @ p / n.sum()
    targets = np.array([0.9, 0.05, 0.05])
    rate, _ = soft_mixing.replay(p, soft_mixing.solve(soft(spark, p, n), list("abc"), dict(zip("abc", targets)), most=4.0), 4.0)
    wanted = soft_mixing.attainable(targets, present, 4.0)
    assert wanted.sum() == pytest.approx(1) and (wanted <= 2 * present + 1e-12).all() and wanted[2] < 0.01
    assert (n * rate) @ p / n.sum() == pytest.approx(wanted.tolist(), rel=0.02)
    assert rate.max() <= 4 and (rate > 0.5).mean() > 0.85


def test_one_word_makes_a_long_text_toxic(spark):
    """Rare tokens tell a domain by being there, also where another domain has a few documents only."""
    rng = np.random.default_rng(6)
    plain = [" ".join(rng.choice(["house", "river", "tree", "stone", "green", "walk"], 300)) for _ in range(400)]
    texts = [(k, t + " idiot" if k % 8 == 0 else "???" if k in (1, 2, 3) else t) for k, t in enumerate(plain)]
    labels = [(k, 0 if k in (1, 2, 3) else 1, int(k % 8 == 0)) for k in range(0, 400)]
    domains = soft_mixing.label_domains(spark.createDataFrame(labels, "doc_id int, quality int, toxic int"))
    mixed = soft_mixing.mix(spark.createDataFrame(texts, "doc_id int, text string"), domains.where("doc_id < 200"))
    late = [r for r in mixed.collect() if r["doc_id"] >= 200]
    assert all((r["domain"] == "q1t1") == (r["doc_id"] % 8 == 0) for r in late)

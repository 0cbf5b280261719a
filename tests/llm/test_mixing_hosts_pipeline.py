import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.fixtures import bag, docs, ids_of, rows
from velario.llm import host_trust, rule_cascade, simhash_trees, soft_mixing, superkmers

SMALL = "/root/testdata/sf0.001"


# -- mixing -----------------------------------------------------------------------
def labelled(spark):
    pairs = [(i, ("good plain words here today " if i % 3 else "awful idiot rubbish spam junk ") * (1 + i % 5)) for i in range(150)]
    labels = [(i, 1 if i % 3 else 0, 0) for i in range(0, 150, 2)] + [(1, None, 0), (None, 1, 0), (999, 0, 0), (3, 1, 1)]
    return docs(spark, pairs), soft_mixing.label_domains(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))


def test_totals_meet_the_targets(spark):
    source, domains = labelled(spark)
    targets = {"q1t0": 0.9, "q0t0": 0.1, "q9t9": 3.0}
    mixed = soft_mixing.mix(source, domains, targets).collect()
    assert len(mixed) == 150 and all(r["rate"] >= 0 for r in mixed)
    assert [r["n_tokens"] for r in sorted(mixed, key=lambda r: r["doc_id"])] == [
        len(ids_of(r["text"])) for r in sorted(mixed, key=lambda r: r["doc_id"])]
    total = sum(r["n_tokens"] for r in mixed)
    good = sum(r["n_tokens"] * r["rate"] for r in mixed if r["domain"] == "q1t0")
    bad = sum(r["n_tokens"] * r["rate"] for r in mixed if r["domain"] == "q0t0")
    assert good / total == pytest.approx(0.9, abs=0.05) and bad / total == pytest.approx(0.1, abs=0.05)
    assert all((r["domain"] == "q1t0") == (r["doc_id"] % 3 > 0) for r in mixed)


def test_steps_solve_the_least_squares_problem(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    n = rng.integers(1, 900, 400)
    table = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "__tokens bigint, __p0 double, __p1 double, __p2 double")
    taken = soft_mixing.solve(table, list("abc"), {"a": 0.6, "b": 0.3, "c": 0.1}, steps=60)
    rate, _ = soft_mixing.replay(p, taken)
    assert (rate >= 0).all()
    assert (n * rate) @ p / n.sum() == pytest.approx([0.6, 0.3, 0.1], abs=2e-3)


def test_mixing_awkward_rows(spark):
    _, domains = labelled(spark)
    mixed = soft_mixing.mix(docs(spark), domains)
    assert mixed.columns[-4:] == ["n_tokens", "domain", "posterior", "rate"] and len(set(mixed.columns)) == len(mixed.columns)
    assert bag(mixed.select("doc_id", "n_tokens").collect()) == bag([(i, len(ids_of(t))) for i, t in rows()])
    nothing = soft_mixing.mix(docs(spark), domains.limit(0))
    assert {r["rate"] for r in nothing.collect()} == {1.0}
    assert soft_mixing.mix(docs(spark, []), domains).count() == 0
    drawn = soft_mixing.draw(mixed.withColumn("rate", F.lit(2.0)), ["doc_id", "text"])
    assert drawn.count() == 2 * len(rows())


# -- hosts ---------------------------------------------------------------------------
PAGES = [
    (1, "https://a.com/x?q=1", None), (2, "HTTP://WWW.Example.com/en/7#t", ""), (3, "http://example.com/en/1", "<a>"),
    (4, "http://b.net/es/x", '<a href="http://c.org/1"> <a href=\'HTTPS://B.net/\'>'), (5, "http://b.net/de/x", None),
    (6, "http://c.org/y", '<img src=http://b.net/fr/q>'), (7, None, None), (8, "no scheme", None), (9, "x://", None),
    (10, "http://b.net/fr/x", '<a href="http://c.org/1">'), (11, "http://b.net/es/y", None), (12, "http://d.org", None),
    (13, "http://notexample.com/en/1", None), (14, "ftp://com/x://y/z", None), (14, "ftp://com/x://y/z", None),
    (15, "http://sub.c.org/z", None), (16, "http://e.net/es/1", None), (17, "http://e.net/fr/1", None),
    (18, "http://e.net/de/1", None)]


def pages(spark, some=PAGES):
    return spark.createDataFrame([(*p, "h", "v") for p in some], "page_id int, url string, html string, host string, verdict string")


def plain_rule(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    fits = []
    for r in host_trust.RULES:
        name, _, rest = r.text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
            fits.append((len(r.text), r.text, r.verdict))
    return host, path, *(max(fits)[1:] if fits else (None, None))


def plain_spread(some, steps=400, d=host_trust.DAMPING):
    hosts, links = {}, {}
    for _, url, html in some:
        host, _, _, verdict = plain_rule(url)
        n = hosts.setdefault(host, [0, 0, 0])
        n[0] += 1
        n[1] += verdict == "allow"
        n[2] += verdict == "block"
    crawled = set(hosts)
    for _, url, html in some:
        for to in re.findall(r"(?i)(?:href|src)\s*=\s*[\"']?[a-z][a-z0-9+.\-]*(://[^/?#\"'\s<>]+[^\"'\s<>]*)", html or ""):
            a, (b, _, _, verdict) = plain_rule(url)[0], plain_rule(to)
            if a != b:
                links[a, b] = links.get((a, b), 0) + 1
                if b not in crawled and verdict:
                    n = hosts.setdefault(b, [0, 0, 0])
                    n[1], n[2] = max(n[1], verdict == "allow"), max(n[2], verdict == "block")
    links = {(a, b): n for (a, b), n in links.items() if b in hosts}
    for h in list(hosts):
        up = h.partition(".")[2]
        if h.partition(".")[0] and up.partition(".")[0] and up.partition(".")[2]:
            hosts.setdefault(up, [0, 0, 0])
            links[h, up] = links.get((h, up), 0) + 1
            links[up, h] = links.get((up, h), 0) + 1
    out, into = {}, {}
    for (a, b), n in links.items():
        out[a] = out.get(a, 0) + n
        into[b] = into.get(b, 0) + n
    trust, bad = {h: float(n[1]) for h, n in hosts.items()}, {h: float(n[2]) for h, n in hosts.items()}
    for _ in range(steps):
        t = {h: 0 if h in out else trust[h] for h in hosts}
        b = {h: 0 if h in into else bad[h] for h in hosts}
        for (x, y), n in links.items():
            t[y] += trust[x] * n / out[x]
            b[x] += bad[y] * n / into[y]
        trust = {h: (1 - d) * hosts[h][1] + d * t[h] for h in hosts}
        bad = {h: (1 - d) * hosts[h][2] + d * b[h] for h in hosts}
    return {h: "block" if bad[h] > host_trust.SHARE * (bad[h] + trust[h] + host_trust.PRIOR * n[0]) else "allow" for h, n in hosts.items()}


def test_links_turn_verdicts_both_ways(spark):
    """A host that links to a blocked one is blocked, crawled or not; links from a trusted one save it; siblings share."""
    some = [(1, "http://lonely.org/a", '<a href="http://bad.net/es/1">'), (2, "http://neutral.org/a", "<p>"),
            (3, "http://x.evil.org/1", '<a href="http://bad.net/fr/2"> <a href="http://worse.net/es/2">'),
            (4, "http://y.evil.org/1", None), (5, "http://saved.org/1", '<a href="http://bad.net/es/1">')]
    some += [(100 + k, f"http://good{k}.com/", '<a href="http://saved.org/">') for k in range(6)]
    verdict = {r["page_id"]: r["verdict"] for r in host_trust.judge(pages(spark, some)).collect()}
    hosts = plain_spread(some)
    assert {i: hosts[plain_rule(u)[0]] for i, u, _ in some if i < 100} == {i: v for i, v in verdict.items() if i < 100}
    assert [verdict[i] for i in (1, 2, 3, 5)] == ["block", "allow", "block", "allow"]


def test_rules_and_spread_verdicts(spark):
    found = host_trust.judge(pages(spark)).collect()
    hosts = plain_spread(PAGES)
    assert bag(found) == bag([(i, h, p, r, v or hosts[h]) for i, (h, p, r, v) in ((p[0], plain_rule(p[1])) for p in PAGES)])
    verdict = {r["page_id"]: r["verdict"] for r in found}
    assert verdict[18] == "block" and verdict[12] == "allow"      # a host of blocked pages, and one without any
    assert host_trust.judge(pages(spark, [])).count() == 0


def test_rules_against_all_given_pages(spark):
    given = spark.read.parquet(f"{SMALL}/pages.parquet")
    found = host_trust.judge(given).collect()
    some = [tuple(r) for r in given.select("page_id", "url", "html").collect()]
    hosts = plain_spread(some)
    assert bag(found) == bag([(i, h, p, r, v or hosts[h]) for i, (h, p, r, v) in ((s[0], plain_rule(s[1])) for s in some)])


# -- the pipeline ---------------------------------------------------------------------
def test_stages_by_name_and_columns(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "SimHash near-dedup", "substring dedup", "mixing", "packing"]
    given = spark.read.parquet(f"{SMALL}/documents.parquet")
    before, ids = given, None
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, SMALL).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 4:
            break
        assert after.columns == given.columns
        now = {r["doc_id"]: r["text"] for r in after.collect()}
        if k == 0:
            assert set(now) == {i for i, t in texts.items() if rule_cascade.first_rejection(
                rule_cascade.Page((t or "").encode()), rule_cascade.RULES) is None}
        if k == 1:
            groups = simhash_trees.near_groups(before).collect()
            assert set(now) == {r["component_id"] for r in groups} and after.count() == len(now)
        if k == 2:
            assert set(now) == set(ids)
            from tests.llm.test_duplicates import plain_removal
            left = {i: n - m for i, n, m, _ in plain_removal(list(ids.items()), superkmers.WINDOW)}
            assert {i: len((t or "").encode().split()) for i, t in now.items()} == left
        if k == 3:
            assert set(now) <= set(ids) and len(now) > 0.5 * len(ids)
        before, ids = after, now
    tokens = {}
    for r in after.collect():
        tokens[r["doc_id"]] = tokens.get(r["doc_id"], 0) + r["length"]
    times = {r["doc_id"]: r["n"] for r in before.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert tokens == {i: (len(ids_of(t)) + 1) * times[i] for i, t in ids.items()}


def test_pipeline_of_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_nothing_reads_inside_machine_local_folders():
    folder = os.path.dirname(simhash_trees.__file__)
    source = "".join(open(os.path.join(folder, f)).read() for f in os.listdir(folder) if f.endswith(".py"))
    assert "localCheckpoint" not in source and "tempfile" not in source

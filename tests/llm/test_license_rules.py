import random
import re

from tests.llm.fixtures import bag, docs, rows
from velario.llm import license_rules, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CITED = [
    "Licensed under CC BY-NC 4.0.", "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: BSD-3-Clause",
    "cc by cc by CC-BY-SA 3.0", "GNU Lesser General Public License v2.1 or later", "All Rights Reserved", "mit licence",
    "https://creativecommons.org/licenses/by-sa/4.0/", "Permission is hereby granted, free of charge, to any person "
    "obtaining a copy of this software", "apache license apache license mit license", "dual: FreeBSD license; license: MPL 2.0",
    "distributed under the terms of the Eclipse Public License 2.0", "freed by the commons", "GNU General Public\nLicense",
    "MIT License", "İMIT License", "provided to you under the zlib license, or Python Software Foundation License"]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain_base(text):
    words, places = WORD.findall(lowered(text)), []
    for phrase, label in license_rules.BASE.items():
        own = phrase.split()
        places += [(k, label) for k in range(len(words) - len(own) + 1) if words[k:k + len(own)] == own]
    return len(words), sorted(places)


def plain_detections(text, rules=license_rules.RULES):
    """Every rule on every text; each detection held against all that were taken before."""
    line = " " + " ".join(WORD.findall(lowered(text))) + " "
    spans = []
    for k, rule in enumerate(rules):
        for hit in re.finditer(f"(?<= )(?:{rule.pattern})(?= )", line):
            first = line[:hit.start()].count(" ") - 1
            spans.append((first, first + len(hit[0].split(" ")), k))
    taken = []
    for a, b, k in sorted(spans, key=lambda s: (-rules[s[2]].priority, s[0] - s[1], s[0], s[2])):
        if not any(x <= a and b <= y for x, y, _ in taken):
            taken.append((a, b, k))
    return sorted(taken)


def mixed_texts():
    rng = random.Random(5)
    filler = ["und mit der", "the spdx", "cc", "by", "license", "gnu", "1.0", "2.0", "apache", "x", "version 2"]
    return [" ".join(rng.choice(CITED if rng.random() < 0.6 else filler) for _ in range(rng.randint(0, 12))) for _ in range(150)]


def test_prefilter_and_suppression_equal_plain_scans():
    tool = license_rules.scanner()
    for text in [*CITED, *mixed_texts(), *[t or "" for _, t in rows()]]:
        n, base, found = tool.scan(text.encode())
        assert (n, [(a, tool.rules[k].label) for a, _, k in base]) == plain_base(text)
        assert found == plain_detections(text), text


def test_there_are_hundreds_of_rules_with_their_keywords():
    assert len(license_rules.RULES) > 300 and len({r.name for r in license_rules.RULES}) == len(license_rules.RULES)
    labels = {t: {license_rules.RULES[k].label for _, _, k in plain_detections(t)} for t in CITED}
    assert labels[CITED[0]] == {"cc-by-nc"} and labels[CITED[1]] == {"gpl-3.0"} and labels[CITED[3]] == {"apache-2.0"}
    assert labels[CITED[4]] == {"bsd-3-clause"} and labels[CITED[6]] == {"lgpl-2.1"} and labels["freed by the commons"] == set()


def expected(i, text):
    n, places = plain_base(text)
    found = [license_rules.RULES[k] for _, _, k in plain_detections(text)]
    base = sorted({label for _, label in places})
    return (i, n, len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None), ",".join(base),
            ",".join(sorted({*base, *(r.label for r in found)})), max((r.relevance for r in found), default=0.0))


def test_query_on_awkward_and_given_rows(spark, tmp_path):
    pairs = [*rows(), *enumerate(CITED, 100), *enumerate(mixed_texts(), 200), (900, None), (901, "word " * 600_000 + CITED[0])]
    docs(spark, pairs).write.parquet(f"{tmp_path}/documents.parquet")
    assert bag(queries.license_rules_query(spark, str(tmp_path)).collect()) == bag([expected(*p) for p in pairs])
    small = "/root/testdata/sf0.001"
    given = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    assert bag(queries.license_rules_query(spark, small).collect()) == bag([expected(*p) for p in given])
    assert license_rules.scan(docs(spark, [])).count() == 0


def test_own_rules(spark):
    rules = (license_rules.Rule("own", "x", ("a b",), "a b(?: c)?", 5, 0.5), license_rules.Rule("low", "y", ("b",), "b", 1, 0.1, True))
    found = license_rules.scan(docs(spark, [(1, "A b, c b"), (2, "b")]), rules).collect()
    assert [[(d["label"], d["first_word"], d["last_word"]) for d in r["detections"]] for r in sorted(found)] == [
        [("x", 0, 2), ("y", 3, 3)], [("y", 0, 0)]]
    assert [len(r["base"]) for r in sorted(found)] == [2, 1]

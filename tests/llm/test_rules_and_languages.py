import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.fixtures import WORD, bag, docs, rows
from velario.llm import language_codes, rule_cascade
from velario.llm.queries import QUERIES


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for k in range(len(w) - 7):
        at[tuple(w[k:k + 8])].append(k)
    covered = {j for v in at.values() if len(v) > 1 for k in v for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n)


def test_counts_and_verdicts(spark):
    found = rule_cascade.judge(docs(spark), counts=True).collect()
    assert bag([tuple(r)[:7] for r in found]) == bag([(i, *plain_counts(t)) for i, t in rows()])
    plain = bag([(i, all(not r.rejects(rule_cascade.Page((t or "").encode())) for r in rule_cascade.RULES)) for i, t in rows()])
    assert bag([(r["doc_id"], r["kept"]) for r in found]) == plain
    assert not any(r["base_failed"] and r["kept"] for r in found)
    assert all((r["rejected_by"] is None) == r["kept"] for r in found)


def test_order_is_by_rejection_per_cost_and_changes_no_verdict(spark):
    cheap, dear = rule_cascade.RULES[0], rule_cascade.RULES[1]
    assert rule_cascade.order([dear, cheap], [(cheap.name, 1.0, 100, 50), (dear.name, 10.0, 100, 60)]) == [cheap, dear]
    assert rule_cascade.order([cheap, dear], [(cheap.name, 1.0, 100, 1), (dear.name, 2.0, 100, 90)]) == [dear, cheap]
    there = rule_cascade.judge(docs(spark), ordered=list(rule_cascade.RULES)).select("doc_id", "kept").collect()
    back = rule_cascade.judge(docs(spark), ordered=list(rule_cascade.RULES)[::-1]).select("doc_id", "kept").collect()
    assert bag(there) == bag(back)


def test_short_circuit():
    asked = []
    rules = [rule_cascade.Rule("yes", lambda p: asked.append("yes") or True), rule_cascade.Rule("no", lambda p: asked.append("no"))]
    assert rule_cascade.first_rejection(rule_cascade.Page(b"x"), rules) == "yes" and asked == ["yes"]


def test_kept_documents_keep_their_columns(spark):
    source = docs(spark)
    kept = rule_cascade.keep_good(source)
    assert kept.schema.simpleString() == source.schema.simpleString()
    good = {(i, t) for i, t in rows() if rule_cascade.first_rejection(rule_cascade.Page((t or "").encode()), rule_cascade.RULES) is None}
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == good
    assert rule_cascade.keep_good(docs(spark, [])).count() == 0


LETTERS = {"aa": "etaoin", "bb": "wxyzkq", "cc": "çéèêàù", "dd": "ßüöäch"}


def sentences(lang, n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))


def labelled(spark, langs=tuple(LETTERS), each=60):
    pairs = [(sentences(c, 5 + i % 30, 1000 * ord(c[0]) + i), c)
             for c in langs for i in range(each)]
    return spark.createDataFrame(pairs + [(None, "aa"), ("", "bb"), ("123", "cc"), ("text without a label", None)],
                                 "text string, lang string")


def test_languages_are_told_apart(spark):
    model = language_codes.train(labelled(spark))
    assert model.languages == sorted(LETTERS) and model.code.shape == (4, 7)
    fresh = [(i, sentences(c, 12, 50_000 + i)) for i, c in enumerate(sorted(LETTERS) * 25)]
    found = {r["doc_id"]: r for r in language_codes.identify(docs(spark, fresh), model).collect()}
    right = sum(found[i]["lang_pred"] == sorted(LETTERS)[i % 4] for i, _ in fresh)
    assert right >= 98 and all(0 <= r["score"] <= 1 for r in found.values())


def test_awkward_texts_and_labels(spark):
    model = language_codes.train(labelled(spark))
    found = bag(language_codes.identify(docs(spark), model).select("doc_id", "lang_pred").collect())
    assert len(found) == len(rows())
    unknown = {i for i, t in rows() if not language_codes.has_letter(t)}
    assert {i for i, c in found if c == "und"} >= unknown - {None}
    none = language_codes.train(labelled(spark).where("lang is null"))
    assert {r["lang_pred"] for r in language_codes.identify(docs(spark), none).collect()} == {"und"}
    one = language_codes.train(labelled(spark, ("aa",)).where("lang = 'aa'"))
    assert {(r["lang_pred"], r["score"]) for r in language_codes.identify(docs(spark, [(1, "etao")]), one).collect()} == {("aa", 1.0)}
    assert language_codes.identify(docs(spark, []), model).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 20])
def test_codewords_are_far_apart(n):
    code = language_codes.codewords(n)
    assert code.shape[0] == n and (np.abs(code.sum(0)) < n).all()
    apart = [int((code[i] != code[j]).sum()) for i in range(n) for j in range(i)]
    assert min(apart) >= max(1, code.shape[1] // 5)


def test_a_wrong_bit_is_corrected():
    code = language_codes.codewords(4)
    model = language_codes.Model(list("abcd"), code, None, np.zeros(7), np.ones(7), np.ones(7))
    margins = 3.0 * code[2:3].copy()
    margins[0, 4] *= -1
    assert model.distances(margins).argmin() == 2


def test_held_out_accuracy(spark):
    found = QUERIES["op5_language_codes"](spark, "/root/testdata/sf0.001")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang").where("lang is not null")
    rows_ = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows_) > 20 and sum(r["lang"] == r["lang_pred"] for r in rows_) >= 0.95 * len(rows_)

"""A type added in one file is known to rules, detection and the policy check."""

import pytest
from pyspark.sql import functions as F

from velario.functions.cards import CARD, add_cards
from velario.functions.identifiers import IdentifierType, forget, register
from velario.key import Key
from velario.operators.detect import detect
from velario.operators.pseudonymise import Rule, context, decrypt, encrypt
from velario.operators.preview import untreatable
from velario.plans.policy import incoherent_rules
from velario.sources.wordlists import default_lists

KEY = Key(bytes(range(32)))
GOOD = ["4111111111111111", "5500005555555559", "6011000990139424", "3530111333300000"]


@pytest.fixture
def cards():
    add_cards()
    yield
    forget(CARD.name)


def test_there_and_back_and_refused(spark, cards):
    df = spark.createDataFrame([(v,) for v in GOOD + [None, "", "12", "411111111111111x"]], "card string")
    rules = [Rule("card", "CARD")]
    there = encrypt(df, KEY, rules, on_bad="skip")
    hidden = [r["card"] for r in there.collect()]
    assert all(h != v and len(h) == len(v) for h, v in zip(hidden, GOOD)) and hidden[4:] == [None, "", "12", "411111111111111x"]
    assert there.where(CARD.valid(F.col("card"))).count() == len(GOOD)
    assert decrypt(there, KEY, rules, on_bad="skip").collect() == df.collect()
    assert {r["error"] for r in untreatable(df, context(spark, KEY), rules).collect()} == {"not_13_to_19_digits"}


def test_detection_and_policy_know_it_while_it_is_there(spark, cards):
    df = spark.createDataFrame([(v,) for v in GOOD], "n string")
    policy = spark.createDataFrame([("t", "n", "cifra", "CARD", None)], "table string, column string, strategy string, kind string, tweak string")
    schema = spark.createDataFrame([("t", "n", "string", True)], "table string, column string, type string, nullable boolean")
    assert detect(df, default_lists()).first()["kind"] == "CARD"
    assert incoherent_rules(policy, schema).count() == 0
    forget("CARD")
    assert detect(df, default_lists()).first()["kind"] is None
    assert [r["rule"] for r in incoherent_rules(policy, schema).collect()] == ["no_valid_type"]


def test_built_in_types_stay():
    with pytest.raises(ValueError):
        register(IdentifierType("CF", None, None))

"""Category rules: ids and expected words as the rule table states them, and large rule sets against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from pennybrook.operators import categories
from pennybrook.operators.categories import Rule


def test_ids_of_the_built_in_rules():
    rules = {r.id: r for r in categories.default_rules()}
    assert len(rules) == len(categories.default_rules())
    for id_, category, word, priority in (("r-food-1", "food", "美团", 10), ("r-housing-1", "housing", "房租", 20), ("r-housing-3", "housing", "物业", 10), ("r-fees-4", "fees", "违约金", 30), ("r-income-3", "bonus", "奖金", 25), ("r-income-7", "investment-income", "收益", 25), ("r-transport-13", "transport", "地铁", 10)):
        assert (rules[id_].category, rules[id_].pattern, rules[id_].priority) == (category, word, priority)


@pytest.mark.parametrize(("description", "want"), [("美团外卖", "food"), ("酒店预订手续费", "fees"), ("STEAM 游戏", "entertainment"), ("物业与房租", "housing"), ("工资发放", "salary"), ("nothing", None)])
def test_built_in_rules_by_hand(spark, description, want):
    df = spark.createDataFrame([(None, description, None, "")], "counterparty string, description string, tx_type string, method string")
    for chained in (categories.CHAINED, 0):
        assert df.select(categories.category(chained=chained)).first()[0] == want


def plain(rules, row):
    for r in sorted(rules, key=lambda r: -r.priority):
        fields = {"counterparty": row[0], "description": row[1], "txType": row[2], "method": row[3]}
        for value in fields.values() if r.field == "any" else [fields[r.field]]:
            if value and r.pattern and (__import__("re").search(r.pattern, value, 2) if r.is_regex else r.pattern.lower() in value.lower()):
                return r.category
    return None


def test_ten_thousand_rules(spark):
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdeABé店費") for _ in range(k))
    rules = [Rule(f"c{i % 97}", word(rng.randint(3, 6)), rng.randint(1, 5), rng.choice(["any", "any", "counterparty", "description", "txType", "method"])) for i in range(10_000)]
    rules += [Rule("re1", "^a.*b$", 3, "any", True), Rule("re2", "店\\d", 5, "description", True), Rule("bad", "(", 9, "any", True), Rule("none", "", 9)]
    rows = [tuple(word(rng.randint(0, 9)) if rng.random() < 0.9 else None for _ in range(4)) for _ in range(400)] + [(None, "x店7", "", None), ("a-b", "", "", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, counterparty string, description string, tx_type string, method string").repartition(3)
    got = {r["i"]: r["c"] for r in df.select("i", categories.category(rules).alias("c")).collect()}
    good = [r for r in rules if r.category != "bad"]
    want = {i: plain(good, r) for i, r in enumerate(rows)}
    assert got == want and None in want.values() and "re1" in want.values()


def test_chain_and_automaton_agree(spark):
    df = spark.createDataFrame([(i, "店" * (i % 2) + c, d, "转账", "m") for i, (c, d) in enumerate([("", "地铁充值"), ("超市", "水费缴纳"), ("x", "Steam"), ("x", "利息"), ("x", "none")])], "i int, counterparty string, description string, tx_type string, method string")
    a, b = (dict(map(tuple, df.select("i", categories.category(chained=n).alias("c")).collect())) for n in (1000, 0))
    assert a == b and len(set(a.values())) == 5
    assert df.select(categories.category([]).alias("c")).where(F.col("c").isNotNull()).count() == 0

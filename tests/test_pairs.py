import random

from trelliq.operators import validation


def test_pairs_of_rules_and_matches_come_once_and_are_not_compared(spark, monkeypatch):
    monkeypatch.setattr(validation, "BLOCK", 3)
    rng = random.Random(4)
    name = lambda n, most: rng.choice([None, *[f"{n}{i}" for i in range(most)]])
    matches = [(name("s", 30), name("t", 5)) for _ in range(120)]
    rules = [(name("r", 40), name("t", 5), rng.choice([None, [], [name("s", 30), name("s", 30)]])) for _ in range(90)]
    want = {(s, r) for s, t in matches for r, u, ids in rules if (t is not None and t == u) or (s is not None and s in (ids or []))}
    df = validation.rules_for_matches(spark.createDataFrame(matches, "source_id string, target string"), spark.createDataFrame(rules, "rule_id string, target string, match_ids array<string>"))
    got = [tuple(r) for r in df.select("source_id", "rule_id").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # a target's pairs grow with the square of its ids: nothing groups or moves them once they are made
    assert df._jdf.queryExecution().optimizedPlan().nodeName() == "Union"

"""The supersession processor works on plain rows and asks the state store twice a key."""
from types import SimpleNamespace

from pyspark.sql import Row
from turnwise.streaming import journal as jn


def test_a_key_costs_two_calls():
    calls, held = [], [None]
    get = lambda: calls.append("get") or held[0]
    put = lambda v: calls.append("update") or held.__setitem__(0, v)
    facts = jn.CurrentFacts()
    facts.last = SimpleNamespace(get=get, update=put)
    rows = lambda *r: iter([Row(position=p, assertion_id=a, value=v) for p, a, v in r])
    told = lambda r: [(x.assertion_id, x.status, x.superseded_by) for x in r]
    assert told(facts.handleInputRows(("c", "s", "r"), rows((2, "a2", "y"), (1, "a1", "x"), (3, "a3", None)), None)) == [
        ("a1", "SUPERSEDED", "a2"), ("a2", "SUPERSEDED", "a3"), ("a3", "CURRENT", None)]
    assert told(facts.handleInputRows(("c", "s", "r"), rows((4, "a4", None), (5, "a5", "z")), None)) == [("a4", "SUPERSEDED", "a5"), ("a5", "CURRENT", None)]
    assert calls == ["get", "update"] * 2 and held[0] == (5, "a5", "z")

"""Units are looked up in the parts of their own prompt; no words are spread out."""
from turnwise.operators import diagnostics as dg


def test_a_prompt_meets_its_units_in_one_row(spark, monkeypatch):
    def spread(*_):
        raise AssertionError("the words of a prompt were spread out")

    monkeypatch.setattr(dg, "contains_pairs", spread)
    monkeypatch.setattr(dg, "overlap_pairs", spread)
    p = spark.createDataFrame([("s", "Rules.", "who ate the pie", "abcdefghij klmnoq", "Rules. abcdefghij klmnoq who ate the pie", True), ("t", "Rules.", None, "", "", None)],
                              "sample_id string, system_prompt string, user_prompt string, memory_context string, full_prompt string, contradicts boolean")
    units = [("s", "a", "Rules!"), ("s", "b", "the pie"), ("s", "c", "abcdefghij klmnop"), ("s", "d", "klmnoq who ate"), ("s", "e", "nothing"), ("s", "f", "?"), ("s", "g", "pie the ate who when"), ("t", "a", "x")]
    u = spark.createDataFrame(units, "sample_id string, unit_id string, unit string")
    for fuzzy, near in ((0.92, "middle_context"), (None, "not_injected")):
        each, per = dg.injection_metrics(u, p, fuzzy=fuzzy)
        got = {(r.sample_id, r.unit_id): r.bucket for r in each.collect()}
        assert got == {("s", "a"): "system_prompt", ("s", "b"): "front_user_prompt", ("s", "c"): near, ("s", "d"): "end_context", ("s", "e"): "not_injected", ("s", "f"): "not_injected",
                       ("s", "g"): "front_user_prompt", ("t", "a"): "not_injected"}, fuzzy
    rows = {r.sample_id: r for r in per.collect()}
    assert abs(rows["s"].PCR - 4 / 7) < 1e-9 and rows["s"].CMR_P == 1 and rows["t"].CMR_P == 0
    said = spark.createDataFrame([("t",), ("t",)], "sample_id string")
    assert {r.sample_id: r.CMR_P for r in dg.injection_metrics(u, p, contradictions=said)[1].collect()} == {"s": 1, "t": 1}

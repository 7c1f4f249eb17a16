import pytest
from pyspark.sql import functions as F

from bidstream.functions import translation as tr
from bidstream.operators import classify, related, reviews, search, states


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"v{i} string" for i in range(len(values)))).select(column).first()[0]


@pytest.mark.parametrize("source, translated, want", [
    ("Preis 12,50 bis 3", "Price 3 up to 12,50", []), ("a 1", "a 2", ["numbers"]), ("see https://x/1", "siehe https://x/2", ["links"]), ("x", " ", ["empty"]),
    ("mail a@b.de", "mail a@c.de", ["mailboxes"]), ("w" * 100, "w", ["length"]),
])
def test_translation_faults(spark, source, translated, want):
    assert one(spark, tr.faults(F.col("v0"), F.col("v1")), source, translated) == want


@pytest.mark.parametrize("text", ["No literals", "12 at https://x/y?z=1 and a.b@c.org, 3.5", "", "1"])
def test_masks_come_back(spark, text):
    shown, literals = tr.masked(F.col("v0"))
    assert one(spark, tr.restored(shown, literals), text) == text
    assert one(spark, shown.rlike(r"\d"), text) is False


@pytest.mark.parametrize("text", ["One. Two! Three? " * 30, "word " * 100, "x" * 500, "", "a\nb. c"])
def test_pieces_join_to_the_text(spark, text):
    got = one(spark, tr.pieces(F.col("v0"), 40), text)
    assert "".join(got) == text and all(len(p) <= 40 for p in got)


@pytest.mark.parametrize("text, want", [("the road and the bridge", "en"), ("die Straße und der Weg", "de"), ("le pont et la route des", "fr"), ("las obras y el puente", "es"), ("xyz", None)])
def test_language(spark, text, want):
    assert one(spark, tr.language(F.col("v0")), text) == want


@pytest.mark.parametrize("text, want", [
    ("We buy software.", True), ("No software is needed.", False), ("No hardware; software is needed", True), ("Without maintenance, but software included", True), ("softwares", False), ("hardware excluding software", False),
])
def test_negation(spark, text, want):
    assert one(spark, classify.affirmed(F.col("v0"), "software"), text) is want


def test_scope_text_and_requirements(spark):
    text = "Supply of pumps to ISO 9001. Bidders must register at https://x.y/z. The supplier must hold insurance. Clause 3.2 applies."
    got = one(spark, classify.scope_text(F.col("v0")), text)
    assert "pumps" in got and "register" not in got and "9001" not in got and "3.2" not in got
    assert one(spark, classify.requirements(F.col("v0")), text) == ["The supplier must hold insurance."]


def test_traceable_evidence(spark):
    df = spark.sql("select 'a b c' as t, cast(null as string) as u, array(named_struct('quote', 'b c'), named_struct('quote', 'x')) as e")
    assert [q["quote"] for q in df.select(classify.traceable(F.col("e"), [F.col("t"), F.col("u")])).first()[0]] == ["b c"]


def test_rules_and_scores(spark):
    rules = [classify.Rule("a", title="road", detail="repair", code_prefix="45"), classify.Rule("b", title="road"), classify.Rule("c", code_prefix="9")]
    df = spark.createDataFrame([("road", "", ["45"]), ("road", "repair", []), ("road", "x", []), ("x", "", ["90"]), ("x", "", [])], "t string, d string, c array<string>")
    assert [r[0] for r in df.select(classify.first_rule(rules, F.col("t"), F.col("d"), F.col("c"))).collect()] == ["a", "a", "b", "c", None]
    score = lambda *x: spark.range(1).select(classify.record_score(*map(F.lit, x))).first()[0]
    assert [score(58, 3, True, False, False), score(58, 9, True, False, False), score(0, 0, False, True, False), score(58, 1, True, True, True)] == [82, 94, 12, 0]


@pytest.mark.parametrize("row, want", [
    (("active", "TENDER", "CANCELLED: x", None, "2026-12-01", "2026-01-01"), "CLOSED"), (("active", "TENDER", "Bekanntmachung vergebener Auftrag", None, None, None), "AWARDED"),
    (("active", "TENDER", "Transparenzbekanntmachung § 135 Abs. 3", None, None, None), "CLOSED"), (("active", "TENDER", "x", "VEAT", None, None), "CLOSED"),
    (("unsuccessful", "AWARD", "x", None, None, None), "CANCELLED"), (("withdrawn", "TENDER", "x", None, None, None), "WITHDRAWN"), (("not-listed", "AWARD", "x", None, None, None), "CLOSED"),
    (("", "AWARD", "x", None, "2020-01-01", None), "AWARDED"), (("complete", "TENDER", "x", None, None, None), "CLOSED"), (("postponed", "TENDER", "x", None, "2026-12-01", None), "UNKNOWN"),
    (("active", "TENDER", "x", None, "2026-06-01", None), "EXPIRED"), (("", "RENEWAL_SIGNAL", "x", None, None, None), "FUTURE"), (("", "RFI", "x", None, None, "2026-05-01"), "EARLY_ENGAGEMENT"),
    (("", "RFI", "x", None, None, "2025-05-01"), "UNKNOWN"), (("", "PIPELINE", "x", None, None, None), "FUTURE"), (("open", "TENDER", "x", None, None, None), "OPEN"), (("", "TENDER", "x", None, None, None), "UNKNOWN"),
])
def test_lifecycle(spark, row, want):
    ts = lambda i: F.col(f"v{i}").cast("timestamp")
    df = spark.createDataFrame([row], "v0 string, v1 string, v2 string, v3 string, v4 string, v5 string")
    state = states.state_of(F.col("v0"), F.col("v1"), F.col("v2"), F.col("v3"), ts(4), ts(5), F.lit("2026-06-01 00:00:00").cast("timestamp"))
    got = df.select(state.alias("s")).first()["s"]
    assert got["state"] == want and got["reason"]


def test_states_of_publishers_and_audiences(spark):
    tables = states.StateTables(statuses={"zuschlag": states.Says(1, "AWARDED", "as the publisher has it")})
    df = spark.sql("select 'Zuschlag' as s, 'TENDER' as k, 'x' as t, cast(null as string) as n, cast(null as timestamp) as d, current_timestamp() as now")
    c = F.col
    state = states.state_of(c("s"), c("k"), c("t"), c("n"), c("d"), c("d"), c("now"), tables=tables)
    assert df.select(state.alias("s")).first()["s"]["state"] == "AWARDED"
    rows = [("OPEN", "TENDER", "active", False, [], "x", None), ("OPEN", "TENDER", "postponed", False, [], "x", None), ("AWARDED", "AWARD", "", False, ["active"], "x", None),
            ("AWARDED", "AWARD", "", False, ["cancelled"], "x", None), ("AWARDED", "AWARD", "", False, None, "uk5", None), ("OPEN", "TENDER", None, True, [], None, None)]
    df = spark.createDataFrame(rows, "state string, kind string, status string, excluded boolean, a array<string>, n string, r string")
    got = [tuple(r[0]) for r in df.select(states.audiences(c("state"), c("kind"), c("status"), c("excluded"), c("a"), c("n"), c("r"))).collect()]
    assert got == [(True, False), (False, False), (False, True), (False, False), (False, False), (False, False)]


def test_reviews(spark):
    notices = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, source_hash string")
    ledger = spark.createDataFrame([("1", "a", "exclude", ""), ("2", "old", "exclude", ""), ("3", "c", "guide", "call")], "id string, source_hash string, decision string, note string")
    out = {r["id"]: r["guidance"] for r in reviews.reviewed(notices, ledger).collect()}
    assert out == {"2": None, "3": "call"} and [r["id"] for r in reviews.stale_reviews(notices, ledger).collect()] == ["2"]


def test_partition_cover():
    parts = {"A": {"x", "y"}, "B": {"z"}, "AB": {"x", "y", "z"}, "C": {"q", "x"}}
    assert reviews.partition_cover(["x", "y", "z"], parts) == ["AB"]
    assert reviews.partition_cover(["x", "y"], parts) == ["A"] and reviews.partition_cover(["q"], parts) == ["C"]


def test_renewals_and_disposables(spark):
    df = spark.createDataFrame([("1", "t", "b", "2026-07-01"), ("2", "t", "b", "2028-01-01"), ("3", "t", "b", None)], "id string, title string, buyer_name string, contract_end string")
    assert [(r["id"], r["days_left"]) for r in reviews.renewals(df, F.lit("2026-06-01")).collect()] == [("1:renewal", 30)]
    rows = spark.createDataFrame([(1, "p", True), (2, "q", True), (3, "q", False)], "id long, component string, old boolean")
    assert [r["id"] for r in reviews.disposable(rows, [F.col("old")], rows.where("id = 3"), "component").collect()] == [1]


def test_indel_ratio(spark):
    pairs = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("a", "b"), (None, "x")], "a string, b string")
    assert [r[0] for r in pairs.select(related.indel_ratio("a", "b")).collect()] == [75.0, 100.0, 0.0, None]


def test_filters_and_unknown_values(spark):
    df = spark.createDataFrame([(1, 5.0, "EUR"), (2, None, "EUR"), (3, 9.0, None)], "id long, value_max double, currency string")
    chosen = search.Filters(value_from=1, currency="EUR")
    assert [r["id"] for r in df.where(search.conjunction(chosen.predicates())).collect()] == [1]
    assert df.where(search.conjunction(search.Filters().predicates())).count() == 3

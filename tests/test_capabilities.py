import pytest
from pyspark.sql import functions as F

from bidstream.operators.capabilities import prefiltered
from bidstream.sources import config

YAML = """
capabilities:
  crm: {family: platform, explicit: [CRM, customer relationship management], needs: [case management]}
  chat: {family: ai, explicit: [chatbot], contextual: [assistant], context: [software, digital]}
  staff: {family: staffing, needs: [interim staff]}
"""


def score(spark, title, description, codes=(), **options):
    df = spark.createDataFrame([(title, description, list(codes))], "title string, description string, codes array<string>")
    return prefiltered(df, config.capabilities(config.parsed(YAML)), ("48",), **options).first()


def test_scores(spark):
    r = score(spark, "CRM system", "We need case management. A chatbot too.", ["48000000"])
    assert (r["score"], r["capabilities"], r["priority"], r["candidate"]) == (46 + 12 + 6 + 12, ["chat", "crm"], "platform", True)
    assert {(e["phrase"], e["field"], e["quote"]) for e in r["evidence"]} == {("crm", "title", "CRM system"), ("case management", "description", "We need case management."), ("chatbot", "description", "A chatbot too.")}


def test_context_negation_and_weak_families(spark):
    assert score(spark, "x", "An assistant for the office.")["score"] == 0
    r = score(spark, "x", "A digital assistant.")
    assert (r["score"], r["priority"]) == (16, "other")
    assert score(spark, "x", "No CRM is wanted.")["score"] == 0
    r = score(spark, "Interim staff", "")
    assert (r["score"], r["candidate"]) == (10, False) and score(spark, "Interim staff", "", ["48"])["score"] == 32 + 12 + 12
    assert score(spark, None, None)["score"] == 0


def test_digital_scope_and_exclusions(spark):
    assert score(spark, "x", "y", digital=F.lit(True))["score"] == 12
    assert score(spark, "CRM", "y", exclusions=F.array(F.lit("supply")))["score"] == 0


def test_configuration(spark, tmp_path):
    (tmp_path / "c.yaml").write_text(YAML)
    assert config.read(spark, str(tmp_path / "c.yaml")) == config.parsed(YAML)
    with pytest.raises(ValueError, match="repeated"):
        config.parsed("a: 1\nb: {c: 1, c: 2}")
    with pytest.raises(ValueError, match="no phrases"):
        config.capabilities({"capabilities": {"x": {"family": "f"}}})

"""Kinds of personal data are calibrated on examples of their own."""

from linkspan.llm import pii

PROSE = "We met at noon. This is what he came from at and. Of these {} none was left at home. Then we slept"


def made_up(spark):
    rows = [(i, f"write to user{i}@mail{i % 9}.example.com or pay with card 41111111111111{i % 90 + 10}. " + PROSE.format(i)) for i in range(900)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_prose_stays(spark):
    model = pii.train(made_up(spark))
    texts = [PROSE.format(7), "mail 5 of us: jane.doe [at] mail3.example [dot] com today"]
    out = [r.text for r in pii.redact(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1), model).collect()]
    assert out[0] == texts[0]
    assert "email" in model.thresholds and "[EMAIL]" in out[1] and "jane" not in out[1]


def test_kinds_without_spans_learn_from_planted_ones(spark):
    """Texts without a span of some kind teach it all the same, so that a small or plain table behaves like any other."""
    rows = [(i, f"hosts 10.0.{i % 200}.7 and card 41111111111111{i % 90 + 10}") for i in range(900)]
    model = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(model.thresholds) == set(pii.KINDS)


def test_weak_negatives():
    whole = lambda kind, text: pii.weak_negative((kind, 0, len(text)), text)
    assert whole("email", "X at noon. This") and whole("email", "a@b. Of") and not whole("email", "a (at) b dot com")
    assert whole("ip", "12:30:45:10") and not whole("ip", "2001:db8::1:2:3")
    assert whole("phone", "2019-12-10") and whole("phone", "12 34 56") and not whole("phone", "030 123 45 67")

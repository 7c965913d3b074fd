import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from citeweave import constants as C
from citeweave.operators import summaries
from tests.conftest import rows

CHOSEN = (
    "concept string, paper_id string, title string, abstract string, publication_year int,"
    " cited_by_count int, rank bigint"
)


def chosen(spark):
    return spark.createDataFrame(
        [("x", "p1", "T" * 600, "A" * 10_050, 2001, 7, 1), ("x", "p2", None, " \t\n", None, None, 2),
         ("x", "p3", "third", "abs", 0, 3, 3), ("y", "p1", "only", None, 1999, 0, 1)],
        CHOSEN,
    )


def test_prompt_text(spark):
    found = summaries.concept_prompts(chosen(spark), 3)
    whole = summaries.concept_prompts(chosen(spark), 3, title_chars=None, abstract_chars=None)
    cut = {r.concept: len(r.prompt) for r in found.collect()}
    for row in whole.collect():
        left_out = found.where(F.col("concept") == row.concept).first().chars_left_out
        assert row.chars_left_out == 0 and len(row.prompt) == cut[row.concept] + left_out
    prompts = dict(rows(found, "concept", "prompt"))
    head = 'Based on the following representative papers for the concept "x", provide a concise'
    assert prompts["x"].startswith(head)
    blocks = prompts["x"].split("\n\n")
    assert blocks[1] == (
        "Paper 1:\n  Title: " + "T" * 500 + "\n  Abstract: " + "A" * 10_000
        + "\n  Year: 2001\n  Citations: 7"
    )
    assert blocks[2] == "Paper 2:\n  Title: \n  Citations: 0"
    assert blocks[3] == "Paper 3:\n  Title: third\n  Abstract: abs\n  Citations: 3"
    assert blocks[4] == C.PROMPT_INSTRUCTIONS
    one = summaries.concept_prompts(chosen(spark), 1)
    assert "Paper 2" not in dict(rows(one, "concept", "prompt"))["x"]


def test_conversation_roles(spark):
    talk = summaries.concept_conversations(chosen(spark)).where("concept = 'y'").first().conversation
    assert [m.role for m in talk] == ["system", "user"]
    assert talk[0].content == C.SYSTEM_MESSAGE


@pytest.mark.parametrize(
    "raw, ok, expected",
    [
        ('{"definition": "d"}', True, {"definition": "d"}),
        ('```json\n{"a": {"b": [1, {"c": 2}]}}\n```', True, {"a": {"b": [1, {"c": 2}]}}),
        ('<|channel|>analysis {x}\n<|end|>{"a": 1}', True, {"a": 1}),
        ('<|channel|>commentary {x}<|end|><analysis>{\n}</analysis> so {"a": 1} done', True, {"a": 1}),
        ('{"error": "mine"}', False, {"error": "mine"}),
        ('{"error": null}', False, {"error": None}),
        ('{"inner": {"error": 1}}', True, {"inner": {"error": 1}}),
        ('{"a": 1} and {"b": 2}', False, None),
        ('{"a": 1},{"b": 2}', False, None),
        ('{"a": 1}}', False, None),
        ('{"a": 1', False, None),
        ("no object\n", False, None),
        ("", False, None),
    ],
)
def test_parsing(spark, raw, ok, expected):
    frame = spark.createDataFrame([("x", raw)], "concept string, raw_response string")
    row = summaries.parse_responses(frame).first()
    assert row.parse_ok is ok
    if expected is None:
        parsed = json.loads(row.response)
        assert parsed["error"] == C.PARSE_FAILURE and parsed["raw"] == raw.strip()
    else:
        assert json.loads(row.response) == expected


def scorer():
    def score(talks):
        users = [talk[1]["content"] for talk in talks]
        return pd.DataFrame(
            {
                "raw_response": [json.dumps({"definition": u.split('"')[1]}) for u in users],
                "tokens_generated": [10] * len(users),
                "finish_reason": "stop",
            }
        )

    return score


def broken_scorer():
    return lambda talks: pd.DataFrame(
        {"raw_response": [], "tokens_generated": [], "finish_reason": []}
    )


def test_scoring_and_stats(spark):
    raw = summaries.score_conversations(summaries.concept_conversations(chosen(spark)), scorer)
    results = summaries.number_by_concept(summaries.parse_responses(raw))
    assert rows(results, "id", "concept", "summary.definition") == [(0, "x", "x"), (1, "y", "y")]
    stats = summaries.run_stats(results, 4.0, 90.0).first()
    assert (stats.concepts_processed, stats.total_tokens_generated) == (2, 20)
    assert (stats.tokens_per_second, stats.avg_seconds_per_concept) == (5.0, 2.0)
    assert (stats.json_parse_ok, stats.json_parse_failed, stats.total_wall_seconds) == (2, 0, 94.0)
    none = summaries.run_stats(results.limit(0), 0.0).first()
    assert (none.concepts_processed, none.tokens_per_second, none.avg_tokens_per_concept) == (0, 0, 0)


def test_scorer_must_answer_every_conversation(spark):
    talks = summaries.concept_conversations(chosen(spark))
    with pytest.raises(Exception, match="scorer gave 0 rows"):
        summaries.score_conversations(talks, broken_scorer).collect()


def test_numbers_follow_the_concepts(spark):
    names = ["b", "a", "ab", "aa", "", "ba", "aab"]
    frame = spark.createDataFrame([(n,) for n in names], "concept string")
    got = rows(summaries.number_by_concept(frame), "id", "concept")
    assert got == list(enumerate(sorted(names)))

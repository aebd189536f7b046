"""The operators that are to be native have no Python in their plans."""

import re

import pytest

from tarnforge.llm import chat, pii


@pytest.mark.parametrize("make", [lambda d, c: pii.proposals(d, "doc_id"), lambda d, c: pii.personal_data(d), lambda d, c: pii.redacted(d), lambda d, c: chat.read_back(chat.formatted(chat.with_injection(c)))])
def test_plan(spark, sf, make):
    df = make(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/conversations.parquet"))
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())

"""Texts meet lists through a filter: its size changes which texts travel, never the rows."""

import pytest

from argusframe.llm import common, line_dedup, near_dedup
from argusframe.operators.membership import Filter

LINE = "this line of more than forty characters stands in many documents"
WORDS = " ".join(f"word{i}" for i in range(60))


def documents(spark):
    rows = [(i, f"{LINE}\nown line {i} {'x' * i}\n") for i in range(12)] + [(20 + i, WORDS + f" end{i}") for i in range(4)]
    rows += [(3, f"{LINE}\nanother text of the same id"), (None, LINE), (40, None), (41, ""), (20, WORDS + " end0")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def rows_of(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("step", [line_dedup.dedup_lines, near_dedup.keep_one])
def test_a_filter_that_lets_everything_travel_gives_the_same_rows(spark, monkeypatch, step):
    docs = documents(spark)
    usual = rows_of(step(docs))

    def crowded(digests, n):
        """Of 64 bits, all of which are set."""
        return Filter.of(spark.range(2000).selectExpr("id AS digest").unionByName(digests), n, 64)

    with monkeypatch.context() as patched:
        patched.setattr(common.Listed, "make", staticmethod(crowded))
        assert rows_of(step(docs)) == usual
    assert rows_of(step(docs.where("doc_id = 99"))) == []

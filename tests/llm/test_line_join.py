"""The plan of line dedup is that of large tables on small ones too."""

from meridian.llm import lines
from meridian.llm.common import Work


def test_documents_meet_their_removals_by_one_plan(spark, docs):
    made = lines.dedup(Work(spark, "t"), docs([(0, "a line of more than forty characters, twice\nb"), (1, "a line of more than forty characters, twice")]))
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

"""The breakdown after suppression must not shuffle landmarks."""

from conftest import SF
from kinframe.plans import all_queries
from kinframe.sources.fixtures import Views


def joined_columns(plan):
    """Names of the left columns of every semi join below ``plan``."""
    children = plan.children()
    below = [children.apply(i) for i in range(children.size())]
    if plan.nodeName() == "Join" and "LeftSemi" in plan.joinType().toString():
        left = below[0].output()
        yield {left.apply(i).name() for i in range(left.size())}
    for child in below:
        yield from joined_columns(child)


def test_flags_are_joined_not_landmarks(spark):
    df = all_queries()["p13_breakdown_after_nms"].run(Views(spark, SF))
    found = list(joined_columns(df._jdf.queryExecution().optimizedPlan()))
    assert found and all(not names & {"kps", "x1", "eq_score"} and "reject_reason" in names for names in found)

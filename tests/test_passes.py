"""What queries over the driver's tables do once: the shuffle of the boxes, the parse of a text, the look at a ring."""

import os
import re

import pytest

import __spark_entry__ as entry
from atrium.operators import scene
from atrium.plans import queries, solids

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_shuffle_what_places_need(spark):
    """only a row's key, the columns of its order and its discount go to the window."""
    text = queries.boxes(spark, DATA)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    widths = [int(n) for n in re.findall(r"\) Exchange\nInput \[(\d+)\]", text)]
    assert max(widths) == 8


def test_rings_are_looked_at_once_for_floor_and_ceiling(spark):
    """F8: both kinds come from one pass, and are what each gives by itself."""
    assert plan(entry.queries()["p16_faces_made"](spark, DATA)).count("[faults(") == 1
    bent = solids.bent_rooms(spark, DATA).where("plan_id < 5")
    cols = ("plan_id", "room_index", "name", "type", "fault", "vertices", "faces")
    both = sorted(map(repr, scene.slabs(bent, ("floor", "ceiling")).select(*cols).collect()))
    alone = [repr(r) for k in ("floor", "ceiling") for r in scene.slabs(bent, k).select(*cols).collect()]
    assert both and both == sorted(alone)


def test_documents_are_made_and_read_in_one_pass(spark):
    """walls and rooms are grouped together, a text is parsed once, and labels that nobody asks for aren't made."""
    text = plan(entry.queries()["f10_ceiling_toggle"](spark, DATA))
    assert text.count("from_json(") == 1 and text.count("Window [") == 1 and "Join [" not in text and "title(" not in text


def test_parts_of_a_scene_parse_once_each(spark):
    """F16: one parse for the walls' names and one for the rooms'."""
    assert plan(entry.queries()["c1_object_names"](spark, DATA)).count("from_json(") == 2


def test_parts_of_a_scene_share_their_documents(spark):
    """F16: the documents are dealt out, each branch of the scene reads that one shuffle."""
    df = entry.queries()["c1_object_names"](spark, DATA)
    assert df.collect()
    assert "ReusedExchange" in plan(df) and plan(df).count("REPARTITION_BY_COL") >= 1

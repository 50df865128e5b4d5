"""The rotations of there and back are found once."""

from conftest import DATA

from chronoplate.operators import rotations
from chronoplate.plans import rotation_queries


def test_rotations_are_found_once(spark, monkeypatch):
    calls, found = [], rotations.plate_rotations
    monkeypatch.setattr(rotations, "plate_rotations", lambda *args: calls.append(1) or found(*args))
    assert rotation_queries.there_and_back(spark, DATA).count() > 0
    assert len(calls) == 1

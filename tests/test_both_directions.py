"""Text and transforms pass through both directions."""

import pytest

from linewave.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["coef_text", "morlet_sql", "morlet_mirrored_each", "morlet_unpadded", "reflect_index"])
def test_both_directions_are_there(spark, sf_dir, name):
    assert {r.direction for r in QUERIES[name](spark, sf_dir).select("direction").distinct().collect()} == {0, 1}


def test_text_of_both_directions_has_the_matrix_rows_as_lines(spark, sf_dir):
    cells = {}
    for r in QUERIES["morlet_cols"](spark, sf_dir).where("image_id = 1").collect():
        cells.setdefault((r.channel, r.scale, r.y), {})[r.x] = r.c
    text = {(r.channel, r.scale, r.line): r.text for r in QUERIES["coef_text"](spark, sf_dir).where("image_id = 1 and direction = 1").collect()}
    assert set(text) == set(cells)
    for k, own in cells.items():
        assert [float(v) for v in text[k].split(",")] == pytest.approx([own[x] for x in sorted(own)], abs=1.1e-3)

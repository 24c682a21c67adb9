"""The pipeline on nulls, empties, repeated rows, clashing columns and nothing at all."""

import os

import pytest

import corpus_pipeline
from linewave import storage
from tests.llm.fixtures import documents, frame, prose


def written_tables(spark, folder, rows, items, extra=True):
    frame(spark, rows, extra=extra).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows = documents() + [(200 + i, prose(300 + i, 40), "en", None) for i in range(8)]
    folder = written_tables(spark, tmp_path, rows, [(1, prose(303, 40)), (None, None), (2, "")])
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert got and set(got[0].asDict()) == {"doc_id", "start", "n_tokens", "ids_crc32"}
    assert not {6, 7, 8, 203} & ids  # no letters; a benchmark item
    assert ids <= {d for d, *_ in rows} and sorted(r.start for r in got)[0] == 0


@pytest.mark.parametrize("items", [[], [(1, "two words")]])
def test_nothing_gives_nothing(spark, tmp_path, items):
    folder = written_tables(spark, tmp_path, [], items)
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_what_a_stage_wrote_is_deleted_once_the_next_has_written(spark, tmp_path):
    folder = written_tables(spark, tmp_path, documents(), [(1, prose(303, 40))], extra=False)
    root = storage._scratch_root(spark).removeprefix("file:")
    storage.clear_scratch(spark)
    assert corpus_pipeline.run(spark, folder).count() > 0
    left = {name.rsplit("-", 1)[0] for name in os.listdir(root)}
    assert left <= {"mixing", "tokens"}

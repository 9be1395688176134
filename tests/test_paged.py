"""A paged history: one generation, forward only, pages left out by filters, and followed as a stream."""

from __future__ import annotations

import json

import pytest

from corvane.sources import paged

SCHEMA = "id long, room string"


def write(folder, i, ids, following, generation="g1"):
    (folder / f"{i}.json").write_text(json.dumps({"generation": generation, "next": following, "rows": [{"id": x, "room": f"r{x % 2}", "more": 1} for x in ids]}))


@pytest.fixture
def pages(spark, tmp_path):
    paged.register(spark)
    for i in range(4):
        write(tmp_path, i, range(10 * i + 1, 10 * i + 11), i + 1 if i < 3 else None)
    return tmp_path


def load(spark, folder):
    return spark.read.format("paged").schema(SCHEMA).option("client", "tests.pages_client:folder").option("at", str(folder)).load()


def test_walks_and_restarts(tmp_path):
    from tests.pages_client import folder

    for i in range(3):
        write(tmp_path, i, range(10 * i + 1, 10 * i + 11), i + 1 if i < 2 else None)
    assert [(p.token, p.first, p.last) for p in paged.walk(folder(str(tmp_path)))] == [(None, 1, 10), (1, 11, 20), (2, 21, 30)]
    (tmp_path / "move").write_text("3")
    assert len(paged.walk(folder(str(tmp_path)))) == 3
    (tmp_path / "move").write_text("4")
    with pytest.raises(paged.Moved):
        paged.walk(folder(str(tmp_path)))
    (tmp_path / "move").write_text("0")
    write(tmp_path, 2, [20, 31], None)
    with pytest.raises(paged.Backward):
        paged.walk(folder(str(tmp_path)))


def test_pages_that_filters_leave_out_are_not_read(spark, pages):
    found = load(spark, pages).where("id > 10 and id <= 20 and room = 'r1'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "> 10" not in plan and "<= 20" not in plan and "= r1" in plan  # the bounds went into the source
    assert sorted(r.id for r in found.collect()) == [11, 13, 15, 17, 19]
    asked = (pages / "asked").read_text()
    assert "page 1\n" in asked and "page 0" not in asked and "page 2" not in asked and "page None" not in asked
    assert load(spark, pages).count() == 40 and load(spark, pages).where("id > 99").count() == 0


def test_a_page_of_another_generation_fails_the_read(spark, pages):
    df = load(spark, pages)
    rows = paged._Reader({"client": "tests.pages_client:folder", "at": str(pages)}, df.schema)
    first = rows.partitions()
    write(pages, 2, range(21, 31), 3, "g2")
    with pytest.raises(paged.Moved):
        [list(rows.read(p)) for p in first]
    with pytest.raises(Exception, match="moved 4 times"):
        df.collect()


def test_stream_follows_the_pages(spark, pages, tmp_path):
    out = []

    def run():
        stream = spark.readStream.format("paged").schema(SCHEMA).option("client", "tests.pages_client:folder").option("at", str(pages)).load()
        q = stream.writeStream.foreachBatch(lambda df, _: out.append(sorted(r.id for r in df.collect()))).option("checkpointLocation", str(tmp_path / "cp")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    run()
    assert sorted(x for b in out for x in b) == list(range(1, 31))  # the last page may still grow
    write(pages, 3, range(31, 41), 4)
    write(pages, 4, [], None)
    run()
    assert sorted(x for b in out for x in b) == list(range(1, 41))

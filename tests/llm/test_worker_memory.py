import pyarrow as pa

from llm import op6_suffix as op6
from llm import op7_jaccard as op7
from llm.tables import small_batches
from tests.llm.conftest import prose
from tests.llm.test_duplicates import shingles


class Frame:
    """Gives back what would run in the tasks."""

    def mapInArrow(self, run, schema):
        return run


def test_tasks_get_long_texts_a_few_megabytes_at_a_time(spark):
    small_batches(spark)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], ["bytes", "n"])

    got = spark.range(0, 60, 1, 1).selectExpr("id", "repeat('a', 100000) AS text").mapInArrow(sizes, "bytes long, n long").collect()
    assert sum(r.n for r in got) == 60 and max(r.bytes for r in got) < 2_200_000


def test_limits_of_the_session_stay(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "3000000b")
        small_batches(spark)
        assert spark.conf.get(name) == "3000000b"
    finally:
        spark.conf.set(name, before)


def test_segments_are_found_in_small_slices_and_stay_the_same(monkeypatch):
    texts = [prose(k % 7, 3000) for k in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(texts)], ["doc_id", "text"])
    longest, most = max(map(len, texts)), []
    real = op6.segments

    def counted(data, *rest):
        most.append(len(data))
        return real(data, *rest)

    monkeypatch.setattr(op6, "segments", counted)
    run = op6.segment_rows(Frame(), 100, True)
    got = sorted(map(str, pa.Table.from_batches(run([batch])).to_pylist()))
    assert sum(most) == sum(map(len, texts)) > 2 * max(most) and max(most) <= (1 << 18) + longest
    monkeypatch.setattr(op6, "HASH_BYTES", 1 << 30)
    assert got == sorted(map(str, pa.Table.from_batches(run([batch])).to_pylist()))


def test_shingles_do_not_depend_on_the_slices(spark, messy, monkeypatch):
    def rows():
        found = op7.shingle_rows(messy, "doc_id", "text", 5, None).collect()
        assert sorted(r.n for r in found) == sorted(len(shingles(r.text)) for r in messy.collect())
        return sorted(map(str, found))

    whole = rows()
    monkeypatch.setattr(op7, "HASH_BYTES", 64)
    assert rows() == whole

"""Files that grow, are rotated, emptied, cut in the middle of a line, and read again after a stop."""

import os

import pytest

from accessloom.sources.growing import GrowingReader, follow_lines


class Log:
    def __init__(self, folder):
        self.folder = folder
        folder.mkdir()

    def add(self, text, name="access.log"):
        with open(self.folder / name, "ab") as f:
            f.write(text.encode() if isinstance(text, str) else text)

    def rotate(self):
        os.rename(self.folder / "access.log", self.folder / "access.log.1")


@pytest.fixture
def log(tmp_path):
    return Log(tmp_path / "log")


def drain(spark, tmp_path, **options):
    """All lines handed on so far, over all runs with one checkpoint."""
    stream = follow_lines(spark, str(tmp_path / "log"), **options).select("value", "file", "at")
    query = (stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.schema("value string, file string, at long").parquet(str(tmp_path / "out")).collect()
    assert len({(r.file, r.at) for r in rows}) == len(rows)
    return sorted(r.value for r in rows)


def test_appended_lines_arrive_once_and_whole(spark, tmp_path, log):
    log.add("a1\na2\nhal")
    assert drain(spark, tmp_path) == ["a1", "a2"]
    assert drain(spark, tmp_path) == ["a1", "a2"]  # a restart without news
    log.add("f\n\nü\r\n")
    log.add(b"\xff bad\nunfinished")
    assert drain(spark, tmp_path) == ["", "a1", "a2", "half", "ü", "\ufffd bad"]
    log.add("b1\n", "other.log")
    log.add(" line\n")
    log.add("no line yet", "third.log")
    log.add("x", "old.log.gz")
    assert drain(spark, tmp_path) == ["", "a1", "a2", "b1", "half", "unfinished line", "ü", "\ufffd bad"]


def test_rotation_and_emptying(spark, tmp_path, log):
    log.add("a1\na2\n")
    assert drain(spark, tmp_path) == ["a1", "a2"]
    log.add("a3\n")
    log.rotate()
    log.add("b1\n")
    assert drain(spark, tmp_path) == ["a1", "a2", "a3", "b1"]
    log.add("a4\n", "access.log.1")  # the server still holds the old file
    assert drain(spark, tmp_path) == ["a1", "a2", "a3", "a4", "b1"]
    os.truncate(tmp_path / "log" / "access.log", 0)
    log.add("c1\nc2\n")
    assert drain(spark, tmp_path) == ["a1", "a2", "a3", "a4", "b1", "c1", "c2"]
    os.remove(tmp_path / "log" / "access.log.1")
    log.add("c3\n")
    assert drain(spark, tmp_path) == ["a1", "a2", "a3", "a4", "b1", "c1", "c2", "c3"]


def test_tail(spark, tmp_path, log):
    log.add("old\nunfin")
    assert drain(spark, tmp_path, position="tail") == []
    log.add("ished\nnew\n")
    assert drain(spark, tmp_path, position="tail") == ["new", "unfinished"]
    log.add("n\n", "later.log")
    assert drain(spark, tmp_path, position="tail") == ["n", "new", "unfinished"]


def test_pieces_of_a_file(spark, tmp_path, log):
    lines = [f"{i} " + "x" * (i * 37 % 90) for i in range(500)]
    log.add("\n".join(lines) + "\n")
    assert drain(spark, tmp_path, pieceBytes=61) == sorted(lines)


def test_bounded_batches(spark, tmp_path, log):
    lines = [f"{i:04d} " + "x" * (400 if i == 150 else 20) for i in range(300)]
    log.add("\n".join(lines) + "\n")
    sizes, got = [], []

    def keep(batch, number):
        rows = batch.collect()
        sizes.append(sum(len(r.value) + 1 for r in rows))
        got.extend(r.value for r in rows)

    def run():
        stream = follow_lines(spark, str(tmp_path / "log"), max_bytes=200, positions=str(tmp_path / "o" / "positions"))
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "o")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run()
    more = [f"{i:04d} more" for i in range(300, 340)]
    log.add("\n".join(more) + "\n")
    run()  # bounded after a restart, too
    lines += more
    assert sorted(got) == lines and len(sizes) > 30
    assert max(sizes) <= 406 and sorted(sizes)[-2] <= 200  # one line is longer than a batch


def test_a_planned_batch_reads_the_same_again(tmp_path, log):
    """Offsets name bytes: growth, renaming and new files don't change what a batch is."""
    log.add("a1\na2\n")
    reader = GrowingReader({"path": str(tmp_path / "log")})
    end = reader.latestOffset()
    read = lambda: [r for p in GrowingReader({"path": str(tmp_path / "log")}).partitions({}, end)
                    for b in reader.read(p) for r in b.column(0).to_pylist()]
    assert read() == ["a1", "a2"]
    log.add("a3\n")
    log.rotate()
    log.add("b\n")
    assert read() == ["a1", "a2"]
    os.remove(tmp_path / "log" / "access.log.1")
    with pytest.raises(FileNotFoundError):
        read()
    lenient = GrowingReader({"path": str(tmp_path / "log"), "failondataloss": "false"})
    assert [b for p in lenient.partitions({}, end) for b in lenient.read(p)] == []


def test_a_file_out_of_sight_is_not_read_again(tmp_path, log):
    log.add("a\n")
    reader = GrowingReader({"path": str(tmp_path / "log")})
    one = reader.latestOffset()
    assert reader.partitions(reader.initialOffset(), one)
    os.rename(tmp_path / "log", tmp_path / "away")
    two = reader.latestOffset()
    assert not reader.partitions(one, two)
    os.rename(tmp_path / "away", tmp_path / "log")
    assert not reader.partitions(two, reader.latestOffset())


def test_refused():
    with pytest.raises(ValueError):
        GrowingReader({"path": "s3a://bucket/log"})
    with pytest.raises(ValueError):
        GrowingReader({"path": "/x", "position": "middle"})
    with pytest.raises(ValueError):
        GrowingReader({})

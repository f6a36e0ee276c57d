import io
import os

import pytest
from memlake.sources import readers
from memlake.sources.log_lines import LogLines, LogStream, lines_from, whole

TEXTS = ["", "\n", "one", "one\n", "a\n\nb\nlonger line\n", "é\nüü\n" * 5 + "tail", "x" * 300 + "\ny\n", "\n\n\n"]


def lines(text):
    at, out = 0, []
    for line in text.encode().splitlines(keepends=True):
        out.append((at, line))
        at += len(line)
    return out


@pytest.mark.parametrize("text", TEXTS)
def test_every_line_lies_in_one_block(text):
    data = text.encode()
    for block in (1, 2, 3, 7, 1000):
        got = [x for at in range(0, len(data), block) for x in lines_from(io.BytesIO(data), at, min(at + block, len(data)))]
        assert got == lines(text)
    assert whole(io.BytesIO(data), len(data)) == data.rfind(b"\n") + 1


def test_batches(spark, tmp_path):
    spark.dataSource.register(LogLines)
    for i, text in enumerate(TEXTS):
        (tmp_path / f"{i}.log").write_text(text)
    (tmp_path / "_hidden.log").write_text("no\n")
    (tmp_path / "other.txt").write_text("no\n")
    for block in (5, 1 << 20):
        rows = spark.read.format("log_lines").option("suffix", ".log").option("blockBytes", block).load(str(tmp_path)).collect()
        got = sorted((os.path.basename(r["path"]), r["start"], r["line"]) for r in rows)
        assert got == sorted((f"{i}.log", at, line.decode().removesuffix("\n")) for i, text in enumerate(TEXTS) for at, line in lines(text))
    texts = spark.createDataFrame([(f"{i}", text) for i, text in enumerate(TEXTS)], "path string, text string")
    for cap in (1, 4, 9, 200):
        rows = spark.read.format("log_lines").option("tail", cap).load(str(tmp_path)).where("path like '%.log'").collect()
        # the split of a text has an empty last piece after a line break, which is no line of a file
        want = [(r["path"], r["line"]) for r in readers.tail_lines(texts, cap).orderBy("path", "pos").collect()]
        ended = {str(i) for i, text in enumerate(TEXTS) if text.endswith("\n") or not text}
        last = {p: max(k for k, x in enumerate(want) if x[0] == p) for p in {p for p, _ in want}}
        want = [x for k, x in enumerate(want) if not (x[0] in ended and k == last[x[0]])]
        assert [(os.path.basename(r["path"]).removesuffix(".log"), r["line"]) for r in sorted(rows, key=lambda r: (r["path"], r["start"]))] == want
    one = spark.read.format("log_lines").load(f"file:{tmp_path}/4.log").collect()
    assert [r["line"] for r in one] == ["a", "", "b", "longer line"]


def test_a_folder_without_files_and_one_that_is_not_there(spark, tmp_path):
    spark.dataSource.register(LogLines)
    assert spark.read.format("log_lines").load(str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("log_lines").load(str(tmp_path / "nowhere")).collect()


def test_the_ranges_follow_from_the_offsets(tmp_path):
    stream, path = LogStream({"path": str(tmp_path)}), str(tmp_path / "a.log")
    took = lambda a, b: [(p.start, p.end) for p in stream.partitions(a, b)]
    assert stream.latestOffset() == {}
    seen = [{}]
    for text in ("one\ntw", "one\ntwo\n", "other\n", "oth", "other beginning, longer\nx\n"):
        (tmp_path / "a.log").write_text(text)
        seen.append(stream.latestOffset())
    assert [took(a, b) for a, b in zip(seen, seen[1:], strict=False)] == [[(0, 4)], [(4, 8)], [(0, 6)], [], [(0, 26)]]
    assert took(seen[2], seen[2]) == [] and path in seen[1]


def test_a_stream_takes_what_was_added_and_starts_a_truncated_file_again(spark, tmp_path):
    spark.dataSource.register(LogLines)
    (tmp_path / "in").mkdir()
    a, b = tmp_path / "in/a.log", tmp_path / "in/b.log"

    def run():
        rows = spark.readStream.format("log_lines").option("blockBytes", 8).load(str(tmp_path / "in"))
        q = rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
        return sorted(r["line"] for r in spark.read.schema("line string").parquet(str(tmp_path / "out")).collect())

    a.write_text("a1\na2\na3 is not end")
    assert run() == ["a1", "a2"]
    assert run() == ["a1", "a2"]
    with a.open("a") as f:
        f.write("ed\na4 is\n")
    b.write_text("b1\n")
    assert run() == ["a1", "a2", "a3 is not ended", "a4 is", "b1"]
    a.write_text("new\n")  # rotated away: shorter
    b.write_text("another beginning\n")  # replaced by a longer one
    assert run() == ["a1", "a2", "a3 is not ended", "a4 is", "another beginning", "b1", "new"]

import os

import pytest
from pyspark.sql import functions as F

from codeseam.sources import files as scans
from codeseam.streaming import incremental

BODY = "import os\n\n\nclass A:\n    def f(self):\n        x = 12345\n        return x\n" * 4


def write(folder, name, text, at):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    os.utime(path, (at, at))


def lines(files):
    """One row for each line of each file."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("line", "text"))


def as_set(df):
    rows = [tuple(r) for r in df.select("path", "line", "text").collect()]
    assert len(rows) == len(set(rows)), "a row stands twice"
    return set(rows)


@pytest.fixture
def place(tmp_path):
    folder, root = tmp_path / "src", str(tmp_path / "state")
    for k in range(4):
        write(folder, f"m{k}.txt", f"file {k}\nend", 1_000_000 + k)
    return folder, root


def whole(spark, folder):
    return as_set(lines(scans.scan(spark, str(folder))))


def test_changes_alone_are_read_and_replace_their_rows(spark, place):
    folder, root = place
    seen = []

    def analyse(files):
        seen.append({os.path.basename(r.path) for r in files.select("path").collect()})
        return lines(files)

    read = incremental.folder_reader(spark, str(folder))

    def turn():
        incremental.record_folder(spark, root, str(folder))
        incremental.update(spark, root, read, analyse)
        return as_set(incremental.current(spark, root))

    assert turn() == whole(spark, folder) and seen.pop() == {"m0.txt", "m1.txt", "m2.txt", "m3.txt"}
    write(folder, "m1.txt", "changed\ntwice\nthree", 1_000_100)
    write(folder, "sub/m9.txt", "new", 1_000_101)
    (folder / "m2.txt").unlink()
    assert turn() == whole(spark, folder) and seen.pop() == {"m1.txt", "m9.txt"}
    write(folder, "m2.txt", "back again", 1_000_200)
    assert turn() == whole(spark, folder) and seen.pop() == {"m2.txt"}
    before = len(seen)
    assert turn() == whole(spark, folder)  # nothing has changed
    assert all(not s for s in seen[before:])


def test_restart_between_the_tables_of_a_batch(spark, place, monkeypatch):
    """The first run dies after its rows are written and before its batch is committed; the second one runs it again."""
    folder, root = place
    read, calls = incremental.folder_reader(spark, str(folder)), []
    incremental.record_folder(spark, root, str(folder))
    incremental.update(spark, root, read, lines)
    write(folder, "m0.txt", "other\ntext", 1_000_300)
    incremental.record_folder(spark, root, str(folder))
    plain = incremental._batches

    def dies(session, table):
        calls.append(table)
        raise RuntimeError("lost")

    def analyse(files):
        lines(files).write.mode("append").parquet(f"{root}/rows/batch=1")  # what a lost run may leave
        return lines(files)

    monkeypatch.setattr(incremental, "_batches", dies)
    with pytest.raises(Exception, match="lost"):
        incremental.update(spark, root, read, analyse)
    monkeypatch.setattr(incremental, "_batches", plain)
    stale = as_set(incremental.current(spark, root))
    assert calls and ("file 0" in {t for _, _, t in stale}) and ("other" not in {t for _, _, t in stale})
    incremental.update(spark, root, read, lines)
    assert as_set(incremental.current(spark, root)) == whole(spark, folder)


def test_a_committed_batch_run_again_changes_nothing(spark, place):
    folder, root = place
    read = incremental.folder_reader(spark, str(folder))
    incremental.record_folder(spark, root, str(folder))
    incremental.update(spark, root, read, lines)
    os.remove(f"{root}/checkpoint/commits/0")
    for crc in (f"{root}/checkpoint/commits/.0.crc",):
        if os.path.exists(crc):
            os.remove(crc)
    incremental.update(spark, root, read, lines)
    assert as_set(incremental.current(spark, root)) == whole(spark, folder)


def test_whole_batches_replace_older_folders(spark, place):
    folder, root = place
    read = incremental.folder_reader(spark, str(folder))
    for k in range(6):
        write(folder, f"m{k % 3}.txt", f"round {k}\nmore", 1_001_000 + k)
        if k == 3:
            (folder / "m3.txt").unlink()
        incremental.record_folder(spark, root, str(folder))
        incremental.update(spark, root, read, lines, whole_every=2)
        assert as_set(incremental.current(spark, root)) == whole(spark, folder)
    assert incremental._batches(spark, f"{root}/touched") == [4, 5]
    assert sorted(n for n in os.listdir(f"{root}/rows") if n.startswith("batch=")) == ["batch=4", "batch=5"]


def test_findings_of_changed_files(spark, tmp_path):
    folder, root = tmp_path / "src", str(tmp_path / "state")
    write(folder, "a.py", BODY, 1_000_000)
    write(folder, "b.js", "var unused = 1;\nfetch(a).then(b);\n", 1_000_001)
    read = incremental.folder_reader(spark, str(folder))
    for text in (None, "var used = 2;\ngo(used);\n"):
        if text:
            write(folder, "b.js", text, 1_000_002)
        incremental.record_folder(spark, root, str(folder))
        incremental.update(spark, root, read)
        got = incremental.current(spark, root)
        want = incremental.static_findings(scans.scan(spark, str(folder)))
        key = ["path", "line_start", "rule_id", "message"]
        assert sorted(map(str, got.select(key).collect())) == sorted(map(str, want.select(key).collect()))


def test_source_prunes_by_time(spark, place):
    folder, _ = place
    changes = scans.scan(spark, str(folder)).where("path like '%m1.txt'").select("path", "modified")
    plan = incremental.folder_reader(spark, str(folder))(changes)._jdf.queryExecution().executedPlan().toString()
    assert "modificationTime" in plan.split("PushedFilters")[1].split("]")[0] or "LessThanOrEqual(modificationTime" in plan


def test_empty_and_unknown(spark, tmp_path):
    with pytest.raises(ValueError):
        incremental.current(spark, str(tmp_path / "none"))
    assert incremental.current(spark, str(tmp_path / "none"), "path string, line int").count() == 0

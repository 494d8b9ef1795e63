"""Bundles written by planned tasks: even bytes, few files, the same text."""

import re

import pytest
from pyspark.sql import functions as F

import model
from bindery.operators import packing, unpacking
from bindery.operators.prefix import stacked
from bindery.sinks.bundles import write_planned
from bindery.sources.bundles import read_bundles


def lines(n, salt):
    return "".join(f"line {salt} {i}\n" for i in range(n)).encode()


@pytest.fixture
def rows():
    """A third in one bundle, the rest in many small ones, some files far over a shard."""
    hot = [("hot", f"h{i}", lines(400 if i % 50 == 7 else i % 23, i)) for i in range(150)]
    small = [(f"b{i % 40:02}", f"s{i}", lines(i % 17, i)) for i in range(300)]
    return [row for pair in zip(hot, small[:150], small[150:]) for row in pair]


def parts(folder):
    return sorted(folder.glob("part-*"), key=lambda p: int(re.match(r"part-(\d+)", p.name)[1]))


@pytest.mark.parametrize("budget, task_bytes, span", [(500, 4000, 8), (3000, 2000, 1), (50, 10**9, 3)])
def test_tasks_write_the_packed_text(spark, make_files, tmp_path, rows, budget, task_bytes, span):
    files, out = make_files(rows), tmp_path / "out"
    placed, tasks = packing.assign_tasks(
        packing.render(files), files, budget, task_bytes, span=span, entries=6
    )
    counts = write_planned(placed, tasks, str(out))
    assert counts["files"] == len(rows)
    bundles = {}
    for bundle, path, data in rows:
        bundles.setdefault(bundle, []).append((path, data))
    folders = {p.name.removeprefix("bundle="): p for p in out.glob("bundle=*")}
    assert set(folders) == set(bundles)
    for bundle, members in bundles.items():
        text = "".join(p.read_bytes().decode() for p in parts(folders[bundle]))
        assert text == model.pack(members)
    written = list(out.glob("bundle=*/part-*"))
    assert len(written) <= tasks + len(bundles)
    held = {}
    for p in written:
        task = int(re.match(r"part-(\d+)", p.name)[1])
        held[task] = held.get(task, 0) + p.stat().st_size
    total = sum(len(d) + len(p) + 200 for _, p, d in rows)
    largest = max(len(d) + len(p) + 200 for _, p, d in rows)
    assert max(held.values()) <= min(task_bytes, total // 8 + 1) + budget + largest
    assert tasks >= 8

    got = {}
    for r in unpacking.restore(read_bundles(spark, str(out))).orderBy("bundle", "pos").collect():
        got.setdefault(r.bundle, []).append((r.path, r.content))
    assert got == {b: model.unpack(model.pack(f)) for b, f in bundles.items()}


def test_shards_are_those_of_the_plan(make_files, rows):
    files = make_files(rows)
    placed, tasks = packing.assign_tasks(files, files, 700, 3000)
    plan = packing.shard_plan(files, 700)
    got = placed.select("bundle", "seq", "shard", "task").collect()
    assert sorted(r[:3] for r in got) == sorted(map(tuple, plan.collect()))
    ordered = [r.task for r in sorted(got)]
    assert ordered == sorted(ordered) and ordered[0] == 0 and ordered[-1] < tasks


def test_content_is_shuffled_straight_to_its_task(make_files, rows):
    files = make_files(rows)
    placed, tasks = packing.assign_tasks(packing.render(files), files, 700, 3000)
    plan = placed.repartitionById(tasks, "task")._jdf.queryExecution().executedPlan().toString()
    side = plan.index("BroadcastExchange")
    assert plan.count("shufflepartitionidpassthrough") == 1 and "SortMergeJoin" not in plan
    below = plan[plan.index("shufflepartitionidpassthrough"):side].split("\n", 1)[1]
    assert "Exchange" not in below


def test_part_numbers_of_six_digits_come_last(spark, tmp_path, make_files):
    texts = {n: model.pack([(f"p{n}", b"x\n")]) for n in (99999, 100000)}
    for n, text in texts.items():
        folder = tmp_path / "bundle=a"
        folder.mkdir(exist_ok=True)
        (folder / f"part-{n:05}-x.c000.txt").write_text(text)
    read = read_bundles(spark, str(tmp_path)).orderBy("pos")
    assert [r.path for r in read.collect()] == ["p99999", "p100000"]


def test_names_and_empty_catalogs(spark, make_files, tmp_path):
    names = ["", "007", "1e3", "a/b=c"]
    files, out = make_files([(n, "p", b"x") for n in names]), str(tmp_path / "out")
    write_planned(*packing.assign_tasks(packing.render(files), files), out)
    assert sorted(r.bundle for r in read_bundles(spark, out).collect()) == names
    none = files.where("seq < 0")
    placed, tasks = packing.assign_tasks(packing.render(none), none)
    assert tasks == 1 and placed.count() == 0
    assert write_planned(placed, tasks, str(tmp_path / "none"))["files"] == 0


def test_stacked_sums(spark):
    df = spark.range(1000).select(
        F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("k"),
        (F.col("id") * 37 % 101).alias("v"),
    )
    total, expected = 0, {}
    for k, v in sorted(map(tuple, df.collect())):
        expected[k] = total
        total += v
    got = stacked(df, "k", "v", "before")
    assert got.columns == ["k", "v", "before"]
    assert {r.k: r.before for r in got.collect()} == expected

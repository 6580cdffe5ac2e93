"""Maintained aggregates: after each edit the state equals a rebuild, and only changed partitions are read."""

import os
import shutil
from collections import defaultdict
from decimal import Decimal

import pytest

from tidemark.operators.maintained import Maintained

SHAPE = "k string, v decimal(18,2), q int"


def put(spark, source, part, rows):
    spark.createDataFrame([(k, Decimal(v), q) for k, v, q in rows], SHAPE).write.mode("overwrite").parquet(f"{source}/part={part}")


def rebuilt(parts):
    out = defaultdict(lambda: [0, 0, 0])
    for rows in parts.values():
        for k, v, q in rows:
            out[k] = [out[k][0] + 1, out[k][1] + v, out[k][2] + q]
    return {k: tuple(x) for k, x in out.items()}


def test_refresh_reads_changed_partitions_only(spark, tmp_path):
    source, root = f"file://{tmp_path}/source", f"file://{tmp_path}/kept"
    parts = {"01": [("a", 5, 1), ("b", 3, 1), (None, 1, 1)], "02": [("a", 2, 7)], "x": [("c", 9, 2)]}
    for part, rows in parts.items():
        put(spark, source, part, rows)
    read = []
    kept = Maintained(spark, root, source, "part", ["k"], {"v": "v", "q": "q"}, transform=lambda df: (read.append(sorted(os.path.dirname(f).rsplit("=", 1)[1] for f in df.inputFiles())), df)[1])
    state = lambda run=None: {r["k"]: (r["n"], int(r["v"]), r["q"]) for r in kept.state(run).collect()}
    with pytest.raises(ValueError, match="nothing"):
        kept.state()
    assert kept.refresh() == ["01", "02", "x"] and state() == rebuilt(parts)
    assert kept.refresh() is None and kept.runs() == [0]
    first = rebuilt(parts)

    parts["02"] = [("a", 4, 7), ("d", 1, 1)]
    put(spark, source, "02", parts["02"])
    assert kept.refresh() == ["02"] and set(read[-1]) == {"02"} and state() == rebuilt(parts) and state(0) == first
    log = {r["k"]: (r["change"], r["old_n"], None if r["old_v"] is None else int(r["old_v"]), r["new_n"], int(r["new_v"])) for r in kept.changelog(1).collect()}
    assert log == {"a": ("update", 2, 7, 2, 9), "d": ("insert", None, None, 1, 1)}

    shutil.rmtree(tmp_path / "source" / "part=x")
    parts.pop("x")
    parts["new"] = [("b", -3, 0), (None, 2, 2)]
    put(spark, source, "new", parts["new"])
    assert kept.refresh() == ["new", "x"] and set(read[-1]) == {"new"} and state() == rebuilt(parts)
    assert {(r["k"], r["change"]) for r in kept.changelog(2).collect()} == {("c", "delete"), ("b", "update"), (None, "update")}

    # A run that dies before its fingerprints are complete does not count, and is done again.
    put(spark, source, "01", [("a", 100, 100)])
    parts["01"] = [("a", 100, 100)]
    assert kept.refresh() == ["01"]
    os.remove(tmp_path / "kept" / "fingerprints" / "run=00000003" / "_SUCCESS")
    assert kept.runs() == [0, 1, 2] and kept.refresh() == ["01"] and state() == rebuilt(parts)


def test_floats_are_refused(spark, tmp_path):
    spark.createDataFrame([("a", 1.5)], "k string, v double").write.parquet(f"file://{tmp_path}/source/part=1")
    with pytest.raises(ValueError, match="exact"):
        Maintained(spark, f"file://{tmp_path}/kept", f"file://{tmp_path}/source", "part", ["k"], {"v": "v"}).refresh()

"""Files as tables."""
import io
import json

import numpy as np
import pytest

from meshloom.sources import npz, polymesh, text


def test_npz_shards_with_and_without_optional_arrays(spark, tmp_path):
    rng = np.random.default_rng(0)
    for k, more in ((0, {"fields": rng.normal(size=(5, 6)).astype(np.float16), "stratum": np.array([0, 1, 2, 0, 1], np.uint8)}), (1, {})):
        buf = io.BytesIO()
        np.savez(buf, header=json.dumps({"case_id": f"c{k}"}), points=rng.normal(size=(5, 3)).astype(np.float32), wall_dist=np.ones(5, np.float16), normal=np.ones((5, 3), np.float16), **more)
        (tmp_path / f"c{k}.npz").write_bytes(buf.getvalue())
    rows = npz.read_shards(spark, str(tmp_path)).collect()
    assert len(rows) == 10 and {r.case_id for r in rows} == {"c0", "c1"}
    assert all((r.ux is None) == (r.case_id == "c1") for r in rows) and sorted(r.stratum for r in rows if r.case_id == "c0") == [0, 0, 1, 1, 2]


HEAD = 'FoamFile\n{\n    version 2.0;\n    format %s;\n    class %s;\n    arch "%s;label=%d;scalar=%d";\n    object x;\n}\n'


@pytest.mark.parametrize("binary,order,label,scalar", [(False, "LSB", 32, 64), (True, "LSB", 32, 64), (True, "MSB", 64, 32)])
def test_polymesh_files(spark, tmp_path, binary, order, label, scalar):
    folder = tmp_path / "case1" / "constant" / "polyMesh"
    folder.mkdir(parents=True)
    e = "<" if order == "LSB" else ">"
    fmt = "binary" if binary else "ascii"
    p = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0.5]])
    body = lambda a, t: b"%d\n(" % len(a) + np.asarray(a).astype(f"{e}{t}{(label if t == 'i' else scalar) // 8}").tobytes() + b")\n"
    head = lambda c: (HEAD % (fmt, c, order, label, scalar)).encode()
    flat = [0, 1, 2, 0, 2, 3]
    if binary:
        (folder / "points").write_bytes(head("vectorField") + body(p, "f"))
        (folder / "faces").write_bytes(head("faceCompactList") + body([0, 3, 6], "i") + body(flat, "i"))
        (folder / "owner").write_bytes(head("labelList") + body([0, 1], "i"))
    else:
        (folder / "points").write_bytes(head("vectorField") + b"4\n(\n" + b"\n".join(b"(%g %g %g)" % tuple(r) for r in p) + b"\n)\n")
        (folder / "faces").write_bytes(head("faceList") + b"2\n(\n3(0 1 2)\n3(0 2 3)\n)\n")
        (folder / "owner").write_bytes(head("labelList") + b"2\n(\n0\n1\n)\n")
    (folder / "boundary").write_bytes(head("polyBoundaryMesh") + b"2\n(\n wall // comment;\n {\n type wall;\n nFaces 2;\n startFace 0;\n }\n procBoundary0to1\n { type processor; nFaces 1; startFace 2; }\n)\n")
    got = sorted(map(tuple, polymesh.read(spark, str(tmp_path), "points").select("case_id", "point_id", "x", "y", "z").collect()))
    assert got == [("case1", i, *map(float, r)) for i, r in enumerate(p)]
    assert [list(r.vertices) for r in polymesh.read(spark, str(tmp_path), "faces").orderBy("face_id").collect()] == [[0, 1, 2], [0, 2, 3]]
    assert [r.cell_id for r in polymesh.read(spark, str(tmp_path), "owner").orderBy("face_id").collect()] == [0, 1]
    assert [tuple(r) for r in polymesh.read(spark, str(tmp_path), "boundary").collect()] == [("case1", "wall", "wall", 2, 0)]


def test_broken_polymesh_is_refused():
    with pytest.raises(polymesh.MeshError):
        polymesh.labels((HEAD % ("ascii", "labelList", "LSB", 32, 64)).encode() + b"3\n(\n0\n1\n)\n")
    with pytest.raises(polymesh.MeshError):
        polymesh.types({"arch": "VAX;label=32;scalar=64"})


def test_lines_and_backups(spark, tmp_path):
    f = tmp_path / "c" / "postProcessing" / "forces" / "0.5" / "forces.dat"
    f.parent.mkdir(parents=True)
    f.write_text("# head\n1 (1 2 3)\n2 (1 2 3)")
    rows = text.read_monitors(spark, str(tmp_path), "forces.dat").orderBy("line_no").collect()
    assert [(r.case_id, r.monitor, r.start, r.line_no) for r in rows] == [("c", "forces", 0.5, i) for i in (1, 2, 3)]
    sums = text.checksums(spark, str(tmp_path))
    kept = spark.createDataFrame(sums.collect(), sums.schema)
    assert text.backup_faults(kept, sums).count() == 0
    f.write_text("changed")
    assert [r.fault for r in text.backup_faults(kept, text.checksums(spark, str(tmp_path))).collect()] == ["differs"]

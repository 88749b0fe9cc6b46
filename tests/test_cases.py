"""Cases from solver folders: two boxes on the ground as mesh files, with fields of two times."""
import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.operators import batches, cases, etl, samples
from meshloom.sources import foam, npz, polymesh, text

HEAD = 'FoamFile\n{\n    version 2.0;\n    format ascii;\n    class %s;\n    object x;\n}\n'


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Cells [0,2]x[0,2]x[0,2] and [2,4]x[0,2]x[0,2]; the floor is ground, the roof a wall."""
    root = tmp_path_factory.mktemp("foam")
    m = root / "box" / "constant" / "polyMesh"
    m.mkdir(parents=True)
    at = [(2 * i, 2 * j, 2 * k) for k in range(2) for j in range(2) for i in range(3)]
    n = {p: i for i, p in enumerate(at)}
    f = lambda *ps: [n[p] for p in ps]
    faces = [f((2, 0, 0), (2, 2, 0), (2, 2, 2), (2, 0, 2))]  # between the cells, out of the first
    faces += [f((x, 0, 0), (x, 2, 0), (x + 2, 2, 0), (x + 2, 0, 0)) for x in (0, 2)]  # floor
    faces += [f((x, 0, 2), (x + 2, 0, 2), (x + 2, 2, 2), (x, 2, 2)) for x in (0, 2)]  # roof
    faces += [f((x, 0, 0), (x + 2, 0, 0), (x + 2, 0, 2), (x, 0, 2)) for x in (0, 2)] + [f((x, 2, 0), (x, 2, 2), (x + 2, 2, 2), (x + 2, 2, 0)) for x in (0, 2)]
    faces += [f((0, 0, 0), (0, 0, 2), (0, 2, 2), (0, 2, 0)), f((4, 0, 0), (4, 2, 0), (4, 2, 2), (4, 0, 2))]
    owner = [0, 0, 1, 0, 1, 0, 1, 0, 1, 0, 1]
    write = lambda p, c, body: p.write_text(HEAD % c + body)
    write(m / "points", "vectorField", f"{len(at)}\n(\n" + "\n".join("(%g %g %g)" % p for p in at) + "\n)\n")
    write(m / "faces", "faceList", f"{len(faces)}\n(\n" + "\n".join("4(%d %d %d %d)" % tuple(x) for x in faces) + "\n)\n")
    write(m / "owner", "labelList", f"{len(owner)}\n(\n" + "\n".join(map(str, owner)) + "\n)\n")
    write(m / "neighbour", "labelList", "1\n(\n1\n)\n")
    write(m / "boundary", "polyBoundaryMesh", "3\n(\n ground { type wall; nFaces 2; startFace 1; }\n roof { type wall; nFaces 2; startFace 3; }\n sides { type patch; nFaces 6; startFace 5; }\n)\n")
    for time, scale in (("0", 1), ("250", 3)):
        t = root / "box" / time
        t.mkdir()
        write(t / "U", "volVectorField", f"internalField nonuniform List<vector>\n2\n(\n({scale} 0 0)\n(0 {scale} 0)\n)\n;\nboundaryField {{}}\n")
        write(t / "p", "volScalarField", f"internalField uniform {scale};\n")
        write(t / "C", "volVectorField", "internalField uniform (0 0 0);\n")
    (root / "box" / "system").mkdir()
    (root / "box" / "system" / "controlDict").write_text("x")
    (root / "box" / "processor0" / "500").mkdir(parents=True)
    (root / "box" / "processor0" / "500" / "U").write_text("x")
    return str(root)


def test_mesh_patches_and_fields_become_points(spark, folder):
    tables = {n: polymesh.read(spark, folder, n) for n in ("points", "faces", "owner", "neighbour", "boundary")}
    params = spark.createDataFrame([("box", 3.0, None, 1.0)], "case_id string, u_ref double, l_ref double, p_ref double")
    out, frame = cases.case_points(tables, params, polymesh.read_fields(spark, folder + "/box/[0-9]*", ["U", "p"]).withColumn("case_id", F.lit("box")))
    f = frame.first()
    # Nothing looks up but the ground, which does not count, so plain areas weigh the roof: height 2 above the ground.
    assert (f.ox, f.oy, f.oz, f.l_ref, f.has_ground) == (2.0, 1.0, 0.0, 2.0, True)
    a, b = out.orderBy("point_id").collect()
    assert (a.x, a.y, a.z, b.x) == (-0.5, 0.0, 0.5, 0.5)
    assert (a.wall_dist, abs(a.nz), a.cell_size) == (0.5, 1.0, pytest.approx(1.0))
    assert (a.ux, a.uy, b.ux, b.uy, a.cp, b.cp) == (1.0, 0.0, 0.0, 1.0, 2 * 2 / 9, 2 * 2 / 9) and a.k is None
    assert cases.case_points(tables, params)[0].where("ux is null and cp is null").count() == 2


def test_fields_of_other_forms_are_refused():
    with pytest.raises(polymesh.MeshError):
        polymesh.internal_field((HEAD % "x" + "internalField nonuniform List<tensor>\n1\n(\n(1 2)\n)\n;").encode())
    with pytest.raises(polymesh.MeshError):
        polymesh.internal_field((HEAD % "x" + "boundaryField {}").encode())


def test_files_of_a_case(spark, folder):
    files = text.case_files(spark, folder)
    assert {(r.part, r.folder) for r in text.time_folders(files).collect()} == {(None, "250"), ("processor0", "500")}
    assert [(r.case_id, r.folder, r.time) for r in text.latest_time(files).collect()] == [("box", "250", 250.0)]
    names = {r.entry for r in text.case_entries(files).collect()}
    assert {"0/U", "0/p", "system/controlDict", "constant/polyMesh/owner"} <= names and not {"0/C", "250/U"} & names


def test_voxel_archives(spark, tmp_path):
    rng = np.random.default_rng(0)
    given, target, mask = rng.normal(size=(11, 2, 3, 4)).astype(np.float32), rng.normal(size=(6, 2, 3, 4)).astype(np.float32), rng.random((1, 2, 3, 4)) > 0.3
    buf = io.BytesIO()
    np.savez(buf, inp=given, tgt=target, mask=mask, order=np.arange(2), info=json.dumps({"case": "c7", "Lz": 2.0}))
    (tmp_path / "a.npz").write_bytes(buf.getvalue())
    got = npz.read_voxels(spark, str(tmp_path)).collect()
    assert len(got) == 24 and {r.case_id for r in got} == {"c7"}
    assert all((r.fluid, r.t4, r.i2, r.turbulence) == (bool(mask[0][at]), target[4][at], given[2][at], given[10][at]) for r in got for at in [(r.ix, r.iy, r.iz)])


def test_voxel_normals_point_away_from_the_nearest_solid(spark):
    v = spark.createDataFrame([(1, x, 0, z, not (x == 0 and z < 3)) for x in range(4) for z in range(4)], "case_id int, ix int, iy int, iz int, fluid boolean")
    got = {(r.ix, r.iz): r for r in etl.voxels_to_points(v, ["case_id"], 1.0, 1.0, normals=True).collect()}
    assert (got[1, 2].nx, got[1, 2].nz, got[1, 2].wall_dist) == (1.0, 0.0, 0.5)
    assert (got[3, 0].nx, got[3, 0].nz, got[3, 0].wall_dist) == (0.0, 1.0, 0.5)
    assert (got[0, 3].nx, got[0, 3].nz) == (0.0, 1.0) and got[1, 3].nx == pytest.approx(math.sqrt(0.5))


def test_targets_are_stripped_and_padding_is_checked(spark):
    p = spark.createDataFrame([(1, 0, 1.0, 2.0, 0.5)], "case_id int, point_id int, ux double, k double, p_ux double")
    points, meta = batches.strip_targets(p, spark.createDataFrame([(1, [True] * 4)], "case_id int, presence array<boolean>"))
    assert points.first().ux is None and points.first().p_ux == 0.5 and meta.first().presence == [False] * 4
    rows = spark.createDataFrame([(1, 0, 7), (1, 1, 8), (2, 0, 9)], "case_id int, slot int, v int")
    assert sorted(map(tuple, batches.pad(rows, ["case_id"], "slot", 2, {"v": -1}).select("case_id", "slot", "v", "valid").collect())) == [(1, 0, 7, True), (1, 1, 8, True), (2, 0, 9, True), (2, 1, -1, False)]
    with pytest.raises(Exception, match="beyond 1"):
        batches.pad(rows, ["case_id"], "slot", 1, {"v": -1}).collect()


def test_wake_points_are_asked_but_never_shown(spark):
    from .test_operators import cube

    p = cube(spark, 90, 2)
    wake = p.where("point_id % 10 = 3").select("case_id", "point_id")
    spec = samples.SampleSpec(n_context=30, n_tokens=(4, 2), k=3, n_query=80, modes=("near_wall", "wake"), mode_probabilities=(0.5, 0.5))
    s = samples.sample(p, spec, 5, wake=wake)
    assert s["context"].join(wake, ["case_id", "point_id"], "left_semi").count() == 0
    assert s["queries"].count() == 160 and s["queries"].join(wake, ["case_id", "point_id"], "left_semi").select("case_id", "point_id").distinct().count() == 18


@pytest.mark.parametrize("size", [40, 8 << 20])
def test_the_data_source_gives_the_same_case(spark, folder, size):
    tables = {n: foam.read(spark, folder, n, size=size) for n in ("points", "faces", "owner", "neighbour")} | {"boundary": polymesh.read(spark, folder, "boundary")}
    params = spark.createDataFrame([("box", 3.0, None, 1.0)], "case_id string, u_ref double, l_ref double, p_ref double")
    out, frame = cases.case_points(tables, params, foam.read(spark, folder, "field", "U,p", size, "box/[0-9]*"))
    f, (a, b) = frame.first(), out.orderBy("point_id").collect()
    assert (f.ox, f.oy, f.oz, f.l_ref, f.has_ground) == (2.0, 1.0, 0.0, 2.0, True)
    assert (a.x, a.y, a.z, b.x, a.wall_dist, a.ux, b.uy, a.cp) == (-0.5, 0.0, 0.5, 0.5, 0.5, 1.0, 1.0, 2 * 2 / 9) and a.k is None

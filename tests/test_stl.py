import struct

import pytest

from meshloom.sources import stl

#: Two right triangles, one facing up and one facing along x, and one without area.
FACES = [(0, 0, 0, 1, 0, 0, 0, 1, 0), (2, 0, 0, 2, 3, 0, 2, 0, 3), (1, 1, 1, 1, 1, 1, 1, 1, 1)]


def binary(faces):
    return b"solid but binary".ljust(80) + struct.pack("<I", len(faces)) + b"".join(struct.pack("<12fH", 0, 0, 0, *f, 0) for f in faces)


def ascii_text(faces):
    loops = ("facet normal 0 0 0\nouter loop\n" + "".join(f"vertex {f[k]} {f[k + 1]}e0 {f[k + 2]}\n" for k in (0, 3, 6)) + "endloop\nendfacet\n" for f in faces)
    return ("solid s\n" + "".join(loops) + "endsolid s\n").encode()


@pytest.mark.parametrize("write", [binary, ascii_text])
def test_samples(spark, tmp_path, write):
    (tmp_path / "a.stl").write_bytes(write(FACES))
    (tmp_path / "empty.stl").write_bytes(write([]))
    (tmp_path / "other.txt").write_bytes(b"no surface")
    rows = stl.surface_samples(stl.read(spark, str(tmp_path))).orderBy("face_id").collect()
    assert [r["face_id"] for r in rows] == [0, 1, 2]
    up, along, point = rows
    assert (up["cx"], up["cy"], up["cz"], up["area"]) == pytest.approx((1 / 3, 1 / 3, 0, 0.5))
    assert (up["nx"], up["ny"], up["nz"]) == (0, 0, 1)
    assert (along["nx"], along["ny"], along["nz"], along["area"]) == (1, 0, 0, 4.5)
    assert (point["area"], point["nx"], point["ny"], point["nz"]) == (0, None, None, None)


def test_broken_files():
    with pytest.raises(stl.SurfaceError):
        stl.triangles(binary(FACES)[:-1].replace(b"solid", b"other"))
    with pytest.raises(stl.SurfaceError):
        stl.triangles(ascii_text(FACES).replace(b"vertex", b"corner", 1))

import gzip
import hashlib
import io
import json
import tarfile

import pytest
import zstandard

from tessera.operators import layers as flat
from tessera.sources import images


def tar_of(*members) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        for name, kind, value in members:
            info = tarfile.TarInfo(name)
            info.type = {"file": tarfile.REGTYPE, "dir": tarfile.DIRTYPE, "symlink": tarfile.SYMTYPE}[kind]
            if kind == "symlink":
                info.linkname = value
            body = value if kind == "file" else b""
            info.size = len(body)
            tar.addfile(info, io.BytesIO(body))
    return out.getvalue()


def write(folder, layers, platform=None, drop=None):
    blobs = folder / "blobs" / "sha256"
    blobs.mkdir(parents=True)

    def put(data: bytes) -> str:
        name = hashlib.sha256(data).hexdigest()
        (blobs / name).write_bytes(data)
        return f"sha256:{name}"

    listed = [{"mediaType": kind, "digest": put(data), "size": len(data)} for kind, data in layers]
    if drop is not None:
        (blobs / listed[drop]["digest"][7:]).unlink()
    manifest = put(json.dumps({"layers": listed}).encode())
    other = put(json.dumps({"layers": []}).encode())
    (folder / "index.json").write_text(json.dumps({"manifests": [{"digest": other, "platform": {"os": "linux", "architecture": "arm64"}}, {"digest": manifest, "platform": platform or {"os": "linux", "architecture": "amd64"}}]}))


OCI = "application/vnd.oci.image.layer.v1.tar"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    low = tar_of(("a", "dir", None), ("a/x", "file", b"old"), ("a/y", "file", b"keep"), ("z", "symlink", "a/y"))
    high = tar_of(("a/x", "file", b"new"), ("a/.wh.y", "file", b""))
    write(root / "one", [(OCI, low), (OCI + "+gzip", gzip.compress(high[:700]) + gzip.compress(high[700:])), (OCI + "+zstd", zstandard.compress(tar_of(("b", "file", b"\xff\x00"))))])
    write(root / "cut", [(OCI, low), (OCI + "+gzip", gzip.compress(low)[:-40])])
    write(root / "odd", [("application/x-other", low)])
    write(root / "gone", [(OCI, low), (OCI, high)], drop=1)
    write(root / "many", [(OCI, tar_of((f"f{i}", "file", b"1"))) for i in range(257)])
    (root / "bare").mkdir()
    (root / "bare" / "index.json").write_text("{}")
    return str(root)


def test_entries_of_images(spark, folder):
    rows = images.entries(spark, folder).collect()
    one = {(r.layer_no, r.entry_no): (r.path, r.entry_type, r.link_target, r.body and bytes(r.body)) for r in rows if r.image == "one"}
    assert one[0, 1] == ("a/x", "file", None, b"old") and one[0, 3] == ("z", "symlink", "a/y", None) and one[1, 1] == ("a/.wh.y", "file", None, b"") and one[2, 0][3] == b"\xff\x00" and len(one) == 7
    errors = {r.image: r.error for r in rows if r.error}
    assert errors["odd"] == "layer of an unknown type" and errors["gone"] == "missing blob" and errors["many"] == "too many layers: 257" and errors["bare"] == "no manifest" and "EOFError" in errors["cut"]
    assert sum(r.image == "cut" and r.error is None for r in rows) >= 4


def test_whole_images_flatten(spark, folder):
    whole = images.whole_images(images.entries(spark, folder))
    assert {r.image for r in whole.select("image").distinct().collect()} == {"one"}
    got = {r.path: r.body and bytes(r.body) for r in flat.flatten(whole).collect()}
    assert got == {"a": None, "a/x": b"new", "z": None, "b": b"\xff\x00"}
    assert images.whole_images(images.entries(spark, folder), max_bytes=9).count() == 0
    assert images.whole_images(images.entries(spark, folder), max_layers=2).count() == 0


def test_a_layer_that_unpacks_to_too_much(spark, tmp_path):
    write(tmp_path / "bomb", [(OCI + "+gzip", gzip.compress(tar_of(("zeros", "file", bytes(5 << 20)))))])
    rows = images.entries(spark, str(tmp_path), cap=1 << 20).collect()
    assert [r.error for r in rows] == ["OverflowError: layer exceeds the export size cap"]

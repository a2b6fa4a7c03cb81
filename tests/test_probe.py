import io
import tarfile

import pytest

from tessera.operators import archive, probe, ranking


def test_probe(spark):
    cases = {"pkg:npm/%40s/n": "https://registry.npmjs.org/@s/n", "pkg:golang/a.b/C@v1": "https://proxy.golang.org/a.b/!c/@v/v1.info", "pkg:golang/a.b/C": "https://proxy.golang.org/a.b/!c/@latest", "pkg:docker/nginx": "https://hub.docker.com/v2/repositories/library/nginx",
             "pkg:oci/b?repository_url=quay.io%2Fa%2Fb": "https://quay.io/api/v1/repository/a/b", "pkg:oci/b?repository_url=ghcr.io%2Fa%2Fb": None, "pkg:oci/quay.io/a/b": "https://hub.docker.com/v2/repositories/library/b",
             "pkg:nuget/New.Json": "https://azuresearch-usnc.nuget.org/query?q=packageid:new.json&prerelease=true&semVerLevel=2.0.0", "pkg:snap/s": "https://api.snapcraft.io/v2/snaps/info/s?fields=title,summary,description,license,publisher,store-url,website,version", "pkg:alpm/arch/vim": "https://archlinux.org/packages/search/json/?name=vim", "pkg:deb/debian/curl": "https://deb.debian.org/debian/dists/stable/main/binary-amd64/Packages.gz",
             "pkg:jsr/%40std/fs": "https://api.jsr.io/scopes/std/packages/fs", "pkg:cargo/../x": None, "pkg:unknown/x": None, "junk": None}
    got = {r.purl: r for r in probe.probe(spark.createDataFrame([(k,) for k in cases], "purl string")).collect()}
    assert {k: r.registry_url for k, r in got.items()} == cases
    assert got["junk"].normalized is None and got["junk"].path == ""


def test_first_repository_and_pages(spark):
    hits = spark.createDataFrame([("a", 1, "community"), ("a", 0, "main"), ("b", 1, "community")], "name string, repo_rank int, repo string")
    assert {(r.name, r.repo) for r in ranking.first_repository(hits, ["name"]).collect()} == {("a", "main"), ("b", "community")}
    items = spark.createDataFrame([("k", 0, "p0", [1, 2]), ("k", 1, "p1", None), ("k", 2, "p2", None)], "key string, pos int, page_id string, inline array<int>")
    pages = spark.createDataFrame([("p1", [3])], "page_id string, fetched array<int>")
    assert sorted(r.entry for r in probe.paged(items, pages).collect()) == [1, 2, 3]


def test_archive(spark):
    df = spark.createDataFrame([("i", "b", "file", None, "x"), ("i", "a", "symlink", "b", None)], "image string, path string, entry_type string, link_target string, body string")
    row = archive.archives(df).first()
    with tarfile.open(fileobj=io.BytesIO(bytes(row.archive)), mode="r:xz") as tar:
        assert tar.getnames() == ["a", "b"] and tar.extractfile("b").read() == b"x"
    with pytest.raises(OverflowError):
        archive.build([("a", "file", None, "x" * 5000)], cap=1000)


def test_batch_probe_keeps_the_order_of_lines(spark, tmp_path):
    import json

    from tessera.sources import readers

    lines = [f"pkg:npm/p{i}@1" if i % 3 else "junk" for i in range(50)]
    (tmp_path / "in.txt").write_text("\n".join(lines))
    report = probe.probe(readers.numbered_lines(spark, str(tmp_path / "in.txt")), "line")
    readers.write_json_lines(report.select("place", "line", "type", "registry_url"), str(tmp_path / "out"))
    found = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert [r["line"] for r in found] == lines and found[0]["type"] is None and found[1]["registry_url"] == "https://registry.npmjs.org/p1"

import gzip
import hashlib
import io
import json
import lzma
import tarfile

import zstandard

from tessera.functions import scalars as S
from tessera.functions.udfs import gunzip_one, tar_member_one, unxz_one, unzstd_one
from tessera.operators import fetching, layers, registry, resolve, sweep
from tessera.plans import catalogue
from tessera.sources import fixtures, readers

NOW = 10**9


def test_fetch_outcomes(spark):
    good, pin = b"body", hashlib.sha256(b"body").hexdigest()
    refs = [("src", 0, "purl", "pkg:a/fresh", "u0", "command", True, None, None), ("src", 1, "purl", "pkg:a/net", "u1", "command", True, "sha256", pin.upper()), ("src", 2, "purl", "pkg:a/bad", "u2", "command", True, "sha256", "00"),
            ("src", 3, "purl", "pkg:a/stale", "u3", "command", True, None, None), ("src", 4, "purl", "pkg:a/none", None, "command", True, None, None), ("src", 5, "purl", "pkg:a/fail", "u5", "command", True, None, None),
            ("src", 6, "url", "http://x", "u6", "url_fetch", True, None, None), ("src", 7, "path", "./x", None, "command", True, None, None), ("src", 8, "purl", "pkg:a/late", "u8", "command", True, None, None)]
    refs = spark.createDataFrame(refs, "source_sha256 string, seq int, locator_type string, locator string, resolved_url string, kind string, is_target boolean, pin_algo string, pin_value string")
    key = lambda s: hashlib.sha256(s.encode()).hexdigest()
    cache = spark.createDataFrame([(key("pkg:a/fresh"), NOW - 60, good), (key("pkg:a/stale"), NOW - 10**6, good)], "key string, fetched_at long, content binary")
    answers = spark.createDataFrame([("u1", 200, good, None), ("u2", 200, good, None), ("u3", 500, None, "status: 500"), ("u8", 200, good, None)], "url string, status int, content binary, error string")
    got = {r.seq: r for r in fetching.fetch(refs, cache, answers, NOW, max_count=4).collect()}
    assert {k: r.outcome for k, r in got.items()} == {0: "ok", 1: "ok", 2: "pin_mismatch", 3: "ok", 4: "unresolved", 5: "failed", 8: "budget_exceeded"}
    assert got[0].cached and not got[0].stale and got[3].stale and got[1].pin_verified and got[1].content_sha256 == pin
    none = fetching.fetch(refs, cache, answers, NOW, max_bytes=0).collect()
    assert {r.outcome for r in none} == {"budget_exceeded"} and all(r.resolved_url is None for r in none)


def test_documents_and_lifetimes(spark):
    asked = spark.createDataFrame([("a", "pinned"), ("a", "pinned"), ("b", "unpinned"), ("c", "immutable")], "url string, tier string")
    key = lambda u: hashlib.sha256(f"meta:{u}".encode()).hexdigest()
    cache = spark.createDataFrame([(key("a"), NOW - 80 * 86400, b"A"), (key("b"), NOW - 7200, b"B"), (key("c"), 0, b"C")], "key string, fetched_at long, content binary")
    answers = spark.createDataFrame([("b", 200, None, "timeout")], "url string, status int, content binary, error string")
    got = {r.url: (bytes(r.content), r.served) for r in fetching.documents(asked, cache, answers, NOW).collect()}
    assert got == {"a": (b"A", "cache"), "b": (b"B", "stale"), "c": (b"C", "cache")}


def test_records_with_their_sources(spark):
    asked = spark.createDataFrame([(1, "p", None, ["a", "b", "a"]), (2, "q", None, ["gone", "b"]), (3, "r", None, [None]), (4, "s", None, [])], "k int, name string, version string, urls array<string>")
    body = b'{"id": "o/m", "sha": "x"}'
    cache = spark.createDataFrame([], "key string, fetched_at long, content binary")
    answers = spark.createDataFrame([("a", 200, "application/json", body, None), ("b", 203, None, b"{}", None), ("gone", 404, None, None, "status: 404")], "url string, status int, content_type string, content binary, error string")
    served = fetching.documents(spark.createDataFrame([(u, "pinned") for u in ("a", "b", "gone")], "url string, tier string"), cache, answers, NOW)
    records, sources = registry.with_sources(asked, served, "huggingface", ("k",))
    assert [(r.k, r.name, r.version) for r in records.collect()] == [(1, "o/m", "x")]
    assert {(r.k, r.pos, r.url, r.status, r.content_type, bytes(r.content)) for r in sources.collect()} == {
        (1, 0, "a", 200, "application/json", body), (1, 1, "b", 203, None, b"{}"), (1, 2, "a", 200, "application/json", body), (2, 1, "b", 203, None, b"{}")}


def test_layers(spark):
    rows = [("i", 0, 0, "/a/x"), ("i", 0, 1, "a/y"), ("i", 0, 2, "b/c/d"), ("i", 0, 3, "/"), ("i", 1, 0, "a/.wh.x"), ("i", 1, 1, "./a/y"), ("i", 2, 0, "b/.wh.c"), ("i", 2, 1, "e/.wh..wh..opq"), ("i", 2, 2, "e/n"), ("i", 1, 2, "e/o"), ("i", 2, 3, "../../f")]
    df = spark.createDataFrame(rows, "image string, layer_no int, entry_no int, path string")
    assert {(r.path, r.layer_no) for r in layers.flatten(df).collect()} == {("a/y", 1), ("e/n", 2), ("f", 2)}


def test_sweep(spark):
    rows = [("c", f"p{k}", NOW - (400 - k) * 10, 400) for k in range(5)] + [("c", "old", NOW - 40 * 86400, 10**6)]
    df = spark.createDataFrame(rows, "component string, path string, modified long, bytes long")
    got = {r.path: r.evicted_by for r in sweep.evict(df, NOW, max_bytes=1000).collect()}
    assert got == {"old": "age", "p0": "size", "p1": "size", "p2": "size", "p3": None, "p4": None}
    assert sweep.due(None, 5) and not sweep.due(NOW, NOW + 5) and sweep.due(NOW - 90000, NOW)


def test_codecs_and_tar():
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        info = tarfile.TarInfo("d/APKINDEX")
        info.size = 3
        tar.addfile(info, io.BytesIO(b"abc"))
    assert tar_member_one(b"\0" * 1024 + buffer.getvalue(), "APKINDEX", 10) == b"abc" and tar_member_one(buffer.getvalue(), "INDEX", 10) is None
    assert gunzip_one(gzip.compress(b"a") + gzip.compress(b"b"), 9) == b"ab" and gunzip_one(b"plain", 9) == b"plain" and gunzip_one(gzip.compress(b"a" * 99), 9) is None
    assert unxz_one(lzma.compress(b"x"), 9) == b"x" and unxz_one(b"bad", 9) is None and unzstd_one(zstandard.compress(b"x" * 5), 9) == b"x" * 5


def test_resolution_with_documents(spark):
    refs = [("purl", "pkg:npm/left-pad"), ("purl", "pkg:pypi/x@1"), ("purl", "pkg:pypi/x@1?kind=sdist"), ("purl", "pkg:composer/a/b@1.0"), ("purl", "pkg:firefox/ub"), ("purl", "pkg:aur/yay"), ("purl", "pkg:vscode/p/n@1"), ("url", "HTTPS://x"), ("url", "oci://x"), ("path", "x"), ("purl", "pkg:maven/org.a/b@1?type=a%2Fb")]
    docs = [("https://registry.npmjs.org/left-pad", json.dumps({"dist-tags": {"latest": "1.3"}})), ("https://pypi.org/pypi/x/1/json", json.dumps({"urls": [{"url": "s", "packagetype": "sdist", "filename": "x.tar.gz"}, {"url": "l", "packagetype": "bdist_wheel", "filename": "x-cp3-linux.whl"}, {"url": "w", "packagetype": "bdist_wheel", "filename": "x-py3-none-any.whl"}]})),
            ("https://repo.packagist.org/p2/a/b.json", json.dumps({"packages": {"a/b": [{"version": "v1.0", "dist": {"url": "z"}}]}})), ("https://addons.mozilla.org/api/v5/addons/addon/ub/", json.dumps({"current_version": {"version": "2", "file": {"url": "f"}}}))]
    out = resolve.resolve_with_documents(spark.createDataFrame(refs, "locator_type string, locator string"), spark.createDataFrame(docs, "url string, body string"))
    got = {r.locator: (r.resolved_locator, r.resolved_url) for r in out.collect()}
    assert got["pkg:npm/left-pad"] == ("pkg:npm/left-pad@1.3", "https://registry.npmjs.org/left-pad/-/left-pad-1.3.tgz")
    assert (got["pkg:pypi/x@1"][1], got["pkg:pypi/x@1?kind=sdist"][1], got["pkg:composer/a/b@1.0"][1]) == ("w", "s", "z")
    assert got["pkg:firefox/ub"] == ("pkg:firefox/ub@2", "f") and got["pkg:aur/yay"][1] == "https://aur.archlinux.org/cgit/aur.git/snapshot/yay.tar.gz"
    assert got["HTTPS://x"][1] == "HTTPS://x" and got["oci://x"][1] is None and got["x"][1] is None and got["pkg:maven/org.a/b@1?type=a%2Fb"][1] is None


def test_timestamps(spark):
    cases = [("2024-01-01T00:00:00Z", 1704067200), ("2024-01-01 00:00:00.123+01:00", 1704063600), ("1970-01-01T00:00:00", 0), ("2024-13-01T00:00:00Z", 1735689600), ("garbage", None), ("2024-01-01", None), ("1969-12-31T23:59:59Z", None), ("2024-01-01T00:00:00ZZ", 1704067200), ("2024-01-01T00:00:00+01", 1704063600), ("2024-01-01T00:00:00-0130x", 1704072600), ("2024-01-01T00:00:00+1", None), ("2024-01-01T00:00:00 UTC", None)]
    df = spark.createDataFrame(cases, "raw string, want long")
    assert [(r.raw, r.got) for r in df.select("raw", S.rfc3339_seconds("raw").alias("got")).collect()] == cases


def test_sources(spark, tmp_path):
    (tmp_path / "Dockerfile").write_text("FROM x")
    (tmp_path / "run").write_text("#!/bin/bash\nls")
    assert {r.file_type for r in readers.files(spark, str(tmp_path)).collect()} == {"dockerfile", "shell"}
    index = tmp_path / "index.txt"
    index.write_text("P:a\nV:1\n\nP:b\nV:2\n")
    assert [r.stanza for r in readers.stanzas(spark, str(index)).collect()] == ["P:a\nV:1", "P:b\nV:2"]
    df = spark.createDataFrame([(1, '<m><package a="1">x</package>\n<package>y</package></m>', '{"a":1}\nbad', "drwx 1 a/b-1.tgz c-2.tgz")], "k int, x string, j string, l string")
    assert readers.split_elements(df, "x").count() == 2 and readers.json_lines(df, "j").count() == 1 and readers.listing(df, "l").count() == 4
    asked, answers = spark.createDataFrame([("u",), ("v",)], "url string"), spark.createDataFrame([("u", 200, "t", b"x")], "url string, status int, content_type string, content binary")
    assert {r.url: r.error for r in fixtures.canned(asked, answers).collect()} == {"u": None, "v": "transport: no fixture"}
    assert fixtures.refused("http://x") and fixtures.refused("https://127.0.0.1/") and fixtures.refused("https://[::1]/")
    records = spark.createDataFrame([(1, "n")], "k int, name string")
    sources = spark.createDataFrame([(1, 1, "b", 200, "t", b"\xff"), (1, 0, "a", 200, "t", b'{"x":1}')], "k int, seq int, url string, status int, content_type string, content binary")
    out = json.loads(readers.envelopes(records, sources.withColumn("content", sources.content.cast("string")), "k").first().json)
    assert out["record"] == {"name": "n"} and out["sources"][0]["body"] == {"x": 1} and "body_b64" in out["sources"][1]


def test_flagship(spark):
    assert catalogue.flagship(spark, "/root/testdata/sf0.001").count() > 0


def test_html_meta_searches_whole_pages(spark, tmp_path):
    late = "x" * 1000 + "<b>Updated</b><i> May 5, 2023</i> 7 users" + "y" * 1000
    spark.createDataFrame([(1, late), (2, "z" * 70000)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert catalogue.whole_pages(spark, str(tmp_path)).where("k = 2").selectExpr("length(html) > 70000 AS whole").first().whole
    got = {r.k: (r.title, r.updated, r.users) for r in catalogue.QUERIES["html_meta"](spark, str(tmp_path)).collect()}
    assert got == {1: ("Page 1", 1683244800, 7), 2: ("Page 2", 1709424000, 1102)}


def test_flagship_reads_its_files_once(spark):
    plan = catalogue.flagship(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 1  # references are made once, not again to look for dependencies among them


def test_dependencies_told_apart(spark):
    from tessera.operators import recognize

    refs = spark.createDataFrame([(1, "purl", "pkg:npm/a@1", "command"), (1, "purl", "pkg:npm/b@1", "command"), (2, "purl", "pkg:npm/a@1", "command"), (1, "url", "pkg:npm/c", "command")], "package_id int, locator_type string, locator string, kind string")
    declared = spark.createDataFrame([(1, "purl", "pkg:npm/a@2", "dependency"), (1, "purl", "pkg:npm/b@1", "other")], refs.schema)
    got = recognize.undeclared_packages(refs, declared=declared)
    assert sorted((r.package_id, r.locator) for r in got.collect()) == [(1, "pkg:npm/b@1"), (2, "pkg:npm/a@1")]
    assert sorted(got.collect()) == sorted(recognize.undeclared_packages(refs.unionByName(declared)).collect())

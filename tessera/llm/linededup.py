"""Line dedup by digests of line windows, in DataFrame functions only.

Lines are hashed, and every window of ``run`` consecutive lines gets a digest. No window is left out, as
winnowing would: a run may be no longer than one window, so each holds a minimum that counts. Windows
meet under (smallest line hash, digest): each joins the *first* position of its window and nothing else,
so a line that occurs in every document costs one row a window and never a pair of occurrences. Windows
that follow one another merge into runs, and all runs but the first occurrence are deleted. Where
``words`` is given, a line of so many words is a window by itself beside the others, whatever its
neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = 2
LONG = 50  # words of a line that counts as a run by itself, where asked for


def _windows(docs: DataFrame, id_col: str, text_col: str, run: int, words: int | None = None) -> DataFrame:
    """(doc, version, at, span, mark, body) for each window of ``span`` lines; a text with fewer lines is one window of its own length."""
    marks = F.transform(F.split(text_col, "\n"), lambda line: F.xxhash64(line))
    starts = F.sequence(F.lit(0), F.greatest(F.size("marks") - run, F.lit(0)))
    cut = lambda at: F.slice(F.col("marks"), at + 1, F.lit(run))
    window = F.transform(starts, lambda at: F.struct(at.alias("at"), F.lit(run).alias("span"), F.array_min(cut(at)).alias("mark"), F.xxhash64(F.lit(run), cut(at)).alias("body")))
    kept = [F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("version"), marks.alias("marks")]
    if words is not None:
        size = F.transform(F.split(text_col, "\n"), lambda line: F.when(F.length(line) >= 2 * words - 1, F.regexp_count(line, F.lit(r"\S+"))).otherwise(0))
        alone = F.filter(F.transform(size, lambda n, at: F.when(n >= words, at)), lambda at: at.isNotNull())
        kept.append(alone.alias("alone"))
        one = lambda at: F.struct(at.alias("at"), F.lit(1).alias("span"), F.get("marks", at).alias("mark"), F.xxhash64(F.lit(1), F.slice(F.col("marks"), at + 1, F.lit(1))).alias("body"))
        window = F.concat(window, F.transform("alone", one)) if run > 1 else window
    rows = docs.where(F.col(text_col).isNotNull()).select(*kept)
    return rows.select("doc", "version", F.inline(window))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc, version, ``cut`` line numbers to delete, ``n_runs`` maximal runs) for texts that hold any."""
    windows = _windows(docs, id_col, text_col, run, words)
    place = F.struct(F.col("doc").isNotNull().alias("known"), "doc", "version", "at")
    first = windows.groupBy("mark", "body").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").select("mark", "body", "first")
    later = windows.join(first, ["mark", "body"]).where(place != F.col("first"))
    starts = later.groupBy("doc", "version").agg(F.collect_set(F.struct("at", "span")).alias("starts"))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda w: F.sequence(w["at"], w["at"] + w["span"] - 1)))))
    cut = starts.select("doc", "version", lines.alias("cut"))
    before = F.concat(F.array(F.lit(-2)), F.slice("cut", F.lit(1), F.size("cut") - 1))
    joined = F.filter(F.arrays_zip(F.col("cut").alias("c"), before.alias("b")), lambda x: x["c"] > x["b"] + 1)
    return cut.select("doc", "version", "cut", F.size(joined).cast("long").alias("n_runs"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """Delete from each text the lines of every repeated run of ``run`` or more lines but its first.

    With ``words``, a repeated line of that many words or more is a run by itself. First means: smallest (id, xxhash64 of the text, line number), a null id before all others; what
    repeats is judged on the input, and the first occurrence keeps its lines. Adds ``lines_cut`` and
    ``runs_cut``; all rows and other columns stay (existing columns of those two names are replaced).
    A text shorter than ``run`` lines is compared as one run with texts of its own number of lines.
    Null texts stay null and count 0; an emptied text becomes ''; rows with equal id and text are one
    document and stay alike; rows with equal id and other text are different documents. No limit on
    the number of lines or copies; a text is held by one task, as in the input.
    """
    own = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))  # no column of the input begins with so many
    doc, version, lost, runs = (own + c for c in ("doc", "version", "cut", "n_runs"))
    found = repeated_runs(docs, id_col, text_col, run, words).withColumnsRenamed({c: own + c for c in ("doc", "version", "cut", "n_runs")})
    rest = docs.drop("lines_cut", "runs_cut")
    match = F.col(id_col).eqNullSafe(F.col(doc)) & (F.xxhash64(text_col) == F.col(version))
    lines = F.split(text_col, "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))
    text = F.when(F.col(lost).isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    count = F.coalesce(F.size(F.array_intersect(F.col(lost), F.sequence(F.lit(0), F.size(lines) - 1))), F.lit(0)).cast("long")
    new = {"lines_cut": F.when(F.col(lost).isNull(), F.lit(0).cast("long")).otherwise(count), "runs_cut": F.coalesce(runs, F.lit(0)).cast("long"), text_col: text}
    return rest.join(found, match, "left").withColumns(new).drop(doc, version, lost, runs)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of all documents: what is left of each text as digest, and what was cut."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = line_dedup(docs)
    return out.select("doc_id", "lines_cut", "runs_cut", F.length("text").cast("long").alias("n_chars_left"), F.sha2(F.col("text").cast("binary"), 256).alias("left_sha256"))


ORACLE_SQL = f"""
WITH lines AS (
  SELECT doc_id, row_id, text, string_split(text, chr(10)) AS ls
  FROM (SELECT doc_id, text, row_number() OVER () AS row_id FROM documents WHERE text IS NOT NULL)
), windows AS (
  SELECT doc_id, row_id, a.s AS s, array_to_string(list_slice(ls, a.s + 1, a.s + {RUN}), chr(10)) AS body
  FROM lines, LATERAL (SELECT unnest(range(0, greatest(len(ls) - {RUN}, 0) + 1)) AS s) a
), ranked AS (
  SELECT row_id, s, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS nth FROM windows
), cut AS (
  SELECT DISTINCT row_id, l.line AS line
  FROM ranked, LATERAL (SELECT unnest(range(s, s + {RUN})) AS line) l WHERE nth > 1
), runs AS (
  SELECT row_id, count(*) AS runs_cut FROM (
    SELECT row_id, s, lag(s) OVER (PARTITION BY row_id ORDER BY s) AS p FROM ranked WHERE nth > 1
  ) WHERE p IS NULL OR s > p + {RUN} GROUP BY row_id
), pieces AS (
  SELECT l.row_id, i.i AS i, l.ls[i.i + 1] AS line
  FROM lines l, LATERAL (SELECT unnest(range(0, len(l.ls))) AS i) i
), kept AS (
  SELECT p.row_id, string_agg(p.line, chr(10) ORDER BY p.i) FILTER (WHERE c.row_id IS NULL) AS text,
         count(*) FILTER (WHERE c.row_id IS NOT NULL) AS lines_cut
  FROM pieces p LEFT JOIN cut c ON c.row_id = p.row_id AND c.line = p.i GROUP BY p.row_id
)
SELECT l.doc_id, k.lines_cut AS lines_cut, coalesce(r.runs_cut, 0) AS runs_cut,
       CAST(length(coalesce(k.text, '')) AS BIGINT) AS n_chars_left, sha256(coalesce(k.text, '')) AS left_sha256
FROM lines l JOIN kept k USING (row_id) LEFT JOIN runs r USING (row_id)
UNION ALL
SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
"""

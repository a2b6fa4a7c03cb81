"""The corpus pipeline's stages against brute force on a small table."""

from collections import defaultdict

import pytest

import corpus_pipeline as P
from tessera.llm import linededup, setsketch
from tessera.llm.packing import Encoder

from .test_text_operators import brute_lines

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out, docs = {}, spark.read.parquet(f"{D}/documents.parquet")
    extra = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "12 34", "en", "s", 5), (10**9 + 2, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(extra)
    out["input"] = docs.collect()
    columns = docs.columns
    for k, (name, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / "t")
        df = stage(spark, docs, D)
        assert k == len(P.STAGES) - 1 or df.columns == columns
        df.write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = docs.collect()
    return out


def test_names():
    assert [n for n, _ in P.STAGES] == ["language ID", "line dedup", "near-dedup", "mixing", "packing"]


def test_language_stage_keeps_documents_with_words(stages):
    kept = {r.doc_id: r for r in stages["language ID"]}
    gone = {r.doc_id for r in stages["input"]} - set(kept)
    assert gone >= {10**9, 10**9 + 1, 10**9 + 2} and len(gone) <= 3 + len(stages["input"]) // 100


def test_line_stage(stages):
    before, after = stages["language ID"], {r.doc_id: r for r in stages["line dedup"]}
    want = brute_lines([(r.doc_id, r.text) for r in before], linededup.RUN)
    assert all(after[i].text == text and after[i].n_chars == len(text) for (i, _), text in want.items()) and len(after) == len(before)


def test_near_dup_stage(stages):
    before = stages["line dedup"]
    sets = {r.doc_id: set(setsketch.shingles(r.text).tolist()) for r in before}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in stages["near-dedup"]) == [i for i in ids if find(i) == i]


def test_mixing_keeps_all_rows(stages):
    assert sorted(map(tuple, stages["mixing"])) == sorted(map(tuple, stages["near-dedup"]))


def test_packing_stage(stages):
    encode, pieces = Encoder(), defaultdict(int)
    for r in stages["packing"]:
        pieces[r.doc_id] += r.length
    assert dict(pieces) == {r.doc_id: len(encode(r.text or "")) + 1 for r in stages["mixing"]}


def test_packed_sequences_follow_the_mixture(spark, tmp_path):
    rows = [(i, ("word " * 300 if i % 4 else "word " * 20) + str(i), "en", "b" if i % 4 else "a", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    P.mixing_stage(spark, docs, D).write.parquet(str(tmp_path / "mixed"))
    pieces = P.packing_stage(spark, spark.read.parquet(str(tmp_path / "mixed")), D).orderBy("sequence_id", "offset").collect()
    order = list(dict.fromkeys(r.doc_id for r in pieces))
    assert len(order) == len(rows)
    share, done, error = 1500**0.5 / (1500**0.5 + 4500**0.5), 0, 0
    for t, i in enumerate(order, 1):
        done += i % 4 == 0
        if done == 1500:
            break
        if t <= 3500:  # both sources last that long
            error = max(error, abs(done - t * share))
    print("largest deviation", error)
    assert error <= 8 + 256


def test_stages_on_empty_and_unlabelled_tables(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in P.STAGES:
        assert stage(spark, docs.limit(0), D).count() == 0
    rows = [(1, "some text", None, None, 0), (2, "12", None, None, 0), (None, None, None, None, None), (1, "some text", None, None, 0)]
    bare = spark.createDataFrame(rows, docs.schema)
    assert [r.doc_id for r in P.language_stage(spark, bare, D).collect()] == [1, 1]
    assert P.line_stage(spark, bare, D).count() == P.mixing_stage(spark, bare, D).count() == 4
    assert P.near_dup_stage(spark, bare, D).count() == 3 and P.packing_stage(spark, bare, D).count() == 4

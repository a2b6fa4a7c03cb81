"""Fingerprints, embedding, near-duplicate and byte-string dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm import fingerprint, pivots, rindex, setsketch
from tessera.llm.components import connected_components
from tessera.llm.workspace import Workspace

rng = np.random.default_rng(11)
WORDS = [f"w{i}" for i in range(400)]


def corpus():
    base = [" ".join(rng.choice(WORDS, 60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(12, 40):
        words = base[i % 3].split()
        words[int(rng.integers(60))] = f"new{i}"
        rows.append((i, " ".join(words)))
    shared = " ".join(rng.choice(WORDS, 15))
    rows += [(50, "Short text"), (51, "short TEXT"), (52, None), (53, ""), (54, " \n"), (55, base[0]), (55, base[0]), (56, f"{base[5]} {shared}"), (57, f"é {shared} ü {base[6]}"), (None, base[1]), (58, "ab" * 60), (59, "x" + "ab" * 60)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in corpus_rows], "doc_id long, text string, rep string")


corpus_rows = corpus()


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (200, 200), (5, 5)]
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df, Workspace(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(df.limit(0), Workspace(spark, "test")).count() == 0


@pytest.mark.parametrize("block", [setsketch.BLOCK, 12_000])  # the second deals groups into many blocks
def test_near_duplicates(spark, docs, block):
    rows = corpus_rows
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    sets = [set(setsketch.shingles(rows[k][1]).tolist()) for k in order]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = components(len(sets), links)
    want = sorted((str(rows[order[k]][0]), len(sets[k]), str(rows[order[root[k]]][0])) for k in range(len(sets)))
    got = setsketch.near_duplicates(docs, block=block).collect()
    assert sorted((str(r.doc), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.doc == r.component_id) for r in got if r.doc is not None)
    kept = setsketch.near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len({(w[0], w[2]) for w in want if w[0] == w[2]})
    assert setsketch.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_dealt_into_blocks(spark):
    """A chain of versions, in which only neighbours link, and unlinked relatives of it, in many blocks."""
    draw = np.random.default_rng(5)
    words, rows = [f"c{i}" for i in range(80)], []
    for i in range(60):
        words[int(draw.integers(80))] = f"n{i}"
        rows.append((i, " ".join(words)))
    for i in range(60, 90):
        other = rows[0][1].split()
        for k in draw.choice(80, 6, replace=False):
            other[k] = f"o{i}.{k}"
        rows.append((i, " ".join(other)))
    sets = [set(setsketch.shingles(t).tolist()) for _, t in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(len(sets), links)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (10_000, 40_000):
        got = {r.doc: r.component_id for r in setsketch.near_duplicates(df, block=block).collect()}
        assert [got[i] for i in range(len(rows))] == want


def test_sketch_estimates():
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for shared, ok in ((1000, True), (880, True), (400, False), (0, False)):
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])
        u, v = setsketch.registers(a), setsketch.registers(b)
        got = setsketch.plausible(np.array([1000]), np.array([1000]), np.array([(u > v).sum()]), np.array([(u < v).sum()]))[0]
        assert got == ok
        union = setsketch.registers(np.concatenate([a, b]))
        assert (union == np.maximum(u, v)).all()


def test_repeated_bytes(docs):
    rows = corpus_rows
    first, want = {}, []
    ordered = sorted(((rindex.LAST if i is None else i), (t or "").encode()) for i, t in rows)
    for d, b in ordered:
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], d)
    for d, b in ordered:
        mask = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < d:
                mask[k : k + 50] = True
        edges = np.diff(np.r_[0, mask.astype(int), 0])
        want.append((str(None if d == rindex.LAST else d), len(b), int(mask.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~mask].tobytes()).hexdigest()))
    got = rindex.repeated_bytes(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert rindex.repeated_bytes(docs.limit(0)).count() == 0


def test_repeated_bytes_in_self_repeating_document(spark):
    draw = np.random.default_rng(23)
    fresh = lambda n: "".join(draw.choice(list("abcdefghijklmnop"), n))
    part = fresh(60)
    block = fresh(80) + part + fresh(80)
    twice = fresh(90) + block + fresh(70) + block + fresh(50)
    rows = [(3, fresh(100) + part + fresh(100)), (5, twice), (5, fresh(40) + block + fresh(30)), (9, fresh(20) + block), (None, block + fresh(10) + block), (None, fresh(30) + block)]
    want = []
    for d, t in rows:
        small = {t[k : k + 50] for i, t in rows for k in range(len(t) - 49) if i is not None and (d is None or i < d)}
        mask = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if t[k : k + 50] in small:
                mask[k : k + 50] = True
        want.append((str(d), len(t), int(mask.sum()), hashlib.sha256(np.frombuffer(t.encode(), np.uint8)[~mask].tobytes()).hexdigest()))
    assert want[1][2] >= 120
    got = rindex.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


def test_run_index_counts():
    text = np.frombuffer(b"banana\0ananas\0", np.uint8)
    index = rindex.RunIndex(text, 16)
    lo, hi = np.array([0]), np.array([len(text)])
    for c in b"ana"[::-1]:
        lo, hi = index.step(np.array([c]), lo, hi)
    assert hi[0] - lo[0] == 4
    assert [x.tolist() for x in rindex.earlier_matches([b"ab" * 30, b"ab" * 29 + b"c", b"ab" * 30], np.array([2, 1, 3]))] == [list(range(11)), [], list(range(11))]
    assert [x.tolist() for x in rindex.earlier_matches([b"xxabcdeyy", b"zabcdez"], np.array([2, 1]), 5)] == [[2], []]


def plain_pieces(text):
    """Cuts as stated, byte by byte: after a line end, and after eight bytes whose product has six high zero bits."""
    raw, out, at = text.encode(), [], 0
    for k in range(1, len(raw)):
        word = int.from_bytes(raw[k - 8 : k], "little") if k >= 8 else 1
        if raw[k - 1] == 10 or k >= 8 and (word * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 58 == 0:
            out.append(raw[at:k])
            at = k
    return [*out, raw[at:]] if raw else out


def test_pieces_and_likeness():
    draw = np.random.default_rng(3)
    text = "\n".join(" ".join(draw.choice(WORDS, 80)) for _ in range(12))
    assert fingerprint.pieces(text) == plain_pieces(text) and b"".join(fingerprint.pieces(text)) == text.encode()
    moved = text[:40] + "one more " + text[40:]
    sets = [fingerprint.digests(t) for t in (text, moved, "", text[: len(text) // 2])]
    got = fingerprint.likeness([sets[0]] * 4, sets)
    assert got[0] == 1 and got[1] > 0.9 and got[2] == 0 and 0.4 < got[3] < 0.6
    assert fingerprint.likeness([sets[2]], [sets[2]])[0] == 1


def test_fingerprints(docs):
    rows = {(i, t or "") for i, t in corpus_rows}
    got = fingerprint.fingerprint_versions(docs).collect()
    assert len(got) == len(corpus_rows)
    ids = sorted({i for i, _ in corpus_rows if i is not None}, reverse=True)
    text = {i: t or "" for i, t in corpus_rows}
    after = dict(zip(ids, [*ids[1:], None]))
    sets = lambda t: Counter(plain_pieces(t))
    near = lambda a, b: (a & b).total() / (a | b).total() if a | b else 1.0
    checked = 0
    for r in got:
        if r.doc_id in (None, 55):
            continue
        t, n = text[r.doc_id], text[after[r.doc_id]]
        e = fingerprint.edit(t, n)
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert abs(r.near_edited - near(sets(t), sets(e))) < 1e-9 and abs(r.near_next - near(sets(t), sets(n))) < 1e-9
        checked += 1
    assert checked == len(rows) - 2
    prints = {}
    for r in got:
        if r.doc_id is not None:
            assert prints.setdefault(text[r.doc_id], r.fingerprint) == r.fingerprint
    assert fingerprint.fingerprint_versions(docs.limit(0)).count() == 0


def test_embedding_dedup(spark):
    base = rng.normal(size=(40, 16))
    vecs = np.concatenate([base, base[:10] * 2, base[:10] + rng.normal(scale=0.02, size=(10, 16)), base[:3]])
    rows = [(int(i), [float(x) for x in v], int(i % 2 if i < 40 else (i - 40) % 10 % 2)) for i, v in enumerate(vecs)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], None), (905, [], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(df).collect()}
    good = [r for r in rows if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    links = [(a, b) for a in range(len(good)) for b in range(len(good)) if a != b and good[a][2] == good[b][2] and len(good[a][1]) == len(good[b][1]) and np.dot(*pivots.unit(np.array([good[a][1], good[b][1]]))) >= 0.98]
    root = components(len(good), links)
    for k, r in enumerate(good):
        assert got[r[0]] == (sum(a == k for a, _ in links), good[root[k]][0])
    assert all(got[i] == (0, i) for i in (900, 901, 902, 903, 904, 905)) and len(got) == len(rows)
    assert pivots.near_vectors(df.limit(0)).count() == 0
    tiny = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(df, pivots=3, block=8).collect()}  # long lists in many blocks
    assert tiny == got


def test_embedding_norms_of_extreme_magnitude(spark):
    rows = [(1, [1e200, 2e200]), (2, [5e-200, 1e-199]), (3, [1e-200, 1e-200]), (4, [1.0, 0.1]), (5, [1e-320, 1e-320])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (0, 4), 5: (1, 3)}


def test_embedding_recall_and_many_widths(spark):
    """Links found on the given embeddings against brute force; and more widths than one."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in table.collect() if r.embedding and r.label is not None]
    rows = [r for r in rows if np.isfinite(r[1]).all() and r[1].any()]
    want = {r[0]: 0 for r in rows}
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        v = pivots.unit(np.array([r[1] for r in own]))
        for r, n in zip(own, (v @ v.T >= 0.98).sum(1) - 1):
            want[r[0]] = int(n)
    got = {r.vec_id: r.n_links for r in pivots.near_vectors(table).collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got[i] for i in want) >= 0.9 * sum(want.values())
    draw = np.random.default_rng(8)
    many = [(i, [float(x) for x in draw.normal(size=2 + i // 2 % 1100)], 0) for i in range(4400)]
    many = [(i, many[i - 2200][1] if i >= 2200 else v, 0) for i, v, _ in many]
    got = pivots.near_vectors(spark.createDataFrame(many, "vec_id long, embedding array<double>, label int")).where("n_links >= 1").count()
    assert got == 4400

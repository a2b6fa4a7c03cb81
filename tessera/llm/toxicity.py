"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding undoes disguise: case, accents, look-alike letters of other scripts, digits for letters and
invisible characters. The lexicon (whole words and word beginnings with log-odds weights) and the
calibration are learned on the driver from a bounded sample of labelled rows; scoring is one narrow
pass in which hits inside exception phrases don't count and the weight is set against the length.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .langid import crc_of_id
from .texts import texts

#: Letters of other scripts that look like Latin ones, lower case (fixed values).
_LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝкмтвнгαεορυχικτνβηωɑɡıļ", "aeopcyxijshdqwkmtbhraeopuxiktvbnwagil"))
#: Digits and signs written for letters; l, 1 and | fold with i, as each stands for the others.
_DIGITS = dict(zip("013456789l", "oieasbtbgi"))
_SIGNS = dict(zip("!|@$+€", "iiaste"))
_SIGN_INSIDE = re.compile(r"(?<=\w)[!|@$+€](?=\w)|(?<!\S)[@$](?=\w)")


def _table() -> dict:
    out = {ord(c): None for c in "​‌‍⁠﻿­᠎"}
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0xFF10, 0xFF5B), *range(0x1D400, 0x1D800)]:
        base = [c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c)]
        if len(base) == 1 and base[0].isascii() and base[0].isalnum():
            out[cp] = _DIGITS.get(base[0].lower(), base[0].lower())
    out |= {ord(a): _DIGITS.get(b, b) for a, b in _LOOKALIKES.items()}
    return out | {ord(a): b for a, b in _DIGITS.items()} | {cp: None for cp in range(0x300, 0x370)}


_FOLD = _table()
#: Phrases in which a listed word is meant literally.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "trash bags", "trash collection", "clown fish", "class clown", "stupid simple", "not stupid", "sore loser rule")


def fold(text: str) -> str:
    """Text as the lexicon sees it."""
    text = text.lower()
    if _SIGN_INSIDE.search(text):
        text = _SIGN_INSIDE.sub(lambda m: _SIGNS[m[0]], text)
    return text.translate(_FOLD)


@dataclass(frozen=True)
class Lexicon:
    """``terms``: folded term -> weight; a term that ends in a blank is a whole word, others begin words."""

    terms: dict
    exceptions: tuple
    coef: tuple  # intercept, log1p(weight), log density, heaviest hit


_WORD = re.compile(r"[^\W_]+")


def _terms_of(word: str, longest: int = 10) -> list:
    """A word's beginnings of three to ``longest`` letters, and the whole word, however long."""
    return [word + " ", *[word[:n] for n in range(3, min(longest, len(word)) + 1)]]


def learn_terms(texts: list[str], toxic: list[int], *, least: float = 0.02, odds: float = 2.5) -> dict:
    """Terms that at least ``least`` of toxic documents hold, ``exp(odds)`` times as often a word as clean ones.

    Weights are log-odds of rates a word, at most 8, so a term that clean texts use now and then
    weighs less than one that they never use. Of terms that begin alike, the longest with nearly the
    support of the shorter is taken.
    """
    support, pos, neg, words, n = Counter(), Counter(), Counter(), [1, 1], 0
    for t, y in zip(texts, toxic):
        if y:
            n += 1
            held = Counter(_WORD.findall(fold(t)))
            words[1] += sum(held.values())
            support.update({x for w in held for x in _terms_of(w)})
            for w, k in held.items():
                for x in _terms_of(w):
                    pos[x] += k
    support = {x: c for x, c in support.items() if c >= max(3, least * n)}
    for t, y in zip(texts, toxic):
        if not y:
            held = Counter(_WORD.findall(fold(t)))
            words[0] += sum(held.values())
            for w, k in held.items():
                for x in _terms_of(w):
                    if x in support:
                        neg[x] += k
    weight = lambda t: math.log((pos[t] + 0.5) / words[1]) - math.log((neg[t] + 0.5) / words[0])
    good = {t: w for t in support if (w := weight(t)) >= odds}
    children: dict = {}
    for t in good:
        if len(t) > 3 and t[:-1] in good:
            children.setdefault(t[:-1], []).append(t)
    chosen: dict = {}
    for t in sorted(t for t in good if t[:-1] not in good):
        while heavy := [c for c in children.get(t, []) if support[c] >= 0.95 * support[t]]:
            t = max(heavy, key=lambda c: (support[c], c))
        level = [t]
        while level:  # terms too short to trust give way to their continuations
            level, now = [], level
            for x in now:
                if len(x.strip()) >= 4:
                    chosen[x] = min(good[x], 8.0)
                else:
                    level += children.get(x, [])
    return dict(sorted(chosen.items(), key=lambda x: (-x[1] * support[x[0]], x[0])))


def matcher(terms: dict, exceptions: tuple):
    """An automaton over folded terms and exception phrases."""
    auto = ahocorasick.Automaton()
    for t, w in terms.items():
        auto.add_word(t.rstrip(" "), (len(t.rstrip(" ")), t.endswith(" "), w))
    for e in exceptions:
        auto.add_word(fold(e), (len(fold(e)), True, None))
    if len(auto):
        auto.make_automaton()
    return auto


def weigh(auto, text: str | None) -> tuple[float, int, int, float]:
    """(summed weight, hits, words, heaviest hit) of a whole text; hits in exception phrases don't count."""
    if not text:
        return 0.0, 0, 0, 0.0
    folded, hits, spared = fold(text), [], []
    if len(auto):
        for end, (size, whole, w) in auto.iter(folded):
            start = end - size + 1
            if start and folded[start - 1].isalnum() or whole and end + 1 < len(folded) and folded[end + 1].isalnum():
                continue
            (hits if w is not None else spared).append((start, end, w))
    found: dict = {}
    for start, end, w in hits:
        if not any(a <= start and end <= b for a, b, _ in spared):
            found[start] = max(w, found.get(start, 0.0))
    return sum(found.values()), len(found), folded.count(" ") + folded.count("\n") + 1, max(found.values(), default=0.0)


def _features(got: list[tuple]) -> np.ndarray:
    weight, _, words, top = np.array(got, float).reshape(-1, 4).T
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log((weight + 0.05) / (words + 20.0)), top / 4], axis=1)


def calibrate(got: list[tuple], toxic: list[int], ridge: float = 1.0) -> tuple:
    """Logistic regression by Newton steps; what a text holds can only raise its score."""
    x, y = _features(got), np.array(toxic, float)
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - y) / len(y) + ridge / len(y) * b
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(y) + (ridge / len(y) + 1e-6) * np.eye(4)
        step = np.linalg.solve(hess, grad)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(b[0]), *[max(0.0, float(v)) for v in b[1:]]


def train(texts: list[str], toxic: list[int], exceptions: tuple = EXCEPTIONS) -> Lexicon:
    """Learn terms and calibration; with no toxic or no clean text the lexicon is empty."""
    if not texts or not 0 < sum(map(bool, toxic)) < len(toxic):
        return Lexicon({}, exceptions, (-4.0, 0.0, 0.0, 0.0))
    terms = learn_terms(texts, toxic)
    auto = matcher(terms, exceptions)
    return Lexicon(terms, exceptions, calibrate([weigh(auto, t) for t in texts], toxic))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = 6000, exceptions: tuple = EXCEPTIONS) -> Lexicon:
    """Train on at most about ``max_train`` labelled rows, drawn by a hash of the id, half of each class if there are.

    Only the sample's ids (bounded by the parameter) are broadcast to pick the texts, so ``docs`` isn't
    shuffled. A document labelled more than once counts as toxic if any label says so; null labels,
    ids and texts don't train.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("__y"))
    counts = {r[0]: r[1] for r in known.groupBy((F.col("__y") > 0).alias("y")).count().collect()}
    slots = 1 << 30
    share = F.when(F.col("__y") > 0, F.lit(min(slots, slots * (max_train // 2) // counts.get(True, 1)))).otherwise(F.lit(min(slots, slots * (max_train // 2) // counts.get(False, 1))))
    drawn = known.where(F.pmod(F.xxhash64(F.lit("toxicity"), F.col(id_col)), F.lit(slots)) < share).limit(2 * max_train).collect()
    if not drawn:
        return train([], [], exceptions)
    ids = docs.sparkSession.createDataFrame([(r[0], int(r[1] > 0)) for r in drawn], schema=type(docs.schema)([docs.schema[id_col]]).add("__y", "integer"))
    rows = docs.select(id_col, text_col).join(F.broadcast(ids), id_col).where(F.col(text_col).isNotNull()).select(id_col, text_col, "__y").limit(4 * max_train).collect()
    rows = sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1]))
    return train([r[1] for r in rows], [r[2] for r in rows], exceptions)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Append ``tox_score`` (0 to 1), ``tox_hits`` and ``toxic_pred`` (score >= ``threshold``) to every row.

    One narrow Arrow pass over whole texts. Null and empty texts have no hit and get the lowest score;
    repeated rows get equal scores. Existing columns of the three names are replaced.
    """
    names = [("tox_score", "double"), ("tox_hits", "long"), ("toxic_pred", "integer")]
    rest = docs.drop(*[n for n, _ in names])
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        lex = shared.value
        auto = matcher(lex.terms, lex.exceptions)
        for batch in batches:
            got = [weigh(auto, t) for t in texts(batch.column(text_col))]
            p = 1 / (1 + np.exp(-np.clip(_features(got) @ np.array(lex.coef), -30, 30)))
            made = [pa.array(p, pa.float64()), pa.array([g[1] for g in got], pa.int64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[n for n, _ in names]])

    schema = type(rest.schema)(rest.schema.fields[:])
    for name, kind in names:
        schema = schema.add(name, kind)
    return rest.mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels of rows whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(crc_of_id() % 4 != 2)
    held = F.coalesce(crc_of_id() % 4 == 2, F.lit(False))
    return score(docs, fit(docs, labels)).select("doc_id", held.alias("held_out"), F.col("tox_score").alias("score"), F.col("toxic_pred").alias("predicted"), F.col("tox_hits").alias("hits"))

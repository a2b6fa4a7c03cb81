"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training is plain stochastic gradient descent in numpy on the driver, over a bounded, stratified
sample of labelled rows (``max_train`` documents). Prediction streams every whole text through one
small score table (``buckets`` x languages floats, so its broadcast size is fixed by parameters).

A text is rejected where the softmax is unsure at every language, or where its subwords are rarer in the
training texts than those of nearly any kept-back piece with as many different ones: so unlearned
languages and gibberish go, and a text that is torn between two learned languages stays, as does a word
said over and over. Both levels are calibrated on kept-back texts, the second one for each number of
different subwords, as texts of few vary more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .texts import texts

UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}").search
#: ASCII characters that are not letters count as blanks, so subwords see word edges only.
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


@dataclass(frozen=True)
class LangModel:
    """``table[bucket]`` holds a subword's logit for each language; confidence is softmax at ``temperature``.

    ``seen[bucket]`` is the log share of a subword in the training texts; its mean over a text is the
    text's familiarity. ``strange_below`` holds the least familiarity that passes at the log numbers of
    different subwords ``strange_at``, with straight lines between.
    """

    langs: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float
    seen: np.ndarray
    strange_at: np.ndarray
    strange_below: np.ndarray

    def is_strange(self, familiarity: float, n: int) -> bool:
        return bool(len(self.strange_at)) and familiarity < np.interp(np.log(n), self.strange_at, self.strange_below)


#: Lengths in characters of the pieces that familiarity is calibrated on. Its level lies beyond the rarest of
#: them by a share of their distance from the middle: ``MARGIN``, and ``ODD`` characters' worth for one odd word.
LENGTHS, MARGIN, ODD = (2, 4, 8, 15, 30, 60, 120, 250, 500, 1000, 2000), 0.15, 2
#: Bytes whose subwords are looked up at once.
STEP = 1 << 20


_DIGIT = regex.compile(rb"[0-9]").search


def plain(text: str) -> bytes:
    """Lower-cased words in UTF-8 with single blanks between and around them; words that hold digits (keys, addresses) only if there are no others."""
    words = text.lower().encode("utf-8", "replace").split()
    for kept in ([w for w in words if not _DIGIT(w)], words):
        found = b" ".join(b" ".join(kept).translate(_BLANK).split())
        if found:
            break
    return b" " + found + b" "


def subwords(text: str | bytes, buckets: int, begin: int = 0, count: int | None = None) -> np.ndarray:
    """Bucket numbers of the byte 2-, 3- and 4-grams of a text; with ``count``, of those of its ``plain`` bytes that begin in a stretch."""
    raw = plain(text) if isinstance(text, str) else text
    n = len(raw) - begin if count is None else count
    b = np.frombuffer(raw[begin : begin + n + 3], dtype=np.uint8).astype(np.uint32)
    two = (b[:-1] << np.uint32(8)) | b[1:]
    parts = [two[:n] * _MIX[0]]
    if len(raw) > 3:
        parts.append((((two[:-1] << np.uint32(8)) | b[2:]) * _MIX[1])[:n])
        parts.append((((two[:-2] << np.uint32(16)) | two[2:]) * _MIX[2])[:n])
    return np.concatenate(parts) >> np.uint32(32 - int(buckets).bit_length() + 1)


def stretches(text: str, buckets: int):
    """The subwords of a whole text, each once, in portions of bounded size."""
    raw = plain(text)
    for begin in range(0, len(raw), STEP):
        yield subwords(raw, buckets, begin, STEP)


def _levels(texts: list[str], seen: np.ndarray, keep: float) -> tuple[np.ndarray, np.ndarray]:
    """(log numbers of different subwords, least familiarity) over pieces of each length from all over the texts."""
    at, below = [], []
    for length in LENGTHS:
        each = 12 if length < 100 else 4
        found = [(float(seen[idx].mean()), len(np.unique(idx))) for t in texts for j in range(each) if _LETTER(piece := t[(begin := max(0, len(t) - length) * j // (each - 1)) : begin + length]) for idx in [subwords(piece, len(seen))]]
        if found:
            known, sizes = np.array(found).T
            edge, middle = np.quantile(known, [1 - keep, 0.5])
            size = float(np.log(np.median(sizes)))
            if not at or size > at[-1]:
                at.append(size)
                below.append(edge - (MARGIN + ODD / length) * (middle - edge))
    return np.array(at), np.array(below)


def train(texts: list[str], langs: list[str], *, buckets: int = 1 << 15, dim: int = 16, epochs: int = 3, rate: float = 0.5, keep: float = 0.9995, seed: int = 7) -> LangModel:
    """Fit on labelled texts; every tenth one is kept back to set the temperature and the rejection level.

    ``keep`` is the share of kept-back pieces that either level must let pass, with room to spare. Without
    any labelled text the model knows no language and rejects everything.
    """
    names = tuple(sorted(set(langs)))
    if not names:
        return LangModel((), np.zeros((buckets, 0), np.float32), np.zeros(0, np.float32), 1.0, 1.1, np.zeros(buckets, np.float32), np.zeros(0), np.zeros(0))
    rng, k = np.random.default_rng(seed), len(names)
    emb, out, bias = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32), np.zeros((dim, k), np.float32), np.zeros(k, np.float32)
    target = np.array([names.index(x) for x in langs])
    held = np.arange(len(texts)) % 10 == 9 if len(texts) >= 50 else np.zeros(len(texts), bool)
    fit = np.flatnonzero(~held)
    steps, done = epochs * len(fit) * 2, 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            whole = texts[i]
            for _ in range(2):  # random stretches, so that short documents are as well placed as long ones
                size = int(rng.integers(20, 400))
                at = int(rng.integers(0, max(1, len(whole) - size + 1)))
                idx = subwords(whole[at : at + size], buckets)
                step = rate * (1 - done / steps)
                done += 1
                x = emb[idx].mean(axis=0)
                z = x @ out + bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[target[i]] -= 1
                back = out @ p
                out -= step * np.outer(x, p)
                bias -= step * 0.1 * p
                emb[idx] -= (step * 8 / max(1, len(idx)) ** 0.5) * back
    table = emb @ out
    check = np.flatnonzero(held) if held.any() else fit
    pieces = [(texts[i][at : at + n], target[i]) for i in check for at, n in ((0, 60), (len(texts[i]) // 2, 200), (0, 2000))]
    z = np.array([table[subwords(t, buckets)].mean(axis=0) + bias for t, _ in pieces])
    y = np.array([t for _, t in pieces])
    best = min((_loss(z / t, y), t) for t in np.geomspace(0.05, 20, 60))[1]
    conf = _softmax(z / best)
    right = conf.max(axis=1)[conf.argmax(axis=1) == y]
    floor = float(np.quantile(right, 1 - keep)) if len(right) else 1.0
    count = np.ones(buckets)
    for i in fit:
        for idx in stretches(texts[i], buckets):
            count += np.bincount(idx, minlength=buckets)
    seen = np.log(count / count.sum()).astype(np.float32)
    return LangModel(names, table.astype(np.float32), bias, float(best), min(floor * 0.8, 1.5 / k if k > 1 else 0.5), seen, *_levels([texts[i] for i in check], seen, keep))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(-np.log(np.maximum(_softmax(z)[np.arange(len(y)), y], 1e-12)).mean())


def predict_one(model: LangModel, text: str | None) -> tuple[str, float, bool]:
    """(language, score, rejected); ``und``, 0.0, True for null, for texts without a letter, and with no model."""
    if text is None or not model.langs or not _LETTER(text):
        return UNDETERMINED, 0.0, True
    buckets, total, n, known = len(model.table), np.zeros(len(model.langs), np.float64), 0, 0.0
    met = np.zeros(buckets, bool)
    for idx in stretches(text, buckets):  # in steps, so that memory stays bounded
        met[idx] = True
        total += np.array([model.table[:, c][idx].sum(dtype=np.float64) for c in range(total.size)])
        known += float(model.seen[idx].sum(dtype=np.float64))
        n += len(idx)
    strange = model.is_strange(known / n, np.count_nonzero(met))
    p = _softmax((total / n + model.bias) / model.temperature)
    best = int(p.argmax())
    return model.langs[best], float(p[best]), bool(strange or p[best] < model.reject_below)


def training_rows(docs: DataFrame, usable, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = 6000) -> list:
    """A bounded sample of (text, lang): rows where ``usable`` holds, drawn by a hash of the id, evenly by language.

    Counts are taken over all rows (two narrow columns) and every language trains; the texts that come
    to the driver are at most about ``max_train``. Rows with a null text or language never train.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & usable)
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return []
    each, slots = max(1, max_train // len(counts)), 1 << 30
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(slots, slots * each // n))])
    draw = F.pmod(F.xxhash64(F.lit("langid"), F.col(id_col)), F.lit(slots))
    return rows.where(draw < F.coalesce(share[F.col(lang_col)], F.lit(0))).select(text_col, lang_col).limit(2 * max_train).collect()


def fit(docs: DataFrame, usable=None, **options) -> LangModel:
    """Train a model on a bounded sample of ``docs`` (see :func:`training_rows`)."""
    sample = {k: options.pop(k) for k in ("id_col", "text_col", "lang_col", "max_train") if k in options}
    rows = sorted((tuple(r) for r in training_rows(docs, F.lit(True) if usable is None else usable, **sample)), key=lambda r: (r[1], r[0]))
    order = np.random.default_rng(3).permutation(len(rows))
    return train([rows[i][0] for i in order], [rows[i][1] for i in order], **options)


def identify(docs: DataFrame, model: LangModel, text_col: str = "text") -> DataFrame:
    """Append ``lang_pred``, ``lang_score`` and ``lang_rejected`` to every row of ``docs``.

    Rejected texts keep the language that is likeliest for them; only ``und`` names none.

    One narrow Arrow pass without a shuffle. Null, empty and letterless texts give ``und``, 0.0, true;
    ties between languages go to the first by name; repeated rows get equal results; an empty table
    stays empty. Existing columns of these three names are replaced.
    """
    new = pa.schema([("lang_pred", pa.string()), ("lang_score", pa.float64()), ("lang_rejected", pa.bool_())])
    rest = docs.drop(*new.names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            found = [predict_one(known, t) for t in texts(batch.column(text_col))]
            columns = [pa.array([f[i] for f in found], type=new.field(i).type) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *new.names])

    ddl = rest.schema
    for name, kind in (("lang_pred", "string"), ("lang_score", "double"), ("lang_rejected", "boolean")):
        ddl = type(ddl)(ddl.fields[:]).add(name, kind)
    return rest.mapInArrow(run, ddl)


def crc_of_id(id_col: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows whose crc32(doc_id) mod 5 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(crc_of_id() % 5 == 0, F.lit(False))
    model = fit(docs, crc_of_id() % 5 != 0)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))

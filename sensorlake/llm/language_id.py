"""Language identification in two steps: family first, then one-versus-one linear SVMs within the family.

A text is described by the hashed byte 1-, 2- and 3-grams of its words (A-Z lower-cased, a space on both
sides), square-root scaled and of unit length.  Families are learned: languages whose mean descriptions
are closest are merged until `FAMILIES` groups are left.  A linear SVM per pair of families votes for the
family, then a linear SVM per pair of its languages votes for the language.  All machines are fitted by
dual coordinate descent on a bounded sample of the labelled rows.

Edge cases: a text that is null or has no letter gives `und` with score 0; a learned language may have
any name; with one learned language every text with letters gets it; with none, every text gives `und`;
repeated rows are judged alike and count once in the fit; texts of any length are described whole; an empty table
gives an empty result; only the id and the text of the judged rows are read, whatever other columns there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.kernels import _LOWER, Chunk, chunks
from sensorlake.llm.samples import bounded_sample

BINS = 4096
FAMILIES = 2
#: Fitting documents of each language, at most, and languages at most.
MAX_PER_LANGUAGE, MAX_LANGUAGES = 500, 200
UNDETERMINED = "und"
_OUTSIDE = np.zeros(256, dtype=bool)  # bytes that are neither letters nor parts of other code points
_OUTSIDE[:128] = [not chr(c).isalpha() for c in range(128)]


def describe(chunk: Chunk) -> np.ndarray:
    """One row of BINS per document of the chunk."""
    data = _LOWER[chunk.data].astype(np.uint32)
    data[_OUTSIDE[chunk.data]] = 32
    out = np.zeros((chunk.n_docs, BINS), dtype=np.float32)
    two = np.zeros(len(data), dtype=np.uint32)
    three = two.copy()
    two[:-1] = data[:-1] << np.uint32(8) | data[1:]
    three[:-2] = two[:-2] << np.uint32(8) | data[2:]
    # 256 single bytes, 768 bins of pairs, the rest of triples; a gram that leaves its document is not counted
    pairs = 256 + (two * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(768)
    triples = 1024 + (three * np.uint32(2246822519) >> np.uint32(12)) % np.uint32(BINS - 1024)
    for i in range(chunk.n_docs):
        a, b = int(chunk.bounds[i]), int(chunk.bounds[i + 1])
        row = np.bincount(data[a:b], minlength=BINS)
        row[32] = 0
        if row.any():
            row += np.bincount(pairs[a : max(a, b - 1)], minlength=BINS) + np.bincount(triples[a : max(a, b - 2)], minlength=BINS)
            scaled = np.sqrt(row.astype(np.float64))
            out[i] = scaled / np.linalg.norm(scaled)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 1.0, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Linear SVM (squared hinge) by dual coordinate descent; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    w, alpha = np.zeros(x.shape[1]), np.zeros(len(x))
    share = np.array([(y > 0).mean(), (y < 0).mean()])
    diagonal = 0.5 / (cost * np.where(y > 0, 0.5 / share[0], 0.5 / share[1]))
    q = (x * x).sum(1) + diagonal
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in rng.permutation(len(x)):
            gradient = y[i] * (w @ x[i]) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - gradient / q[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def vote(x: np.ndarray, groups: int, machines: dict[tuple[int, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Winner by votes (then by summed certainty) and its mean certainty, for each row."""
    sure = np.zeros((len(x), groups))
    wins = np.zeros((len(x), groups))
    for (a, b), w in machines.items():
        p = 1 / (1 + np.exp(-3 * (x @ w[:-1] + w[-1])))
        sure[:, a] += p
        sure[:, b] += 1 - p
        wins[:, a] += p >= 0.5
        wins[:, b] += p < 0.5
    best = np.argmax(wins + sure / (groups + 1), axis=1)
    return best, sure[np.arange(len(x)), best] / max(groups - 1, 1) if machines else np.ones(len(x))


@dataclass
class Languages:
    names: list[list[str]]  # the languages of each family
    between: dict[tuple[int, int], np.ndarray]
    within: list[dict[tuple[int, int], np.ndarray]]

    @classmethod
    def fit(cls, x: np.ndarray, language: list[str], families: int = FAMILIES) -> Languages:
        known = sorted(set(language))
        code = np.array([known.index(v) for v in language], dtype=int)
        groups = [[i] for i in range(len(known))]
        means = [x[code == i].mean(0) for i in range(len(known))]
        distance = lambda g, h: np.mean([np.linalg.norm(means[i] - means[j]) for i in g for j in h])
        while len(groups) > families:
            a, b = min(combinations(range(len(groups)), 2), key=lambda p: distance(groups[p[0]], groups[p[1]]))
            groups[a] += groups.pop(b)
        groups = [sorted(g) for g in groups]
        family = np.zeros(len(known), dtype=int)
        for f, g in enumerate(groups):
            family[g] = f

        def pairwise(label: np.ndarray, n: int) -> dict[tuple[int, int], np.ndarray]:
            out = {}
            for a, b in combinations(range(n), 2):
                rows = (label == a) | (label == b)
                out[a, b] = fit_svm(x[rows], np.where(label[rows] == a, 1.0, -1.0))
            return out

        within = []
        for g in groups:
            place = np.full(len(known), -1)
            place[g] = np.arange(len(g))
            within.append(pairwise(place[code], len(g)))
        return cls([[known[i] for i in g] for g in groups], pairwise(family[code], len(groups)), within)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        names, scores = np.full(len(x), UNDETERMINED, dtype=object), np.zeros(len(x))
        if not self.names:
            return names, scores
        family, sure = vote(x, len(self.names), self.between)
        for f, own in enumerate(self.names):
            rows = np.flatnonzero(family == f)
            if len(rows):
                best, certain = vote(x[rows], len(own), self.within[f])
                names[rows] = np.array(own, dtype=object)[best]
                scores[rows] = np.clip(sure[rows] * certain, 0, 1)
        return names, scores


def fit_languages(docs: DataFrame, per_language: int = MAX_PER_LANGUAGE, families: int = FAMILIES) -> Languages:
    """Fits on docs(doc_id, text, lang): at most per_language documents, chosen by a hash of the id, of each of the
    MAX_LANGUAGES most frequent languages, so that a column of free text as lang does not become a language a row."""
    marked = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "doc_id")
    chosen = bounded_sample(marked, "lang", "doc_id", per_language, MAX_LANGUAGES).distinct()
    sample = docs.where("text IS NOT NULL").select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                x = [r.astype(np.float16).tobytes() for r in describe(chunk)]
                part = batch.slice(chunk.first_row, chunk.n_docs)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], names=["doc_id", "lang", "x"])

    found = sample.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, x binary")
    rows = found.groupBy("doc_id", "lang").agg(F.min("x").alias("x")).toPandas()  # at most per_language rows of a language, repeated ones once
    rows = rows.sort_values(["doc_id", "lang"], kind="stable")
    x = np.array([np.frombuffer(v, dtype=np.float16) for v in rows["x"]], dtype=np.float32).reshape(-1, BINS)
    filled = x.any(axis=1)
    language = [v for v, ok in zip(rows["lang"], filled, strict=True) if ok]
    return Languages.fit(x[filled], language, families) if language else Languages([], {}, [])


def identify(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for chunk in chunks(texts):
                names, scores = model.predict(describe(chunk))
                for i in range(chunk.n_docs):
                    if not any(map(str.isalpha, texts[chunk.first_row + i].as_py() or "")):  # Unicode letters, no numerals
                        names[i], scores[i] = UNDETERMINED, 0.0
                ids = batch.column(0).slice(chunk.first_row, chunk.n_docs)
                yield pa.RecordBatch.from_arrays([ids, pa.array(names, pa.string()), pa.array(scores)], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double")

"""Quality rules: a linear-chain conditional random field labels lines, content share decides.

Every line of a document (split at line feeds) is described by binned features (shape, position, repetition)
and by hashed words; the chain's most likely labelling (Viterbi) marks each line as content or boilerplate.
A document is kept if content lines hold at least `MIN_SHARE` of its words and the base rules do not reject it.

Labels exist for documents, not for lines, so the field is fitted to partly observed chains, over a bounded,
hash chosen sample of labelled documents:

* a line that occurs in several places of the sample, between different neighbours, is boilerplate (copies of a
  document repeat their neighbours too, so their lines do not count);
* other lines of `LONG` words and more are content in documents of quality 1;
* all other lines are unknown, and in documents of quality 0 the expected share of content words may be `JUNK_SHARE`
  at most: a bias of each chain, adapted along with the weights, holds it there.

The weights follow the gradient of the likelihood of what is observed: expected features under the observed
labels and biases, less expected features of the free chain, both by forward-backward.  So moves between
labels are learned wherever a document holds both.

Edge cases: a null, empty or wordless text has no words, fails the base rules and is not kept; lines
without words get no label of their own (they are skipped in the chain); repeated rows are judged
alike; texts of any length are judged whole; an empty table gives an empty result; columns other than id and text
are only passed on (`keep_quality`); without labelled documents of both qualities the chain calls every
line content.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.kernels import Chunk, chunks
from sensorlake.llm.samples import bounded_sample

MIN_SHARE = 0.5
#: Labelled documents of each quality that the field is fitted on, at most.
MAX_PER_LABEL = 600
#: Lines of a chain in the fit; a document takes part with at most so many chains, spread over its length.
CHAIN, MAX_CHAINS = 64, 16
LONG, JUNK_SHARE = 5, 0.25
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

_EDGES = {
    "symbols": (0.02, 0.2, 0.6),  # [#*$%&|<>] per word
    "upper": (0.15, 0.4, 0.8),  # upper-case letters among the letters
    "distinct": (0.3, 0.5, 0.7, 0.9),  # distinct words among the words
    "word": (3.0, 4.5, 6.0, 8.0, 12.0),  # code points per word
    "short": (0.05, 0.15, 0.3, 0.5),  # words of at most three code points
    "marks": (0.05, 0.3, 0.9),  # ! ? per word
    "letters": (0.5, 0.7, 0.85),  # letters among the word code points
    "words": (4.0, 10.0, 30.0, 100.0),
    "place": (0.5, 1.5, 2.5),  # 0 inside, 1 first, 2 last, 3 only line of the document
    "again": (0.5,),  # repeats an earlier line of the document
    "stop": (0.5,),  # ends with . ! ? : ;
}
_OFFSETS = np.cumsum([0] + [len(e) + 1 for e in _EDGES.values()])
N_SHAPE = int(_OFFSETS[-1]) + 1  # and a constant
#: Bins of the hashed words; a line's words count with their mean weight.
N_WORDS = 8192


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint8)
    out[list(chars.encode())] = 1
    return out


_SYMBOL, _MARK, _STOP = _table("#*$%&|<>"), _table("!?"), _table(".!?:;")
_UPPER = np.zeros(256, dtype=np.uint8)
_UPPER[65:91] = 1
_POINT = np.ones(256, dtype=np.uint8)  # bytes that begin a code point, separators aside
_POINT[0x80:0xC0] = 0
_POINT[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
_LETTER = np.zeros(256, dtype=np.uint8)  # bytes that begin a letter: ASCII, Latin and what follows but for general punctuation
_LETTER[65:91] = _LETTER[97:123] = _LETTER[0xC3:] = 1
_LETTER[[0xE2, 0xE3]] = 0


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Sums of small values over spans of bytes."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[last] - total[first]


@dataclass
class Lines:
    """The lines with words of a chunk, and counts of its documents."""

    doc: np.ndarray  # document of each line
    first: np.ndarray  # first word of each line
    n: np.ndarray  # words of each line
    shape: np.ndarray  # one row of feature numbers per line
    words: np.ndarray  # word bin of each word
    same: np.ndarray  # number of each line's text within the chunk
    counts: np.ndarray  # per document: words, word_chars, symbols, dup_lines, repeat_words

    @classmethod
    def of(cls, chunk: Chunk) -> Lines:
        data, bounds, n_docs = chunk.data, chunk.bounds, chunk.n_docs
        n_words = np.diff(chunk.word_bounds)
        begins = np.unique(np.concatenate([bounds[:-1], np.flatnonzero(data == 10) + 1]))
        line_of = np.searchsorted(begins, chunk.starts, side="right") - 1
        first = np.flatnonzero(np.diff(line_of, prepend=-1))
        n = np.diff(np.append(first, len(line_of)))
        start = begins[line_of[first]]
        stop = np.append(begins, len(data))[line_of[first] + 1]
        stop = stop - (data[stop - 1] == 10) if len(stop) else stop
        doc = np.searchsorted(chunk.word_bounds, first, side="right") - 1
        codes, vocabulary = chunk.codes()
        line = np.repeat(np.arange(len(first)), n)

        chars = _sums(_POINT[data], start, stop)
        letters, marks = _sums(_LETTER[data], start, stop), _sums(_MARK[data], start, stop)
        symbols = _sums(_SYMBOL[data], start, stop)
        upper = _UPPER[data]
        upper[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)  # capitals of Latin-1
        upper = _sums(upper, start, stop)
        short = np.bincount(line, _sums(_POINT[data], chunk.starts, chunk.ends) <= 3, minlength=len(first))
        fresh = ~pd.Series(line * max(len(vocabulary), 1) + codes).duplicated().to_numpy()
        distinct = np.bincount(line, fresh, minlength=len(first))
        same = _texts(data, start, stop)
        again = pd.Series(doc * (len(same) + 1) + same).duplicated().to_numpy()
        edge = np.diff(doc, prepend=-1) != 0
        place = edge + 2 * np.append(edge[1:], True) if len(edge) else edge.astype(int)
        last_byte = data[chunk.ends[first + n - 1] - 1]
        values = (symbols / n, upper / np.maximum(letters, 1), distinct / np.minimum(n, 400), chars / n, short / n, marks / n,
                  letters / np.maximum(chars, 1), n, place, again, _STOP[last_byte])
        shape = np.empty((len(first), len(_EDGES) + 1), dtype=np.int64)
        for i, (v, edges) in enumerate(zip(values, _EDGES.values(), strict=True)):
            shape[:, i] = _OFFSETS[i] + np.searchsorted(np.array(edges), np.asarray(v, dtype=np.float64), side="left")
        shape[:, -1] = N_SHAPE - 1
        words = (chunk.word_hashes() % np.uint64(N_WORDS)).astype(np.int64)

        by_doc = lambda x: np.bincount(doc, x, minlength=n_docs).astype(np.int64)
        grams = chunk.gram_codes(3)
        word_doc = np.repeat(np.arange(n_docs), n_words)
        inside = np.flatnonzero(word_doc[: len(grams)] == word_doc[2:])
        twice = inside[pd.Series(word_doc[inside] * (len(grams) + 1) + grams[inside]).duplicated(keep=False).to_numpy()]
        covered = np.zeros(len(codes) + 1, dtype=np.int64)
        np.add.at(covered, twice, 1)
        np.add.at(covered, twice + 3, -1)
        repeated = np.bincount(word_doc, np.cumsum(covered)[:-1] > 0, minlength=n_docs).astype(np.int64)
        counts = np.stack([n_words, by_doc(chars), by_doc(symbols), by_doc(again), repeated], axis=1)
        return cls(doc, first, n, shape, words, same, counts)

    def scores(self, field: ChainField) -> np.ndarray:
        """Scores of both labels for every line."""
        if not len(self.first):
            return np.zeros((0, 2))
        own = [field.emit[k, self.shape].sum(1) + np.add.reduceat(field.word[k, self.words], self.first) / self.n for k in (0, 1)]
        return np.stack(own, axis=1)


def _texts(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A number for the text of each span; equal exactly if the bytes are."""
    change = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(change, start, 1)
    np.add.at(change, stop, -1)
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(stop - start, out=offsets[1:])
    inside = data[np.cumsum(change, dtype=np.int8)[:-1] > 0]
    texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(inside)])
    return texts.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class ChainField:
    """Scores of (label, shape feature), of (label, word bin) and of (label, next label); label 1 is content."""

    emit: np.ndarray
    word: np.ndarray
    move: np.ndarray

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best labels of a chain of lines with these scores; content on a tie."""
        if not len(scores):
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        rows = scores.tolist()
        a, b = rows[0]
        back = []
        for s0, s1 in rows[1:]:
            from0, from1 = (a + m00 <= b + m10), (a + m01 <= b + m11)
            back.append((int(from0), int(from1)))
            a, b = (b + m10 if from0 else a + m00) + s0, (b + m11 if from1 else a + m01) + s1
        labels = [int(b >= a)]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]

    @classmethod
    def neutral(cls) -> ChainField:
        return cls(np.zeros((2, N_SHAPE)), np.zeros((2, N_WORDS)), np.zeros((2, 2)))

    @classmethod
    def fit(cls, chains: list[Chain], rounds: int = 80, penalty: float = 1e-3) -> ChainField:
        """Gradient ascent (adaptive steps) over partly observed chains."""
        if len({c.quality for c in chains}) < 2:
            return cls.neutral()
        field, length = cls.neutral(), max(len(c.n) for c in chains)
        mask = np.zeros((len(chains), length), dtype=bool)
        seen_label = np.full(mask.shape, -1)
        n = np.zeros(mask.shape)
        for i, c in enumerate(chains):
            mask[i, : len(c.n)] = True
            seen_label[i, : len(c.n)], n[i, : len(c.n)] = c.observed, c.n
        at = np.flatnonzero(mask.ravel())  # line -> place
        shape = np.concatenate([c.shape for c in chains])
        words, sizes = np.concatenate([c.words for c in chains]), n.ravel()[at].astype(np.int64)
        first, line_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(at)), sizes)
        junk = np.array([c.quality == 0 for c in chains])
        lines = np.array([mask[junk].sum(), mask[~junk].sum()])
        weight = np.where(junk, lines.sum() / (2 * lines[0]), lines.sum() / (2 * lines[1]))
        allowed = np.where(seen_label[..., None] == np.array([1, 0]), -1e6, 0.0)  # the other label of an observed line
        bias, share = np.where(junk, -2.0, 0.0), np.maximum(n.sum(1), 1)
        steps = [np.full(p.shape, 1e-6) for p in (field.emit, field.word, field.move)]
        for _ in range(rounds):
            node = np.zeros((mask.size, 2))
            for k in (0, 1):
                node[at, k] = field.emit[k, shape].sum(1) + np.add.reduceat(field.word[k, words], first) / sizes
            node = node.reshape(*mask.shape, 2)
            free, free_moves = _expected(node, field.move, mask)
            held, held_moves = _expected(node + allowed + bias[:, None, None] * np.array([0.0, 1.0]), field.move, mask)
            excess = (held[..., 1] * n).sum(1) / share - JUNK_SHARE
            bias = np.where(junk, np.minimum(bias - 4 * excess, 0.0), 0.0)
            error = ((held - free) * weight[:, None, None]).reshape(-1, 2)[at]
            g_emit = np.stack([np.bincount(shape.ravel(), np.repeat(error[:, k], shape.shape[1]), minlength=N_SHAPE) for k in (0, 1)])
            g_word = np.stack([np.bincount(words, (error[:, k] / sizes)[line_of], minlength=N_WORDS) for k in (0, 1)])
            g_move = ((held_moves - free_moves) * weight[:, None, None]).sum(0)
            for p, g, s in zip((field.emit, field.word, field.move), (g_emit, g_word, g_move), steps, strict=True):
                g = g / len(chains) - penalty * p
                s += g * g
                p += 0.5 * g / np.sqrt(s)
        return field


@dataclass
class Chain:
    """Some consecutive lines of a labelled document."""

    quality: int
    n: np.ndarray  # words of each line
    shape: np.ndarray
    words: np.ndarray  # word bins, line after line
    observed: np.ndarray  # label of each line, -1 where unknown


def _expected(node: np.ndarray, move: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the labels of each line, and expected moves of each chain (forward-backward)."""
    length = mask.shape[1]
    node = node * mask[..., None]
    fwd, bwd = np.zeros(node.shape), np.zeros(node.shape)
    fwd[:, 0] = node[:, 0]
    for t in range(1, length):
        step = np.logaddexp.reduce(fwd[:, t - 1, :, None] + move, axis=1) + node[:, t]
        fwd[:, t] = np.where(mask[:, t, None], step, fwd[:, t - 1])
    for t in range(length - 2, -1, -1):
        step = np.logaddexp.reduce(move + (node[:, t + 1] + bwd[:, t + 1])[:, None, :], axis=2)
        bwd[:, t] = np.where(mask[:, t + 1, None], step, 0)
    z = np.logaddexp.reduce(fwd[:, -1], axis=1)
    labels = np.exp(fwd + bwd - z[:, None, None]) * mask[..., None]
    moves = np.exp(fwd[:, :-1, :, None] + move + (node + bwd)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
    return labels, moves.sum(1)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
VERDICT = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, labels array<int>, content_share double"


def judge_texts(texts: pa.Array, field: ChainField) -> Iterator[pa.RecordBatch]:
    """The columns of VERDICT for each text, chunk after chunk."""
    for chunk in chunks(texts):
        found = Lines.of(chunk)
        scores = found.scores(field)
        edges = np.searchsorted(found.doc, np.arange(chunk.n_docs + 1))
        labels = np.array([y for a, b in zip(edges, edges[1:], strict=False) for y in field.viterbi(scores[a:b])], dtype=np.int32)
        n, repeated = found.counts[:, 0], found.counts[:, 4]
        content = np.bincount(found.doc, labels * found.n, minlength=chunk.n_docs)
        share = content / np.maximum(n, 1)
        failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED_PERCENT * n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in found.counts.T] + [pa.array(failed), pa.array(~failed & (share >= MIN_SHARE)),
             pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(labels)), pa.array(share)],
            names=[c.split()[0] for c in VERDICT.split(", ")])


def judge(docs: DataFrame, field: ChainField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts, base_failed, kept, labels of the lines with words, content_share); no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in judge_texts(batch.column(1), field):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, found.num_rows), *found.columns], names=[id_col, *found.schema.names])
                at += found.num_rows

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {VERDICT}")


def fit_field(docs: DataFrame, labels: DataFrame, per_label: int = MAX_PER_LABEL) -> ChainField:
    """Fits the field on at most per_label labelled documents of each quality, chosen by a hash of their id."""
    marked = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = bounded_sample(marked, "quality", "doc_id", per_label, 2)  # 2 * per_label rows
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                found = Lines.of(chunk)
                texts = _line_digests(chunk, found)
                rows = []
                for i in range(chunk.n_docs):
                    a, b = np.searchsorted(found.doc, (i, i + 1))
                    starts = np.unique(np.linspace(a, max(a, b - CHAIN), min(MAX_CHAINS, -(-(b - a) // CHAIN))).astype(np.int64)) if b > a else []
                    for s in starts:
                        e = min(s + CHAIN, b)
                        own = slice(found.first[s], found.first[e - 1] + found.n[e - 1])
                        rows.append((batch.column(0)[chunk.first_row + i].as_py(), batch.column(1)[chunk.first_row + i].as_py(), int(s - a), found.n[s:e],
                                     found.shape[s:e].ravel(), found.words[own], texts[s:e],
                                     np.where(np.arange(s, e) > a, texts[np.arange(s, e) - 1], 0), np.append(texts, 0)[np.arange(s, e) + 1] * (np.arange(s, e) < b - 1)))
                kinds = [pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int64())] * 6
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names=names)

    names = ["doc_id", "quality", "at", "n", "shape", "words", "same", "before", "after"]
    schema = "doc_id long, quality int, at long, " + ", ".join(f"{c} array<long>" for c in names[3:])
    rows = sample.mapInArrow(run, schema).toPandas()  # at most 2 * per_label * MAX_CHAINS chains
    rows = rows.sort_values(["doc_id", "at"], kind="stable")  # the fit does not depend on the order of arrival
    return ChainField.fit(chains_of(rows))


def _line_digests(chunk: Chunk, found: Lines) -> np.ndarray:
    """A hash of each line's words that holds across chunks."""
    if not len(found.first):
        return np.zeros(0, dtype=np.int64)
    place = np.arange(len(found.words)) - np.repeat(found.first, found.n)
    mixed = (chunk.word_hashes() ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), found.first).view(np.int64)


def chains_of(rows: pd.DataFrame) -> list[Chain]:
    """Chains with what is known of their lines."""
    lines = pd.DataFrame({c: np.concatenate(rows[c].tolist() or [np.zeros(0, dtype=np.int64)]) for c in ("same", "before", "after")})
    several = lines.drop_duplicates().groupby("same").size()
    several = several.index[several > 1]
    out = []
    for r in rows.itertuples():
        n = np.asarray(r.n)
        observed = np.where(np.isin(r.same, several), 0, np.where((r.quality == 1) & (n >= LONG), 1, -1))
        out.append(Chain(int(r.quality), n, np.asarray(r.shape).reshape(len(n), -1), np.asarray(r.words), observed))
    return out


def keep_quality(docs: DataFrame, field: ChainField) -> DataFrame:
    """docs without the rejected documents, all columns kept."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for found in judge_texts(batch.column(place), field):
                yield batch.slice(at, found.num_rows).filter(found.column("kept"))
                at += found.num_rows

    return docs.mapInArrow(run, docs.schema)

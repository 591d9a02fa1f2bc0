"""Spelling variants: one-edit neighbourhoods of words written in a reduced alphabet, verified on the words themselves."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.scratch import forget, stored

#: Letters of words: A-Z, a-z and U+00C0 to U+00FF.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Letters are hashed to so many symbols.
SYMBOLS = 8
MIN_CHARS, MIN_COUNT = 7, 2
#: A word's form is so many times as frequent.
RATIO = 10
#: Different words that a task counts before it passes its sums on.
COUNTED = 500_000
#: Hashes that a task makes at once.
CHUNK = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def symbol_of(letter: str, symbols: int = SYMBOLS) -> int:
    """The symbol of a letter, by a hash of its code point."""
    return zlib.crc32(b"symbol %d" % ord(letter)) % symbols


def occurrences(text: bytes, doc_id, min_chars: int = MIN_CHARS, typo: int = 31) -> list[bytes]:
    """The words of a text (both in UTF-8), A-Z lower-cased; a run whose hash with the document's id is divisible by `typo` loses a
    letter.  Runs of fewer than min_chars letters are none, nor are those that the loss makes so short."""
    pattern, prefix = _runs(min_chars), zlib.crc32(b"" if doc_id is None else b"%d" % doc_id)
    found = pattern.findall(text.lower())
    hashes = list(map(zlib.crc32, found, repeat(zlib.crc32(b":", prefix))))
    for i in [i for i, h in enumerate(hashes) if h % typo == 0] if typo else ():
        word = found[i].decode()
        at = hashes[i] % len(word)
        found[i] = (word[:at] + word[at + 1:]).encode() if len(word) > min_chars else b""
    return found


def _runs(min_chars: int):
    return re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf]){%d,}" % min_chars)


def word_counts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                typo: int = 31) -> DataFrame:
    """(word, n) of the words that occur at least min_count times; tasks sum before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def passed_on() -> pa.RecordBatch:
            counts.pop(b"", None)
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                counts.update(occurrences(batch.column(1)[i].as_buffer().to_pybytes(), batch.column(0)[i].as_py(), min_chars, typo))
                if len(counts) >= COUNTED:
                    yield passed_on()
        yield passed_on()

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, dtype=np.uint64)], dtype=np.uint64)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Of each row of symbols c: the sum of (c[i] + 1) * BASE^i, modulo 2^64."""
    return ((codes + 1).astype(np.uint64) * _powers(codes.shape[1] - 1)[None, :codes.shape[1]]).sum(axis=1, dtype=np.uint64)


def neighbourhood(codes: np.ndarray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all that one deletion or one replacement by a larger symbol makes of each row of codes.

    Together with the insertions and the replacements by smaller symbols that would be the full one-edit neighbourhood; those
    are left out because the other word of such a pair makes the step in the direction that is kept.  Each hash comes from
    sums over what precedes and follows the edited place, so time and memory are in proportion to the length.
    """
    rows, length = codes.shape
    value = (codes + 1).astype(np.uint64)
    power = _powers(length)
    term = value * power[None, :length]
    before = np.cumsum(term, axis=1, dtype=np.uint64) - term
    whole = before[:, -1] + term[:, -1]
    after = (whole[:, None] - before - term) * np.uint64(_INVERSE)  # what follows moves up by one place
    # deleting any of equal neighbours gives the same word: the first of them is enough
    some = np.concatenate([np.ones((rows, 1), dtype=bool), codes[:, 1:] != codes[:, :-1]], axis=1)
    row, place = np.nonzero(some)
    yield row, before[row, place] + after[row, place]
    for more in range(1, symbols):
        row, place = np.nonzero(codes + more < symbols)
        yield row, whole[row] + np.uint64(more) * power[place]


def _by_length(words: pa.StringArray, symbols: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, codes) of reduced words (letters from A on) of one length each, of bounded size."""
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32, count=len(words) + 1, offset=4 * words.offset)
    data, lengths = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8), np.diff(offsets)
    for length in np.unique(lengths):
        places, step = np.flatnonzero(lengths == length), max(1, CHUNK // (int(length) * symbols + 1))
        for low in range(0, len(places), step):
            some = places[low:low + step]
            yield some, (data[offsets[some, None] + np.arange(length)] - 65).astype(np.int64)


def _variants(symbols: int):
    """Reduced words to the hashes of (own, variant)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, codes in _by_length(batch.column(0), symbols):
                own = hashes(codes)
                for row, variant in neighbourhood(codes, symbols):
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(own[row].view(np.int64)), pa.array(variant.view(np.int64))], names=["own", "variant"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = np.zeros(batch.num_rows, dtype=np.int64)
        for places, codes in _by_length(batch.column(2), 1):
            own[places] = hashes(codes).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["word", "n", "reduced", "own"])


def edited_once(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes b of a; in time proportional to their length."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # the common beginning, by halving
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return a[low + (len(a) == len(b)):] == b[low + 1:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        yield batch.filter(pa.array(list(map(edited_once, a, b)), pa.bool_()))


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, near, near_n), in both directions, for the words(word, n, reduced, own) that differ by exactly one inserted,
    deleted or replaced letter.

    The reduced forms of such words are equal or differ by one edit, so every pair is found: the one-edit neighbourhoods of the
    distinct reduced words are joined with the reduced vocabulary on hashes, the pairs of reduced words that meet are
    expanded to the words behind them, and those are verified by their own edit distance.  A hash that two reduced words
    share only adds candidates.
    """
    vocabulary = words.select("reduced", "own").distinct()
    made = vocabulary.select("reduced").mapInArrow(_variants(symbols), "own long, variant long")
    known = words.select(F.col("own").alias("variant")).distinct()
    meet = made.join(known, "variant").where("own <> variant")
    meet = meet.select(F.least("own", "variant").alias("own"), F.greatest("own", "variant").alias("variant")).distinct()
    meet = stored(meet.union(known.select(F.col("variant").alias("own"), "variant")), "reduced-pairs")
    a = words.select("own", "word", "n")
    b = words.select(F.col("own").alias("variant"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = meet.join(a, "own").join(b, "variant")
    same = F.col("own") == F.col("variant")
    pairs = pairs.where(~same | (F.col("word") < F.col("near"))).where(F.abs(F.length("word") - F.length("near")) <= 1)
    pairs = pairs.select("word", "n", "near", "near_n").mapInArrow(_verified, "word string, n long, near string, near_n long")
    both = pairs.select(F.explode(F.array(
        F.struct("word", "n", "near", "near_n"),
        F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p"))
    return both.select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms(word, form) followed to the last, by pointer jumping; every form is more frequent than its word,
    so there are no rings, and each round doubles the steps taken."""
    chains = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "chains")
    while not chains.where("moved").isEmpty():
        steps = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        done = stored(chains.select("word", "root").join(steps, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "chains")
        forget(chains)
        chains = done
    return chains.select("word", "root")


def group_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                   ratio: int = RATIO, typo: int = 0, symbols: int = SYMBOLS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of docs.

    Words are maximal runs of LETTERS and A-Z, with A-Z lower-cased, of at least min_chars letters and min_count occurrences.
    n_near words differ from a word by one edit; the most frequent of them (ties: the smallest in code-point order) is
    its form if it is at least `ratio` times as frequent, else form and form_n are null.  root follows the forms to the
    last; it is the word itself where it has none.  With typo > 0, runs whose crc32 with the id is divisible by it lose a
    letter first (a null id counts as empty).

    Texts are read whole; a null text holds no words, an empty table gives no rows.  Repeated rows count again.  Words of any
    length are handled in linear memory.  Other columns are ignored, whatever their names.  The number of candidates depends
    on the vocabulary, not on how often words occur; with larger vocabularies more symbols mean fewer false candidates
    and more hashes, and never another result.
    """
    digits = "".join(chr(65 + symbol_of(x, symbols)) for x in LETTERS)
    counted = word_counts(docs, text_col, id_col, min_chars, min_count, typo)
    reduced = counted.withColumn("reduced", F.translate("word", LETTERS, digits))
    words = stored(reduced.mapInArrow(_hashed, "word string, n long, reduced string, own long"), "words")
    near = near_words(words, symbols)
    best = near.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    frequent = -F.col("best.m") >= ratio * F.col("n")
    best = stored(best.select("word", "n_near", F.when(frequent, F.col("best.near")).alias("form"), F.when(frequent, -F.col("best.m")).alias("form_n")), "near")
    last = roots(best.where("form IS NOT NULL"))
    told = best.join(last, "word", "left")
    return words.select("word", "n").join(told, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))

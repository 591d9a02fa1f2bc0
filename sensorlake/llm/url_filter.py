"""URL filters by a bit-parallel wildcard automaton.

Glob rules are packed one after another into multiword Shift-And masks.  A rule of L literal items
takes L + 1 state bits; a wildcard is a self-loop on the state before it.  For each byte ``c`` of a
canonical URL every pattern moves at once::

    D = ((D << 1) & STEP[c]) | (D & LOOP[c])

The masks grow with the rules only, the work with the bytes of the URLs; there is no shuffle.
Globs: ``*`` is any run without ``/``, ``**`` any run, ``?`` one byte other than ``/``.

Edge cases: a null URL, or one without ``://``, has empty host and path and matches no rule unless a
glob matches the empty string; repeated rows are judged alike; columns that are not asked for are not
carried, so clashing names cannot disturb the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.kernels import _buffer

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STAR, DEEP, ONE = object(), object(), object()


def parse_glob(glob: str) -> list:
    """Literal bytes and wildcard marks of a glob."""
    items, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            items.append(DEEP)
            i += 2
            continue
        items += [STAR] if glob[i] == "*" else [ONE] if glob[i] == "?" else list(glob[i].encode())
        i += 1
    return items


@dataclass(frozen=True)
class UrlRule:
    """A verdict for a host with its subdomains, limited to paths that start with path; or for globs."""

    verdict: str
    host: str | None = None
    path: str = "/"
    globs: tuple[str, ...] = ()

    @property
    def name(self) -> str | None:
        return None if self.host is None else self.host + self.path

    def patterns(self) -> list[list]:
        if self.host is None:
            return [parse_glob(g) for g in self.globs]
        tail = [*(self.host + self.path).encode(), DEEP]
        return [tail, [STAR, ord("."), *tail]]


@dataclass
class Automaton:
    """All patterns of all rules in shared bit masks of 64-bit words."""

    n_words: int
    start: np.ndarray
    final: np.ndarray
    step: np.ndarray  # 256 x words
    loop: np.ndarray
    finals: list[tuple[int, int, int]] = field(default_factory=list)  # (word, bit, rule)

    @classmethod
    def compile(cls, patterns: Sequence[tuple[int, list]]) -> Automaton:
        size = sum(sum(x not in (STAR, DEEP) for x in items) + 1 for _, items in patterns)
        n = max(1, -(-size // 64))
        a = cls(n, *(np.zeros(s, dtype=np.uint64) for s in (n, n, (256, n), (256, n))))
        state = 0
        mark = lambda mask, s: np.bitwise_or.at(mask, (..., s // 64), np.uint64(1 << (s % 64)))
        not_slash = np.array([c for c in range(256) if c != ord("/")])
        for rule, items in patterns:
            mark(a.start, state)
            for x in items:
                if x is DEEP or x is STAR:
                    rows = np.arange(256) if x is DEEP else not_slash
                    a.loop[rows, state // 64] |= np.uint64(1 << (state % 64))
                else:
                    state += 1
                    a.step[not_slash if x is ONE else x, state // 64] |= np.uint64(1 << (state % 64))
            mark(a.final, state)
            a.finals.append((state // 64, state % 64, rule))
            state += 1
        return a

    def run(self, column: pa.Array) -> np.ndarray:
        """The states after the last byte of each string: strings x words."""
        raw, bounds = _buffer(column)
        lengths = np.diff(bounds)
        order = np.argsort(-lengths, kind="stable")
        begins, left = bounds[:-1][order], lengths[order]
        d = np.tile(self.start, (len(order), 1))
        one, top = np.uint64(1), np.uint64(63)
        for at in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -at, side="left"))  # strings longer than at
            c, now = raw[begins[:live] + at], d[:live]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            d[:live] = (moved & self.step[c]) | (now & self.loop[c])
        out = np.empty_like(d)
        out[order] = d
        return out


def split_url(url) -> tuple:
    """Host (A-Z lower-cased) and path columns of a URL column; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("__url")))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge_urls(df: DataFrame, rules: Iterable[UrlRule], id_col: str = "page_id", url_col: str = "url",
               fallback: Iterable[UrlRule] = (), default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, the longest fitting rule (null if none) and the verdict.

    rules name hosts and path prefixes, the longest wins; where none fits, the first fitting
    fallback rule decides, then default.
    """
    named, other = sorted(rules, key=lambda r: -len(r.name)), list(fallback)
    everything = [*named, *other]
    automaton = Automaton.compile([(i, items) for i, r in enumerate(everything) for items in r.patterns()])
    names, verdicts = [r.name for r in named] + [None] * len(other), [r.verdict for r in everything]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            states = automaton.run(batch.column("canonical"))
            best = np.full(len(states), len(everything))
            for word, bit, rule in automaton.finals:
                hit = (states[:, word] >> np.uint64(bit)) & np.uint64(1) > 0
                best[hit] = np.minimum(best[hit], rule)
            pick = lambda values: pa.array([values[i] for i in best], pa.string())
            columns = [batch.column(c) for c in ("id", "host", "path")]
            yield pa.RecordBatch.from_arrays([*columns, pick([*names, None]), pick([*verdicts, default])],
                                             names=[id_col, "host", "path", "rule", "verdict"])

    source = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("__url"))
    host, path = split_url(F.col("__url"))
    parts = source.select("id", host.alias("host"), path.alias("path"))
    parts = parts.withColumn("canonical", F.concat("host", "path"))
    kind = df.schema[id_col].dataType.simpleString()
    return parts.mapInArrow(judge, f"{id_col} {kind}, host string, path string, rule string, verdict string")

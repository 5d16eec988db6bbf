"""Periodic runs of words, by heavy and light lag counting.

A run is a stretch of consecutive words with smallest period q (words q apart are the same), of at least ``LEAST`` words and
two periods, that no word before or after it extends. Its words match those q further on in an island of as many
consecutive places as the run has words beyond q.

1. For every lag up to half of a text, the places where a word equals the one a lag further on are counted exactly. Words that
   occur so often that their pairs would outnumber the steps of a transform are heavy: the power spectra of their places are
   summed and transformed back once, which gives all their lags. The others are light: differences of their places, k-th
   neighbours at a time, counted for all texts of a batch together.
2. A run of period q has at least max(LEAST - q, q) matches at lag q, so lags with fewer are left out. Lags go in ascending order;
   the matches that a run found has at multiples of its period are taken off their counts, as they belong to no other run.
3. An island of max(LEAST - q, q) places or more holds one of the places that are so far apart. These are probed, and islands
   are followed from the probes that match. An island inside a run whose period divides the lag isn't primitive and is left out.

All of a text is looked at, whatever its length; one text is one task's work, in memory proportional to it. Words are runs
of bytes other than ASCII white space, compared as they are.

Defined results: a null or empty text, or one of white space, has no runs and collapses to an empty text; repeated rows are
judged each for itself; ids aren't looked at; an empty table gives no rows; other columns are kept, and columns named like the two
results are replaced.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12
RUNS = "array<struct<start:long,length:long,period:long>>"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_BATCH = 1 << 17  # words counted together; a longer text is counted alone
_OFTEN = 6_000  # pairs that a transform is worth at least
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _heavy(places: list[np.ndarray], n: int) -> np.ndarray:
    """Matches at each lag below n of the words with these places: one inverse transform of their summed power spectra."""
    size = 1 << (2 * n - 1).bit_length()
    power = np.zeros(size // 2 + 1)
    for at in places:
        signal = np.zeros(size)
        signal[at] = 1.0
        spectrum = np.fft.rfft(signal)
        power += spectrum.real**2 + spectrum.imag**2
    return np.rint(np.fft.irfft(power, size)[:n]).astype(np.int64)


def lag_counts(texts: list[np.ndarray]) -> list[np.ndarray]:
    """For each text, as numbers of its words: how many places match at lags 0 .. n // 2 (lag 0 is left at zero)."""
    lengths = np.array([len(w) for w in texts], np.int64)
    spans = lengths // 2 + 1
    off = np.concatenate([[0], np.cumsum(spans)])
    counts = np.zeros(off[-1], np.int64)
    tops = np.array([int(w.max()) + 1 if len(w) else 0 for w in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(tops)])
    owner = np.repeat(np.arange(len(texts)), lengths)
    group = np.concatenate([np.zeros(0, np.int64), *texts]) + base[owner]
    place = np.arange(len(group)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(group, kind="stable")
    group, place, owner = group[order], place[order], owner[order]
    often = np.bincount(group, minlength=base[-1]) if len(group) else np.zeros(0, np.int64)
    cost = np.maximum(lengths * np.log2(lengths + 2), _OFTEN)
    heavy = often.astype(float) ** 2 > cost[np.repeat(np.arange(len(texts)), tops)]
    for text in np.unique(owner[heavy[group]]):
        at = np.flatnonzero((owner == text) & heavy[group])
        cuts = np.flatnonzero(np.diff(group[at])) + 1
        found = _heavy(np.split(place[at], cuts), int(lengths[text]))
        counts[off[text] + 1 : off[text + 1]] += found[1 : spans[text]]
    light = ~heavy[group]
    group, place, owner = group[light], place[light], owner[light]
    k = 1
    while len(group) > k:
        same = np.flatnonzero(group[k:] == group[:-k])
        if not len(same):
            break
        lag = place[same + k] - place[same]
        near = lag < spans[owner[same]]
        counts += np.bincount(off[owner[same[near]]] + lag[near], minlength=len(counts))
        if k % 4 == 0:  # words with no further partner go
            size = np.bincount(group)
            stay = size[group] > k
            group, place, owner = group[stay], place[stay], owner[stay]
        k += 1
    return [counts[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]


def _reach(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading values of both are the same."""
    n, lo, step = min(len(a), len(b)), 0, 16
    while lo < n:
        hi = min(lo + step, n)
        differs = np.flatnonzero(a[lo:hi] != b[lo:hi])
        if len(differs):
            return lo + int(differs[0])
        lo, step = hi, step * 4
    return n


def _matching(first: np.ndarray, then: np.ndarray, probes: np.ndarray, steps: int, way: int) -> np.ndarray:
    """Probes that match on so many further places in one direction."""
    for step in range(1, steps + 1):
        at = probes + way * step
        inside = (at >= 0) & (at < len(first))
        probes, at = probes[inside], at[inside]
        probes = probes[first[at] == then[at]]
    return probes


def _islands(w: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """Longest stretches [start, end) of at least ``least`` places that match at the lag, in order."""
    first, then = w[:-lag], w[lag:]
    probes = np.arange(least - 1, len(first), least)
    probes = probes[first[probes] == then[probes]]
    if len(probes) > 8:  # an island that is long enough has half of its other places on one side of a probe
        steps = min(least // 2, 8)
        probes = np.union1d(_matching(first, then, probes, steps, 1), _matching(first, then, probes, steps, -1))
    end = 0
    for at in probes.tolist():
        if at < end:
            continue
        end = at + _reach(first[at:], then[at:])
        start = at + 1 - _reach(first[at::-1], then[at::-1])
        if end - start >= least:
            yield start, end


def find(w: np.ndarray, counts: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text with these lag counts, by start, then period."""
    lags = np.arange(len(counts))
    need = np.maximum(least - lags, lags)
    counts = counts.copy()
    by_period: dict[int, tuple[list[int], list[int]]] = {}
    for lag in (np.flatnonzero(counts[1:] >= need[1:]) + 1).tolist():
        if counts[lag] < need[lag]:
            continue
        for start, stop in _islands(w, lag, int(need[lag])):
            end = stop + lag
            inside = False
            for period, (starts, ends) in by_period.items():
                if period < lag and lag % period == 0:
                    at = bisect_right(starts, start) - 1
                    inside = inside or (at >= 0 and end <= ends[at])
            if inside:
                continue
            starts, ends = by_period.setdefault(lag, ([], []))
            starts.append(start)
            ends.append(end)
            multiples = np.arange(2 * lag, min(end - start, len(counts)), lag)
            counts[multiples] -= end - start - multiples
    return sorted(((s, e - s, p) for p, spans in by_period.items() for s, e in zip(*spans, strict=True)), key=lambda r: (r[0], r[2]))


def _numbered(text: bytes) -> tuple[list[bytes], np.ndarray]:
    words = _WORD.findall(text)
    known: dict[bytes, int] = {}
    return words, np.array([known.setdefault(x, len(known)) for x in words], np.int64)


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    """The words that no run contains after its first period, joined by one space."""
    if not found:
        return b" ".join(words).decode()
    kept = np.ones(len(words), bool)
    for start, length, period in found:
        kept[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(kept)]).decode()


def periodic(rows: DataFrame, text: str = "text", least: int = LEAST, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The rows without their text, with their runs (start, length, period; in words, by start, then period) and the collapsed text."""
    others = [c for c in rows.columns if c.lower() not in {text.lower(), runs.lower(), collapsed.lower()}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            lo = 0
            while lo < batch.num_rows:
                texts, total, hi = [], 0, lo
                while hi < batch.num_rows and (total < _BATCH or hi == lo):
                    texts.append(_numbered(values[hi].as_py() or b""))
                    total += len(texts[-1][0])
                    hi += 1
                found = [find(w, c, least) for (_, w), c in zip(texts, lag_counts([w for _, w in texts]), strict=True)]
                plain = [_collapsed(words, f) for (words, _), f in zip(texts, found, strict=True)]
                told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in f] for f in found]
                kept = [batch.column(i).slice(lo, hi - lo) for i in range(len(others))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(told, _RUNS), pa.array(plain, pa.string())], names=[*others, runs, collapsed])
                lo = hi

    kinds = ", ".join(f"`{c.replace('`', '``')}` {rows.schema[c].dataType.simpleString()}" for c in others)
    return rows.select(*others, text).mapInArrow(run, f"{kinds}, `{runs}` {RUNS}, `{collapsed}` string")

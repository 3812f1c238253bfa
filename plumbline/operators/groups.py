"""Robust models of groups that fit a task: rows are dealt by group, and a task makes and judges all models of whole groups at once.

The hypotheses, their rows and the choice among them are those of ``registration.robust_models``, so both ways give the
same models; here a row is exchanged once and nothing is exchanged for a hypothesis.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows of a group beyond which it is not one task's; rows that are looked at together
MOST_ROWS, SLICE = 1 << 14, 1 << 12

_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


@dataclass
class InTask:
    """``numbers`` of a row, and functions of arrays of them with a row a number.

    ``terms`` gives what is summed (rows, sums), ``error`` the errors under the model of each row (rows, size), not a number
    where a row cannot agree, and ``also`` a number of each group from (numbers, order, model of each row, which agree, first
    rows).  ``order`` names a column of whole numbers.
    """

    numbers: list[Column]
    terms: Callable[[np.ndarray], np.ndarray]
    error: Callable[[np.ndarray, np.ndarray], np.ndarray]
    size: int
    order: str
    also: Callable[..., np.ndarray] | None = None


def hashed(seed: np.ndarray, number: int) -> np.ndarray:
    """What ``xxhash64`` makes of an int after the columns whose hash is ``seed``."""
    with np.errstate(over="ignore"):
        h = seed + _P5 + np.uint64(4)
        h ^= np.uint64(number) * _P1
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _made(fit, sums: np.ndarray, size: int) -> np.ndarray:
    """The models of rows of sums, not a number where there is none."""
    out = np.full((len(sums), size), np.nan)
    known = np.flatnonzero(np.isfinite(sums).all(axis=1))
    if len(known):
        models = fit(sums[known])
        out[known] = np.where(np.isfinite(models).all(axis=1)[:, None], models, np.nan)
    return out


def _solved(x: np.ndarray, order: np.ndarray, seed: np.ndarray, first: np.ndarray, spec: InTask, fit, most_error: float, least: int, hypotheses: int, draw: int, refits: int):
    """Of groups that begin at rows ``first``: models (not a number where there is none), n, n_inliers, rms and ``also``."""
    n = np.diff(np.append(first, x.shape[1]))
    group = np.repeat(np.arange(len(n)), n)
    terms, h_all = spec.terms(x), hypotheses + 1
    of = n[group]
    places, cells = [np.arange(len(group))], [group * h_all]
    for h in range(1, h_all):
        low = (hashed(seed, h) & np.uint64((1 << 20) - 1)).astype(np.int64)
        at = np.flatnonzero((low * of < draw << 20) & (of > draw))
        places.append(at)
        cells.append(group[at] * h_all + h)
    places, cells = np.concatenate(places), np.concatenate(cells)
    by = np.argsort(cells, kind="stable")
    cells = cells[by]
    begin = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
    enough = np.diff(np.append(begin, len(cells))) >= least
    sums = np.add.reduceat(terms[places[by]], begin, axis=0)[enough]
    models = np.full((len(n) * h_all, spec.size), np.nan)
    models[cells[begin[enough]]] = _made(fit, sums, spec.size)
    models = models.reshape(len(n), h_all, spec.size)

    def told(model: np.ndarray):
        e = spec.error(model[group], x)
        inner = e <= most_error
        return inner, np.add.reduceat(inner.astype(np.int64), first), np.add.reduceat(np.where(inner, e * e, 0.0), first)

    most, least_q, now = np.full(len(n), -1), np.zeros(len(n)), np.full((len(n), spec.size), np.nan)
    for h in range(h_all):
        _, c, q = told(models[:, h])
        better = (c > most) | ((c == most) & (q < least_q))
        most, least_q = np.where(better, c, most), np.where(better, q, least_q)
        now = np.where(better[:, None], models[:, h], now)

    best, kept = np.full((len(n), spec.size), np.nan), (np.full(len(n), -1), np.zeros(len(n)))
    for turn in range(refits + 1):
        inner, c, q = told(now)
        rms = np.sqrt(q / np.maximum(c, 1))
        better = (c > kept[0]) | ((c == kept[0]) & (rms <= kept[1]))
        best, kept = np.where(better[:, None], now, best), (np.where(better, c, kept[0]), np.where(better, rms, kept[1]))
        if turn < refits:
            again = np.full((len(n), spec.size), np.nan)
            again[c >= least] = _made(fit, np.add.reduceat(np.where(inner[:, None], terms, 0.0), first, axis=0)[c >= least], spec.size)
            now = np.where(np.isfinite(again), again, now)
    also = np.zeros(len(n)) if spec.also is None else spec.also(x, order, best[group], told(best)[0], first)
    return best, n, kept[0], kept[1], also


def _changes(table: pa.Table, keys: int) -> np.ndarray:
    """The first rows of groups."""
    differs = np.zeros(table.num_rows, bool)
    differs[:1] = True
    for c in range(keys):
        v = table.column(c).to_numpy()
        differs[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(differs)


def models_in_tasks(rows: DataFrame, keys: list[str], identity: list[str], spec: InTask, fit, most_error: float, least: int, hypotheses: int, draw: int, refits: int) -> DataFrame:
    """keys, model, n, n_inliers, rms and also of every group with a model; rows that are equal count once.

    A group's rows meet in one task; ``rows`` has none of more than a task can hold.
    """
    held = [*dict.fromkeys([*keys, *identity, spec.order])]
    numbers = [f"_x{i}" for i in range(len(spec.numbers))]
    dealt = rows.select(*held, *(c.cast("double").alias(n) for c, n in zip(spec.numbers, numbers, strict=True))).repartition(*keys)
    dealt = dealt.distinct().sortWithinPartitions(*held)
    dealt = dealt.select(*keys, F.col(spec.order).cast("long").alias("_o"), F.xxhash64(*identity).alias("_h"), *numbers)
    k, size, options = len(keys), spec.size, (replace(spec, numbers=[]), fit, most_error, least, hypotheses, draw, refits)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[:k])

    def found(table: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        x = np.stack([table.column(c).to_numpy() for c in range(k + 2, table.num_columns)])
        with np.errstate(all="ignore"):
            models, n, inner, rms, also = _solved(x, table.column(k).to_numpy(), table.column(k + 1).to_numpy().view(np.uint64), first, *options)
        there = np.flatnonzero(np.isfinite(models[:, 0]))
        columns = {name: table.column(c).combine_chunks().take(pa.array(first[there])) for c, name in enumerate(keys)}
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(there) + 1) * size, pa.int32()), pa.array(models[there].reshape(-1)))
        rms = pa.array(rms[there], mask=inner[there] == 0)
        return pa.RecordBatch.from_pydict(columns | {"model": flat, "n": pa.array(n[there], pa.int64()), "n_inliers": pa.array(inner[there], pa.int64()), "rms": rms, "also": pa.array(also[there], from_pandas=True)})

    def whole(table: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Groups of about SLICE rows together."""
        at = 0
        while at < len(first):
            end = max(at + 1, int(np.searchsorted(first, first[at] + SLICE)))
            stop = first[end] if end < len(first) else table.num_rows
            yield found(table.slice(first[at], stop - first[at]), first[at:end] - first[at])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            rest.append(batch)
            if sum(b.num_rows for b in rest) < 4 * SLICE:
                continue
            table = pa.Table.from_batches(rest)
            first = _changes(table, k)
            if len(first) > 1:
                yield from whole(table.slice(0, first[-1]), first[:-1])
                rest = table.slice(first[-1]).combine_chunks().to_batches()
        if sum(b.num_rows for b in rest):
            table = pa.Table.from_batches(rest)
            yield from whole(table, _changes(table, k))

    return dealt.mapInArrow(run, f"{types}, model array<double>, n long, n_inliers long, rms double, also double")

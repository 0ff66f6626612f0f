"""Greedy packing of samples into batches of bounded token counts."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from hashlib import md5

import pandas as pd
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Limits:
    expected: int = 32_768  #: tokens with which a batch closes
    most_sample: int = 16_384
    most_batch: int = 36_864
    most_held: int = 50  #: samples that wait
    held_first: int = 16_384  #: below so many tokens a batch takes waiting samples before others


def pack(lengths: Mapping[str, Sequence[int]], weights: Mapping[str, float], mandatory: Sequence[str], limits: Limits, draw: Callable[[int], float]) -> list[tuple[str, int, int]]:
    """Group, place in its group and batch of each sample that isn't too long. lengths: of each group's samples, in order.

    A batch begins with a sample of each mandatory group that has any left. Then, while it is short, waiting samples come first; else a group
    is drawn by weight among those that aren't used up, and gives its next sample. One that doesn't fit waits if there is room to wait; if not, or
    if it has waited already, the batch closes and the sample stays first in line for the next. draw(k) is the k-th number of [0, 1).
    """
    out: list[tuple[str, int, int]] = []
    usable = {g: deque((i, n) for i, n in enumerate(x) if (n < limits.most_sample if g in mandatory else n <= limits.most_sample)) for g, x in lengths.items()}
    held: deque[tuple[str, int, int]] = deque()
    front: tuple[str, int, int] | None = None  # what a closed batch had no room for
    batch = filled = drawn = 0
    opened = False

    def put(group: str, i: int, n: int) -> None:
        nonlocal filled
        out.append((group, i, batch))
        filled += n

    def close() -> None:
        nonlocal batch, filled, opened
        batch, filled, opened = batch + 1, 0, False

    while front or held or any(usable.values()):
        if not opened:
            opened = True
            for g in mandatory:
                if usable.get(g):
                    put(g, *usable[g].popleft())
        if filled >= limits.expected:
            close()
            continue
        left = [g for g in usable if usable[g]]
        waited = front is not None or (bool(held) and (filled < limits.held_first or not left))
        if front:
            (g, i, n), front = front, None
        elif waited:
            g, i, n = held.popleft()
        elif left:
            total = sum(weights.get(g, 1.0) for g in left)
            u, drawn = draw(drawn) * total, drawn + 1
            for g in left:
                u -= weights.get(g, 1.0)
                if u < 0:
                    break
            i, n = usable[g].popleft()
        else:
            break
        if filled + n <= limits.most_batch:
            put(g, i, n)
            if filled >= limits.expected:
                close()
        elif not waited and len(held) < limits.most_held:
            held.append((g, i, n))
        else:
            front = g, i, n
            close()
    return out


def pack_greedy(samples: DataFrame, worker: str, group: str, order: str, length: str, weights: Mapping[str, float], mandatory: Sequence[str], limits: Limits = Limits(), seed: int = 42) -> DataFrame:
    """worker, group, order, length and batch of each sample that fits: every worker packs its own samples, which should be a bounded number, each group's in order."""
    names = [worker, group, order, length]
    schema = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in names) + ", batch long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = {g: rows.sort_values(order, kind="stable") for g, rows in pdf.groupby(group, sort=True)}
        own = pdf[worker].iloc[0]
        draw = lambda k: int(md5(f"{seed}|{own}|{k}".encode()).hexdigest()[:8], 16) / 2**32
        placed = pack({g: rows[length].tolist() for g, rows in groups.items()}, weights, mandatory, limits, draw)
        parts = [groups[g].iloc[[i for h, i, _ in placed if h == g]].assign(batch=[b for h, _, b in placed if h == g]) for g in groups]
        return pd.concat(parts)[[*names, "batch"]]

    return samples.select(*names).dropna().groupBy(worker).applyInPandas(run, schema)

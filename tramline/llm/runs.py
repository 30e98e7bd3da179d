"""Helpers for Python operators that stream rows sorted by a bucket key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node reachable through the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0]
    return starts, np.diff(np.concatenate([starts, [len(keys)]]))


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Regroups sorted batches so that no run of equal first columns is split."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(0).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k, k[-1], side="left"))
        if k[0] == last and cut == 0:
            held.append(b)
            continue
        if cut or last is not None:
            whole = [*held, b.slice(0, cut)] if cut else held
            if whole:
                yield pa.Table.from_batches(whole).combine_chunks()
            held = []
        held.append(b.slice(cut))
        last = k[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, cid, own) -> (key, cid, n): members of buckets with two members or more, one of them at home, with a
    bucket's size. A bucket is scanned as it streams: all it holds are two numbers a member."""
    for t in whole_runs(batches):
        keys = t.column(0).to_numpy()
        starts, sizes = runs(keys)
        own = np.maximum.reduceat(t.column(2).to_numpy().astype(np.int8), starts)
        keep = np.repeat((sizes > 1) & (own > 0), sizes)
        n = np.repeat(sizes, sizes)[keep]
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(t.column(1).to_numpy()[keep]), pa.array(n, pa.int64())], names=["key", "cid", "n"])

"""Posterior language of each token, given its neighbours: forward-backward over one text's chain."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

FLOOR = 1e-4
BLOCK = 1 << 18  # tokens walked at once


def posteriors(emissions: np.ndarray, stay: float = 0.8) -> np.ndarray:
    """Rows are tokens of one chain, columns labels."""
    return chains(emissions, np.array([len(emissions)]), stay)


def chains(emissions: np.ndarray, sizes: np.ndarray, stay: float = 0.8) -> np.ndarray:
    """Posteriors of chains one behind the other, ``sizes`` tokens each; chains of about a length are walked side by
    side. Messages are rescaled at each step, so long texts don't underflow."""
    out = np.empty(emissions.shape)
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    share = np.cumsum(sizes[order]) // BLOCK
    for some in np.split(order, np.flatnonzero(np.diff(share)) + 1):
        if len(some):
            _walk(emissions, begins[some], sizes[some], stay, out)
    return out


def _walk(emissions: np.ndarray, begins: np.ndarray, sizes: np.ndarray, stay: float, out: np.ndarray) -> None:
    """Chains from the longest to the shortest, step by step: at each step, the chains that have it."""
    k = emissions.shape[1]
    leave = (1 - stay) / (k - 1)
    keep = stay - leave
    steps = int(sizes[0])
    width = len(sizes) - np.searchsorted(sizes[::-1], np.arange(steps), side="right")  # chains longer than the step
    off = np.cumsum(width) - width
    step = np.repeat(np.arange(steps), width)
    at = begins[np.arange(len(step)) - off[step]] + step  # by step, then chain: which token
    e = np.maximum(emissions[at].T, FLOOR)
    forward, backward = np.empty(e.shape), np.ones(e.shape)
    edges = [*off.tolist(), len(step)]
    now = forward[:, : edges[1]]
    np.divide(e[:, : edges[1]], e[:, : edges[1]].sum(axis=0), out=now)
    for i in range(1, steps):
        a, z = edges[i], edges[i + 1]
        before, now = now[:, : z - a], forward[:, a:z]
        np.multiply(e[:, a:z], keep * before + leave * before.sum(axis=0), out=now)
        now /= now.sum(axis=0)
    for i in range(steps - 2, -1, -1):
        a, z = edges[i + 1], edges[i + 2]
        seen = e[:, a:z] * backward[:, a:z]
        now = backward[:, edges[i] : edges[i] + z - a]
        np.add(keep * seen, leave * seen.sum(axis=0), out=now)
        now /= now.sum(axis=0)
    forward *= backward
    forward /= forward.sum(axis=0)
    out[at] = forward.T


def decoder(stay: float = 0.8):
    """A UDF from a text's emissions to its posteriors, both array<array<double>>; Arrow moves whole batches.

    A token with an empty emission is passed over: it stays empty, and its neighbours are neighbours.
    """

    @F.arrow_udf("array<array<double>>")
    def run(chains_: pa.Array) -> pa.Array:
        tokens = chains_.flatten()
        sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(chains_), 0).to_numpy(zero_copy_only=False))
        full = np.concatenate([[0], np.cumsum(sizes > 0)])
        values = tokens.flatten().to_numpy(zero_copy_only=False)
        if len(values):
            values = chains(values.reshape(full[-1], -1), np.diff(full[np.concatenate([[0], ends])]), stay).ravel()
        inner = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.float64()))
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), inner)

    return run

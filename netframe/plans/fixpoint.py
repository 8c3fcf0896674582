"""Driver-side loops over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row

from .storage import materialize


def iterate(state: DataFrame, step: Callable[[DataFrame, Row | None, int], DataFrame], watch: Callable[[], list[Column]] | None, done: Callable[[Row, int], bool] | None, rounds: int, cut_every: int = 4) -> tuple[DataFrame, Row | None, int]:
    """Apply step until done or for `rounds` rounds: (state, last watched row, rounds run).

    A round's state is cached and what is watched is one aggregate over it, so a round is one job.
    Every cut_every rounds, and at the end, the state is written to the shared folder; a
    lost executor costs the rounds since then at most.
    """
    seen, made, cached = None, 0, []
    for k in range(rounds):
        state = step(state, seen, k)
        made += 1
        if watch is not None or made % cut_every == 0:
            if made % cut_every == 0:
                state = materialize(state, "round")
                for c in cached:
                    c.unpersist()
                cached = []
            else:
                state = state.persist()
                cached.append(state)
        if watch is not None:
            seen = state.agg(*watch()).first()
            if done is not None and done(seen, made):
                break
    if made and made % cut_every:
        state = materialize(state, "round")
    for c in cached:
        c.unpersist()
    return state, seen, made

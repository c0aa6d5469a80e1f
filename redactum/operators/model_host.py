"""Models held by a Python worker.

Worker functions are unpickled anew for every task; what an imported module
holds stays as long as the worker does.
"""

from __future__ import annotations

import traceback
from typing import Callable, Iterator

_MODELS: dict[str, Callable] = {}
#: tokens of the runs of one call of a model, more only if a single run has more
CALL_TOKENS = 20_000


def hosted(model_id: str, factory: Callable[[], Callable]) -> Callable:
    """The model ``model_id`` of this worker, made on first use."""
    if model_id not in _MODELS:
        _MODELS[model_id] = factory()
    return _MODELS[model_id]


def token_slices(batch, size: int = CALL_TOKENS, column: str = "words") -> Iterator:
    """A batch of runs(..., words) cut between runs into stretches of about ``size`` tokens."""
    import pyarrow.compute as pc

    start = held = 0
    for i, n in enumerate(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_pylist()):
        if held and held + n > size:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def _checked(model: Callable, runs: list[list[str]]) -> list:
    out = list(model(runs))
    sizes = [len(x) for x in out]
    if sizes != [len(r) for r in runs]:
        raise ValueError("the model must give one label for each word of each run")
    return out


def answers(model: Callable, runs: list[list[str]], isolate: bool) -> Iterator[tuple]:
    """(predictions, None) or (None, message and trace) of each run; one call for
    all if it goes well, else one for each."""
    try:
        yield from [(preds, None) for preds in _checked(model, runs)]
        return
    except Exception:
        if not isolate:
            raise
    for run in runs:
        try:
            yield _checked(model, [run])[0], None
        except Exception as e:  # the model's own, whatever it is
            yield None, f"{e}\n\n{traceback.format_exc()}"


def windows(run: int, words: list[str], window) -> Iterator[tuple]:
    """(run, offset, words) of a run, whole or cut into windows of (size, overlap) as by ``tokens.chunk_windows``."""
    if window is None:
        yield run, 0, words
        return
    size, overlap = window
    for at in range(0, len(words), size - overlap):
        yield run, at, words[at:at + size]


def calls(asked: Iterator[tuple], size: int = CALL_TOKENS) -> Iterator[list[tuple]]:
    """``windows`` in lists of about ``size`` tokens, a call of the model each."""
    held, n = [], 0
    for x in asked:
        if held and n + len(x[2]) > size:
            yield held
            held, n = [], 0
        held.append(x)
        n += len(x[2])
    if held:
        yield held


def best_of(answered: list[tuple], window) -> list[tuple]:
    """(token, label, confidence), labels other than ``O``, of a run from (offset, predictions)
    of its windows in order; a token that lies in several has the answer of the one where it
    is furthest from an edge, of equal ones the first."""
    if window is None:
        return [(i, label, conf) for _, preds in answered for i, (label, conf) in enumerate(preds) if label != "O"]
    best: dict[int, tuple] = {}
    for at, preds in answered:
        for off, pred in enumerate(preds):
            edge = min(off, window[0] - 1 - off)
            if at + off not in best or edge > best[at + off][0]:
                best[at + off] = (edge, *pred)
    return [(i, label, conf) for i, (_, label, conf) in best.items() if label != "O"]

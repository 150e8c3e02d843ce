"""Conformal bounds against a plain calibration over all origins from half of the series."""

import math

import numpy as np
import pytest

from tempora.functions import kernels as K


def _bounds(y, horizon, level, ahead):
    """Half widths by a loop over origins; ahead(origin) is the forecast from there."""
    errors = [[] for _ in range(horizon)]
    for origin in range(len(y) // 2, len(y)):
        for h, value in enumerate(ahead(origin)[: len(y) - origin]):
            errors[h].append(abs(y[origin + h] - value))
    ranked = [sorted(e) for e in errors]
    return np.maximum.accumulate([e[min(len(e), math.ceil((len(e) + 1) * level)) - 1] for e in ranked])


@pytest.mark.parametrize("level", [0.5, 0.9, 0.99])
def test_all_origins_count(level):
    rng = np.random.default_rng(11)
    # a calm tail: the last few origins say nothing of the errors before
    y = np.concatenate([rng.normal(0, 5, 260), rng.normal(0, 0.1, 60)])
    alpha = K.ses(y[:160], 1).parameters["alpha"]

    def smoothed(origin):
        state = y[0]
        for v in y[1:origin]:
            state += alpha * (v - state)
        return [state] * 5

    found = K.conformal(y, 5, level)
    assert np.allclose(found.upper - found.mean, _bounds(y, 5, level, smoothed))
    assert np.allclose(found.mean - found.lower, _bounds(y, 5, level, smoothed))

    other = K.conformal(y, 5, level, model="linear")
    assert np.allclose(other.upper - other.mean, _bounds(y, 5, level, lambda origin: K.linear(y[:origin], 5).mean))


def test_short_series():
    for n in (3, 4, 5, 6, 9):
        y = np.arange(n, dtype=float) ** 2
        found = K.conformal(y, 3)
        assert (found.lower < found.upper).all()
    with pytest.raises(ValueError):
        K.conformal(np.array([1.0, 2.0]), 3)

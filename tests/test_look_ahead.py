"""Products with what is alive taken for many documents together, against one document at a time."""

from collections import namedtuple

import numpy as np
import pytest

from tests.test_path_fold import made
from tidemark.operators import path_fold

Row = namedtuple("Row", path_fold._IN)


@pytest.mark.parametrize("seed", range(8))
def test_same_rows_as_one_by_one(monkeypatch, seed):
    config = path_fold.FoldConfig(market_wide=(1,), story_checks=7, event_checks=3, copies=40, window_hours=(9.0, 48.0)[seed % 2])
    rows = [Row("s", *r[1:7], np.nan if r[7] is None else r[7], *r[8:]) for r in made(seed, 600, 12, 0.1)]
    rows.sort(key=lambda r: (r.batch, r.at, r.seq))
    alone, together = path_fold.Fold(config), path_fold.Fold(config)
    monkeypatch.setattr(path_fold, "FEW", 3)
    monkeypatch.setattr(path_fold, "AHEAD", 50)
    blocks, multiplied = [], []
    look, near = path_fold.Live.look_ahead, path_fold.Live.near
    monkeypatch.setattr(path_fold.Live, "look_ahead", lambda self, v: blocks.append(len(v)) or look(self, v))
    got = together.take_all(rows)
    monkeypatch.setattr(path_fold.Live, "near", lambda self, v, bar, place=None: multiplied.append(place) or near(self, v, bar, place))
    for x, r in zip(got, rows, strict=True):
        y = alone.take(r)
        assert (x[:6], x[9:]) == (y[:6], y[9:])
        assert x[6:9] == pytest.approx(y[6:9], abs=1e-12)
    assert set(multiplied) == {None} and sum(blocks) > len(rows) / 2 > 4 * len(blocks)
    assert sum(x[9] for x in got) > 20

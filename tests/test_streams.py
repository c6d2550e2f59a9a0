"""State of streams, batch by batch."""

import pandas as pd

from recollect.streaming import sessions as S


class State:
    def __init__(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value = value


def step(state, rows, ttl=None):
    pdf = pd.DataFrame(rows, columns=["event_id", "sha256", "at"])
    return [tuple(r)[1:] for out in S._reserving(ttl)((7,), iter([pdf]), state) for r in out.itertuples(index=False)]


def test_numbers_are_given_once():
    state = State()
    assert step(state, [("a", "x", 0.0), ("b", "y", 0.0), ("a", "x", 0.0)]) == [("a", 1, "new"), ("b", 2, "new"), ("a", 1, "same")]
    assert step(state, [("b", "z", 1.0), ("c", "w", 1.0)]) == [("b", 2, "conflict"), ("c", 3, "new")]


def test_old_ids_are_forgotten_but_numbers_go_on():
    state = State()
    step(state, [("a", "x", 0.0), ("b", "y", 50.0)], 60)
    step(state, [("c", "w", 100.0)], 60)
    assert state.value[1] == ["b", "c"]
    assert step(state, [("a", "x", 101.0), ("b", "y", 101.0)], 60) == [("a", 4, "new"), ("b", 2, "same")]

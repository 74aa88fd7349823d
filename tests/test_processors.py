import pandas as pd

from inkweave.streaming.processors import AdaptiveDelay, ProgressChanges


class Counted:
    """A value state that counts its calls; every one is a way to the executor and back."""

    def __init__(self):
        self.value, self.calls = None, 0

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value


def rows(*states):
    return iter([pd.DataFrame({"ts": pd.Timestamp("2024-01-01"), "event_id": range(len(states)), "state": list(states), "meta": None})])


def test_progress_asks_its_state_once_and_writes_changes_only():
    processor, state = ProgressChanges(), Counted()
    processor.sent = state
    shown = [out["state"].tolist() for out in processor.handleInputRows((1,), rows("STARTED", "STARTED", "PROGRESS"), None)]
    assert shown == [["STARTED", "PROGRESS"]] and state.calls == 2
    assert list(processor.handleInputRows((1,), rows("PROGRESS"), None)) == [] and state.calls == 3
    shown = [out["state"].tolist() for out in processor.handleInputRows((1,), rows("SUCCESS", "PROGRESS"), None)]
    assert shown == [["SUCCESS"]] and state.calls == 5
    assert list(processor.handleInputRows((1,), rows("PENDING"), None)) == [] and state.calls == 6


def test_delay_asks_its_state_once():
    processor, state = AdaptiveDelay(), Counted()
    processor.pace = state
    frame = pd.DataFrame({"ts": pd.Timestamp("2024-01-01"), "event_id": [1, 2], "outcome": ["limited", "failed"]})
    assert next(processor.handleInputRows((1,), iter([frame]), None))["delay"].tolist() == [1.25, 1.5] and state.calls == 2
    assert next(processor.handleInputRows((1,), iter([frame]), None))["delay"].tolist() == [2.0, 2.25] and state.calls == 4

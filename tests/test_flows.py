import json

import pandas as pd

from citeloom.streaming import flows


class State:
    def __init__(self):
        self.exists, self.hasTimedOut, self.held, self.until = False, False, None, None

    @property
    def get(self):
        return self.held

    def getCurrentWatermarkMs(self):
        return 0

    def update(self, held):
        self.exists, self.held = True, held

    def setTimeoutTimestamp(self, until):
        self.until = until

    def remove(self):
        self.exists = False


def frame(*events):
    packed = [json.dumps({k: v for k, v in e.items() if v is not None}) for e in events]
    return pd.DataFrame({"request_id": "r", "event": packed, "received_at": pd.Timestamp("1970-01-01 00:00:01.5")})


def test_packed_events_are_folded_over_two_batches():
    state, fold = State(), flows._folder(1000)
    final = {"seq": 3, "type": "final", "text": None, "refused": False, "citation_ids": ["S2", "S1", "S2"]}
    first = frame(final, {"seq": 0, "type": "status", "citation_ids": []})
    assert list(fold(("r",), iter([first]), state)) == []
    assert state.until == 2500 and [e["seq"] for e in json.loads(state.held[0])] == [3, 0]
    rest = frame({"seq": 2, "type": "answer_delta", "text": 'b "\u00e9\n'}, {"seq": 1, "type": "answer_delta", "text": "a"})
    (out,) = fold(("r",), iter([rest]), state)
    assert not state.exists
    assert out.to_numpy().tolist() == [["r", 'ab "\u00e9\n', True, False, None, ["S2", "S1"], True]]

import numpy as np
import pyarrow as pa
from textloom.llm import common


class Frame:
    """A table whose mapInArrow hands out what would run in a worker."""

    schema = "text string"

    def mapInArrow(self, run, schema):
        return run


def test_a_task_gives_freed_memory_back_at_its_end(monkeypatch):
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    batches = [pa.RecordBatch.from_arrays([pa.array(["a", None, "b"])], ["text"])] * 3
    run = common.by_arrow(Frame(), lambda x: x, "text string")
    assert len(list(run(iter(batches)))) == 3 and len(done) == 1
    run = common.kept(Frame(), list, lambda state, texts: np.array([x == "b" for x in texts]))
    assert [b.num_rows for b in run(iter(batches))] == [1, 1, 1] and len(done) == 2
    half = run(iter(batches))
    next(half)
    half.close()  # a task that is stopped
    assert len(done) == 3


def test_freed_memory_leaves_the_process():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    some = [bytes(1000) for _ in range(200_000)]
    pin = some[::50]  # keeps the heap's end from going back by itself
    full = held()
    del some
    common.give_back()
    assert held() < full - (100 << 20) and len(pin) == 4000

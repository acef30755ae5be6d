"""What a task that packs texts holds."""

import tracemalloc

import pyarrow as pa

from quantloom.llm import substrings


def test_texts_of_a_batch_are_taken_out_a_few_at_a_time(monkeypatch):
    """A character beyond 16 bits makes a string four times as large as its bytes."""

    class Task:
        get = classmethod(lambda cls: cls)
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(substrings, "TaskContext", Task)
    texts = [f"{k} " + "word " * 4000 + "\U0001f600" for k in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(802)), pa.array([*texts, None, texts[0]])], ["doc_id", "text"])
    tracemalloc.start()
    try:
        ids, held, data = [], [], b""
        for b in substrings._packed(99, 12)(iter([batch])):
            ids, held, data = ids + b["ids"][0].as_py(), held + b["held"][0].as_py(), data + b["data"][0].as_py() if not data else data
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert ids == list(range(802)) and held == [*(len(t.encode()) for t in texts), 0, 0]
    assert data.startswith(texts[0].encode())
    assert peak < 40e6  # 16 MB of texts; 64 MB as strings

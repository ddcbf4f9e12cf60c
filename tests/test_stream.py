"""The stream's fold gives what the batch's fold gives."""

import json

from lectern.streaming import trace as Z


def test_stream_equals_batch(spark, tmp_path):
    events = [{"request_id": f"r{i % 2}", "subagent_id": f"s{i % 3}", "seq": i, "type": ("step", "thinking")[i % 2], "step": i % 4, **({"text": f"t{i}"} if i % 5 else {})} for i in range(60)]
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        (source / f"{n}.json").write_text("\n".join([json.dumps(e) for e in events[n::3]] + ['{"request_id": "abgebrochen']) + "\n")
    out = []
    q = Z.folded_stream(Z.read_trace(spark, f"file://{source}", 1)).writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).foreachBatch(lambda df, _: out.append(df.collect())).start()
    q.awaitTermination()
    last = {(r.request_id, r.subagent_id): tuple(r) for batch in out for r in batch}
    lines = spark.read.text(f"file://{source}")
    want = {(r.request_id, r.subagent_id): tuple(r) for r in Z.folded(Z.parsed(lines)).collect()}
    assert {k: v for k, v in last.items()} == {k: (v[0], v[1], v[2], v[3], v[4], v[5]) for k, v in want.items()}
    assert len(want) == 6

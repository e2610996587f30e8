"""Streams: a ledger whose chain is checked across micro-batches."""

import json

from plumbline.operators import ledger
from plumbline.streaming import windows


def write(folder, name, rows):
    fields = {n: 1 if t in ("int", "long") else "x" for n, t in ledger.FIELDS.items()}
    lines = [json.dumps(fields | {"cluster_id": c, "round_id": r, "previous_main_model_hash": p, "new_main_model_hash": h}) for c, r, p, h in rows]
    (folder / f"{name}.json").write_text("\n".join(lines) + "\n")


def test_broken_chain_over_batches(spark, tmp_path):
    """A link that breaks in a later micro-batch is found, as are late rounds; what follows a late record is checked against the chain."""
    folder, out, checkpoint = (tmp_path / n for n in ("ledger", "out", "checkpoint"))
    folder.mkdir()

    def run():
        stream = windows.broken_chain(windows.watch_ledger(spark, str(folder)))
        stream.writeStream.outputMode("append").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out), format="parquet").awaitTermination()
        return sorted((r.cluster_id, r.round_id, r.previous_main_model_hash, r.expected, r.reason) for r in spark.read.parquet(str(out)).collect())

    write(folder, "a", [(1, 2, "h1", "h2"), (1, 1, None, "h1"), (2, 1, None, "g1")])
    assert run() == []
    write(folder, "b", [(1, 3, "h2", "h3"), (2, 2, "wrong", "g2"), (2, 3, "g2", "g3"), (3, 1, "x", "k1")])
    second = [(2, 2, "wrong", "g1", "broken link"), (3, 1, "x", None, "broken link")]
    assert run() == second
    write(folder, "c", [(1, 2, "h1", "h9"), (2, 4, "g3", "g4"), (3, 2, "k1", "k2")])
    late = (1, 2, "h1", "h3", "late or repeated round")
    assert run() == sorted([*second, late])
    write(folder, "d", [(1, 4, "h3", "h4"), (2, 5, "g2", "g5")])
    assert run() == sorted([*second, late, (2, 5, "g2", "g4", "broken link")])

"""Steps of registered queries that must not hold, hash or shuffle more than they need."""

import pyarrow as pa
import pytest

from oracle import SF
from quillstone.plans import catalogue
from quillstone.plans.adapter import Adapted
from quillstone.streaming import source


@pytest.mark.parametrize("name", ["q_search_stored", "q_search_stored_hybrid"])
def test_a_stored_index_is_of_claims_without_statuses(spark, monkeypatch, name):
    """Its texts aren't shuffled to join statuses and counts, which it doesn't hold."""
    plans, write = [], catalogue.index.write_index
    monkeypatch.setattr(catalogue.index, "write_index", lambda table, folder: plans.append(table._jdf.queryExecution().optimizedPlan().toString()) or write(table, folder))
    assert catalogue.QUERIES[name](spark, SF).count() > 0
    assert len(plans) == 1 and "Join" not in plans[0]


def test_recall_hashes_chosen_texts_only(spark, monkeypatch):
    made, real = [], catalogue.packer.packs_of_budgets
    monkeypatch.setattr(catalogue.packer, "packs_of_budgets", lambda *a, **more: made.append(real(*a, **more)) or made[-1])
    catalogue.q_eval_recall(Adapted(spark, SF))
    plan = made[0]._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("ArrowEvalPython") < plan.index("LeftSemi")


def test_the_log_hands_on_few_bytes_at_once(tmp_path, monkeypatch):
    folder = tmp_path / "log" / "m0"
    folder.mkdir(parents=True)
    lines = [f"{k} " + "é" * (k % 50) for k in range(300)] + ["x" * 3000, "", "  ", "last"]
    (folder / "2024-01.jsonl").write_text("\n".join(lines) + "\ntorn")
    reader = source.LogReader(str(tmp_path))
    parts = reader.partitions({}, reader.latestOffset())
    for together in (1, 1000, 1 << 20):
        monkeypatch.setattr(source, "TOGETHER", together)
        batches = [b for p in parts for b in reader.read(p)]
        assert all(isinstance(b, pa.RecordBatch) and b.num_rows and b.column("value").nbytes < together + 3000 + 4 * (b.num_rows + 1) for b in batches)
        assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == [(x.strip(), "m0", "2024-01") for x in lines if x.strip()]
        assert (len(batches) > 1) == (together < 1 << 20)

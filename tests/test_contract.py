"""Every registered query that SQL can express against its SQL counterpart."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from contract import adapter
from contract.oracles import all_oracles
from contract.registry import all_queries
from tallybeam.sources import tables
from tests.compare import differences, duck
from tests.conftest import SF_DIR

NAMES = sorted(contract.oracle_sql())


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, connection, name):
    df = contract.queries()[name](spark, SF_DIR)
    assert differences(df, connection, contract.oracle_sql()[name]) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_all_telemetry_queries_have_sql():
    assert all_oracles().keys() == all_queries().keys()
    assert contract.oracle_sql().keys() <= contract.queries().keys()


@pytest.mark.parametrize("removed", [["tallybeam/llm", "tests/llm"], ["tallybeam/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_text_operators(tmp_path, removed):
    """The entry imports from a copy that lacks them, and has all telemetry queries."""
    root = Path(contract.__file__).parent
    skipped = {str(root / name) for name in [".git", *removed]}
    ignore = lambda folder, names: [n for n in names if f"{folder}/{n}" in skipped or n == "__pycache__"]
    copy = shutil.copytree(root, tmp_path / "copy", ignore=ignore)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    assert found.stdout.split()[-2:] == [str(len(all_queries()))] * 2


def test_batches_are_ingested_once_for_both_balances(spark, monkeypatch):
    """The ledger is balanced before and after compaction over the same log."""
    monkeypatch.setattr(adapter, "_PREPARED", {})
    ingested, ingest_batch = [], tables.ingest_batch
    monkeypatch.setattr(tables, "ingest_batch", lambda *args, **kwargs: (ingested.append(args[3]), ingest_batch(*args, **kwargs)))
    found = contract.queries()["m_batch_reconciliation"](spark, SF_DIR).collect()
    assert sorted((r.compacted, r.balanced, r.batches) for r in found) == [(False, True, 3), (True, True, 3)]
    assert ingested == ["batch-0", "batch-1", "batch-2"]


def test_batches_bring_messages_that_others_stored(spark, monkeypatch):
    """Copies of a message come in the batch of the first copy and in others, and the ledger counts both kinds."""
    monkeypatch.setattr(adapter, "_PREPARED", {})
    query = contract.queries()["m_batch_reconciliation"]
    loaded = {r.loaded for r in query(spark, SF_DIR).collect()}
    root = adapter._PREPARED[spark.sparkContext.applicationId, SF_DIR, "fates"]
    found = tables.read_fates(spark, root).agg(F.sum("redelivered"), F.sum("duplicates"), F.sum("messages")).first()
    assert found[0] > 0 and found[1] > 0
    assert found[2] == adapter.messages(spark, SF_DIR).count() == sum(rows.count() for rows in adapter.deliveries(spark, SF_DIR, 3))
    monkeypatch.setattr(adapter, "_PREPARED", {})
    monkeypatch.setattr(tables, "_drop_known", lambda *args, **kwargs: None)
    assert {r.loaded for r in query(spark, SF_DIR).collect() if not r.compacted} == {loaded.pop() + found[0]}

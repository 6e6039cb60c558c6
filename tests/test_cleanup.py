"""What queries leave behind in the shared folder: kept tables, and nothing else."""

import gc
import os
import time

import pytest

from textquarry.plans import registry
from textquarry.sources import store

SF = "/root/testdata/sf0.001"


def left(spark) -> list[str]:
    """Files in the shared folder that belong to no kept table, once Spark's cleaner had its time."""
    root = store.shared_folder(spark).removeprefix("file://")
    for _ in range(60):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        found = [os.path.join(d, f) for d, _, files in os.walk(root) for f in files if not os.path.relpath(d, root).startswith(("kept/", "pipeline-", "index-"))]
        if not found:
            break
        time.sleep(0.5)
    return found


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("names", [("jsonl_scan", "split_sink", "report_sink", "skip_processed"), ("topk_bm25", "hybrid_documents", "minhash_cross_dedup")])
def test_only_kept_tables_stay(spark, names):
    for name in names:
        registry.QUERIES[name](spark, SF).count()
    assert left(spark) == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_kept_tables_are_found_again(spark):
    """A second use of the indexes, vectors, signatures and prints builds nothing."""
    from textquarry.plans import base, training

    def use():
        base.index(spark, SF)
        base.index(spark, SF, tokenizer="words", part="body")
        base.encoded_docs(spark, SF)
        training.prints(spark, SF)

    kept = f"{store.shared_folder(spark).removeprefix('file://')}/kept"
    use()
    before = sorted(os.listdir(kept))
    use()
    assert sorted(os.listdir(kept)) == before

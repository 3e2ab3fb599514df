"""Queries over batches of four images whose last batch is not full."""

from __future__ import annotations

import pytest
from check import compare, connect

from rasterloom.plans import all_oracles, all_queries
from rasterloom.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", params=[497, 498])
def short(request, spark, tmp_path_factory):
    """The test tables with a last batch of one or two images, of the kind whose two masks should fit nothing."""
    folder = tmp_path_factory.mktemp("short")
    for table in TABLES:
        if table != "embeddings":
            (folder / f"{table}.parquet").symlink_to(f"{SF}/{table}.parquet")
    spark.read.parquet(f"{SF}/embeddings.parquet").where(f"vec_id < {request.param}").coalesce(1).write.parquet(str(folder / "embeddings"))
    part = next((folder / "embeddings").glob("*.parquet"))
    (folder / "embeddings.parquet").symlink_to(part)
    return str(folder)


@pytest.mark.parametrize("name", [
    "join5_image_mask_alignment", "join5_unfit_mask_batches", "ras19_smart_resize_batches", "ras19_smart_resize_batches_mask",
    "ras19_smart_resize_batches_rejects"])
def test_last_batch_is_not_full(spark, short, name):
    assert compare(all_queries()[name](spark, short), connect(short), all_oracles()[name]) == ""

import pytest

from inkweave.session import clear_stages, stage


def test_stages_are_cleared(spark):
    kept = stage(spark.range(5))
    assert kept.count() == 5
    clear_stages(spark)
    with pytest.raises(Exception, match="(?i)exist|not found|FILE_NOT"):
        spark.read.schema("id long").parquet(kept.inputFiles()[0].rsplit("/", 1)[0]).count()
    assert stage(spark.range(3)).count() == 3

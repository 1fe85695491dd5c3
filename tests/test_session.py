"""Session helpers."""

from pairjudge.session import checkpoint_dir


def test_checkpoint_dir_reads_session_setting(spark):
    d = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_dir(spark) == d


def test_local_session_has_library_defaults(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"

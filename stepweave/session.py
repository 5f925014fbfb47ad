"""Sessions with the settings that results depend on."""

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins; the cluster's own settings otherwise."""
    builder = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        builder = builder.master(master)
    return builder.config(map=conf).getOrCreate() if conf else builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's shared folder (spark.checkpoint.dir) for checkpoints; a local session without one gets a temporary folder, a cluster an error."""
    import re
    import tempfile

    if not spark.sparkContext.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="stepweave-"))

"""Session settings, lineage cuts and size-checked broadcasts."""

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS_MAX = 200_000


def session(master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are planned for."""
    b = SparkSession.builder.appName("rasterlab")
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # frames already hashed by image keep that layout in (image, y, x) joins
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
        # a group that gathers a frame is tens of megabytes: keep few at once, then sort
        "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it.

    Only a local master falls back to a folder of its own; on a cluster a
    machine-local folder would be lost with the executor that wrote it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a shared folder")
    root = tempfile.mkdtemp(prefix="rasterlab-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir() or root


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS_MAX) -> DataFrame:
    """Mark ``df`` for broadcast when a count shows at most ``rows`` rows.

    Beyond the bound the frame is returned unmarked, so Spark plans a shuffled
    join. The probe stops reading once the bound is passed.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df

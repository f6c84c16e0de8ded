"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings the library relies on; all of them can be set on a live session.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot join key even where the split costs one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shift_JIS and Windows-31J are outside Spark's default charset list.
    "spark.sql.legacy.javaCharsets": "true",
    # Undecodable bytes become U+FFFD, which is how undecodable files are found.
    "spark.sql.legacy.codingErrorAction": "true",
}

_local_scratch: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "cupboard", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder below the shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is used only for a local master with the setting unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if context.applicationId not in _local_scratch:
            _local_scratch[context.applicationId] = tempfile.mkdtemp(prefix="cupboard-")
        base = _local_scratch[context.applicationId]
    return f"{base.rstrip('/')}/cupboard-{uuid.uuid4().hex}"


def write_and_reload(df, path: str | None = None):
    """Cut lineage through a written table, so that a lost executor does not recompute the past."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    # Written once and read a few times: packed tighter than by default, in row groups that make a small task each.
    df.write.mode("overwrite").options(compression="zstd", **{"parquet.block.size": 32 << 20}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)

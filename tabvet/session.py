"""Session helpers: one place for the settings every job relies on."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tabvet") -> SparkSession:
    """Local session for tests and the bench. On a cluster, use the session
    the platform provides; nothing in the library depends on these values."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # Small advisory partitions keep all local cores busy on small
        # inputs; on a cluster keep the platform's (larger) setting.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4m")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting wins; a scratch folder is chosen only when it is
    unset (local tests).
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        # Only when nothing is configured and all tasks run in this process.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tabvet-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", configured)
        except Exception:  # noqa: BLE001 - static conf on some deployments
            pass
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    _DIRS[sc.applicationId] = configured
    return configured


_DIRS: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables."""
    base = _DIRS.get(spark.sparkContext.applicationId) or ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{os.getpid()}-{os.urandom(4).hex()}")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tabvet`` importable on executors (Python workers run the
    ``mapInPandas`` helpers of TreeSHAP and file sniffing). The package is
    zipped once per SparkContext into the shared checkpoint folder and added
    with ``addPyFile``."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    target = scratch_path(spark, "tabvet-py") + ".zip"
    local = target[len("file:"):] if target.startswith("file:") else target
    if "://" in local:
        # Remote shared storage: build locally, then let Spark distribute it.
        local = os.path.join(tempfile.mkdtemp(prefix="tabvet-zip-"), "tabvet.zip")
        target = local
    os.makedirs(os.path.dirname(local), exist_ok=True)
    with zipfile.ZipFile(local, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(target)
    _SHIPPED.add(app)

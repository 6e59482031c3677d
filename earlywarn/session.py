"""Session helpers: a local builder for tests/bench and the shared folder
used to cut lineage (``spark.checkpoint.dir``)."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def _memory_gb() -> int:
    return os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES") // (1 << 30)


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "earlywarn") -> SparkSession:
    """Session for tests and the benchmark on one machine (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", f"{max(1, min(16, _memory_gb() // 2 - 2))}g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    On a cluster the setting must be given; only a local master (tests,
    bench) gets a private folder when it is unset.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get(CHECKPOINT_KEY, None) or sc.getConf().get(CHECKPOINT_KEY, None)
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return sc.getCheckpointDir() or path
    if not sc.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} is not set; a shared folder is required on a cluster")
    path = tempfile.mkdtemp(prefix="earlywarn-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so
    that task functions may refer to its modules wherever it is installed on
    the driver."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="earlywarn-zip-"), "earlywarn_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                z.write(full, os.path.join("earlywarn", os.path.relpath(full, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for written intermediate tables."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{os.getpid()}-{next(_counter)}"


def _count():
    i = 0
    while True:
        i += 1
        yield i


_counter = _count()


def cluster_conf(input_bytes: int, target_partition_bytes: int = 256 << 20, executors: int = 1000, cores: int = 4) -> dict[str, str]:
    """Settings for a large run, from the size of the input.

    Shuffle partitions: enough for ~``target_partition_bytes`` per partition
    and at least 2 waves of tasks over all cores; AQE coalesces small ones,
    splits skewed join partitions and re-plans joins from runtime sizes.
    Scan splits use the same target so map tasks fit executor memory.
    """
    slots = executors * cores
    parts = max(2 * slots, -(-int(input_bytes) // int(target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.session.timeZone": "UTC",
    }

"""Session helpers for tests, the benchmark and local runs.

Library functions never create a session; they use the one their DataFrames belong to.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int | None = None,
                  app: str = "otgraph") -> SparkSession:
    """A local session configured the way the tests and the benchmark expect."""
    parts = shuffle_partitions or (os.cpu_count() if cpus == "*" else int(cpus)) or 8
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("OTGRAPH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def duration_ms(text: str) -> int:
    """Milliseconds of a duration as Spark writes them: "10 minutes", "1 hour 30 seconds"."""
    import re
    unit = {"millisecond": 1, "second": 1000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}
    found = re.findall(r"(\d+)\s*([a-z]+?)s?\b", text.lower())
    if not found or any(u not in unit for _, u in found):
        raise ValueError(f"not a duration: {text!r}")
    return sum(int(n) * unit[u] for n, u in found)


def materialize(df):
    """Reliable checkpoint of ``df`` into ``spark.checkpoint.dir`` computed once: the rows are
    persisted while the checkpoint files are written (an unpersisted checkpoint recomputes its
    input), then released. Lineage is cut; a lost executor re-reads the files."""
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = df.checkpoint(eager=True)
    finally:
        df.unpersist()
    return out


def ship_package(spark: SparkSession) -> None:
    """Make ``otgraph`` importable in the Python workers (the Arrow-batched folds import it):
    zip the package once per SparkContext into the checkpoint root and ``addPyFile`` it."""
    import zipfile

    import otgraph
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext here (Connect): ship with --py-files
        return
    if getattr(sc, "_otgraph_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(otgraph.__file__))
    root = ensure_checkpoint_dir(spark)
    target_dir = root[len("file:"):] if root.startswith("file:") else root
    zpath = os.path.join(target_dir, f"otgraph-{os.getpid()}.zip")
    if "://" in target_dir:                 # shared store: build locally, Spark serves the file
        zpath = os.path.join(tempfile.mkdtemp(prefix="otgraph-pkg-"), "otgraph.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for folder, _dirs, names in os.walk(pkg):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    sc._otgraph_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    On a cluster the setting must point at shared storage and is only read here. Only a local
    master without the setting (tests, the benchmark) gets a private scratch folder.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext (Connect): the setting is required
        if conf_dir:
            return conf_dir
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    conf_dir = conf_dir or sc.getConf().get("spark.checkpoint.dir", None)
    if conf_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="otgraph-ckpt-")
    sc.setCheckpointDir(path)
    return path

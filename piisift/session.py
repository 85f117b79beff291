"""SparkSession helpers.

On a cluster the session is given to us; we only fill in settings that are
unset.  ``spark.checkpoint.dir`` must name a shared folder on a cluster; a
scratch default is only taken when nothing is configured (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int | None = None,
                  app_name: str = "piisift") -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (SparkSession.builder.master(f"local[{cores}]").appName(app_name)
               .config("spark.driver.memory", os.environ.get("PIISIFT_DRIVER_MEMORY", "16g"))
               .config("spark.sql.shuffle.partitions",
                       str(shuffle_partitions or (os.cpu_count() if cores == "*" else cores)))
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a scratch one only if unset."""
    cp = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - no SparkContext access (e.g. Spark Connect)
        sc = None
    if not cp and sc is not None:
        cp = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    master = "" if sc is None else sc.master
    if not cp and sc is not None and not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not cp:  # nothing configured on one machine: a scratch folder, as in tests
        cp = tempfile.mkdtemp(prefix="piisift-cp-")
        spark.conf.set("spark.checkpoint.dir", cp)
    if sc is not None and sc.getCheckpointDir() is None:
        sc.setCheckpointDir(cp)
    return cp


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A folder under the shared checkpoint location (never machine-local on a cluster)."""
    root = ensure_checkpoint_dir(spark)
    return "/".join([root.rstrip("/"), *parts])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``piisift`` importable in the executors' Python workers.

    Functions run by ``mapInPandas`` refer to this package, so workers must
    import it.  When it is not installed on the cluster, a zip of the package
    is handed to ``SparkContext.addPyFile`` (as ``--py-files`` would), once
    per application.
    """
    import hashlib
    import io
    import zipfile

    if os.environ.get("PIISIFT_SHIP", "1") == "0":  # installed on the cluster already
        return
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # noqa: BLE001 - no SparkContext access (e.g. Spark Connect)
        return
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, dirs, files in os.walk(pkg):
            dirs[:] = sorted(d for d in dirs if d != "__pycache__")
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    data = buf.getvalue()
    name = f"piisift-{hashlib.sha1(data).hexdigest()[:12]}.zip"
    folder = ensure_checkpoint_dir(spark)
    if "://" in folder and not folder.startswith("file://"):
        folder = tempfile.gettempdir()  # the driver's file server distributes it
    folder = os.path.join(folder.replace("file://", "", 1).replace("file:", "", 1), "pyfiles")
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    if not os.path.exists(path):
        tmp = path + f".{os.getpid()}.part"
        with open(tmp, "wb") as fh:
            fh.write(data)
        os.replace(tmp, path)
    sc.addPyFile(path)
    _SHIPPED.add(app)

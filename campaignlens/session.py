"""Session setup, the shared folder for written intermediates, and their removal."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_local_dirs: dict[str, str] = {}
_shipped: set[str] = set()
_given: dict[str, list[str]] = {}  # paths handed out, by application
_places: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def get_spark(app: str = "campaignlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on, the UI off and UTC as time zone.

    On a cluster leave ``master`` unset and pass sizing through spark-submit.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, once per application; needless where it is installed on them."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="campaignlens-")) / "campaignlens.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the folder that every executor can reach.

    The folder is the one the session names in ``spark.checkpoint.dir``. Only a
    local session without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        app = context.applicationId
        if app not in _local_dirs:
            _local_dirs[app] = tempfile.mkdtemp(prefix="campaignlens-")
        base = _local_dirs[app]
    path = f"{base.rstrip('/')}/campaignlens/{name}-{uuid.uuid4().hex}"
    _given.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back.

    For a table that several later steps read: they scan the files instead of
    running its whole plan again, and a lost executor costs nothing of it. The
    table stays until :func:`discard`, :func:`scratch` or :func:`release`.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[table] = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(table: DataFrame) -> None:
    """Removes a table that :func:`written` made, when no plan reads it any more."""
    path = _places.pop(table, None)
    if path is not None:
        _remove(table.sparkSession, path)
        _given[table.sparkSession.sparkContext.applicationId].remove(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end all intermediates written inside it; results must be stored or collected by then."""
    paths = _given.setdefault(spark.sparkContext.applicationId, [])
    before = len(paths)
    try:
        yield
    finally:
        for path in paths[before:]:
            _remove(spark, path)
        del paths[before:]


def release(spark: SparkSession) -> None:
    """Removes all intermediates that this application has written."""
    for path in _given.pop(spark.sparkContext.applicationId, []):
        _remove(spark, path)

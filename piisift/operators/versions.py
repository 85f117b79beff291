"""Tables that change as a whole: folders written beside the old ones, and a manifest that names the current ones.

A manifest is a small JSON file ``_manifests/<number>``.  It is written under another name and renamed without
overwriting, so of two writers that started from the same state one fails and starts anew, and a reader sees the state
before or after a change, never a mixture.  Old folders stay until :func:`expire`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer changed the table first."""


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, place.getFileSystem(conf), place


def _numbers(spark: SparkSession, base: str) -> list[int]:
    _jvm, fs, place = _hadoop(spark, f"{base}/_manifests")
    if not fs.exists(place):
        return []
    return sorted(int(n) for n in (f.getPath().getName() for f in fs.listStatus(place)) if n.isdigit())


def current(spark: SparkSession, base: str) -> tuple[int, dict]:
    """(number, content) of the newest manifest; (0, {}) when there is none."""
    numbers = _numbers(spark, base)
    if not numbers:
        return 0, {}
    return numbers[-1], content(spark, base, numbers[-1])


def content(spark: SparkSession, base: str, number: int) -> dict:
    jvm, fs, place = _hadoop(spark, f"{base}/_manifests/{number:012d}")
    stream = fs.open(place)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, base: str, after: int, state: dict) -> int:
    """Make ``state`` the content that follows manifest ``after``; :class:`Conflict` if another one does."""
    jvm, fs, _place = _hadoop(spark, base)
    path = jvm.org.apache.hadoop.fs.Path
    folder = path(f"{base}/_manifests")
    fs.mkdirs(folder)
    draft, final = path(folder, f"draft-{uuid.uuid4().hex}"), path(folder, f"{after + 1:012d}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
    out.close()
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri() if folder.toUri().getScheme() else fs.getUri(),
                                                               spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(draft, final, no_options)
    except Exception as exc:  # noqa: BLE001 - py4j wraps the store's own error
        if _numbers(spark, base)[-1:] > [after]:
            raise Conflict(f"{base} was changed by another writer after state {after}") from exc
        raise
    return after + 1


def expire(spark: SparkSession, base: str, folders: list[str], keep: int = 2) -> None:
    """Delete those of the given folders that none of the last ``keep`` manifests names."""
    used = json.dumps([content(spark, base, n) for n in _numbers(spark, base)[-keep:]])
    for folder in folders:
        if folder not in used:
            _jvm, fs, place = _hadoop(spark, folder)
            fs.delete(place, True)

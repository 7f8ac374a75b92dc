"""Tables that are replaced as a whole while others read them, and the settings of searches kept in one.

A table is a folder of versions. A version is written beside the others, and readers take the newest that its writer has finished (Spark's
_SUCCESS file), so that no reader meets an empty or half table, whoever writes at the time. Of two writers the later one's version counts.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession

from ..plans.options import FETCH_MODES, SearchSettings

#: Versions that are kept, for readers that began before the newest was written.
KEPT_VERSIONS = 20
_DONE = "_SUCCESS"


def _files(spark: SparkSession, path: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def versions(spark: SparkSession, path: str) -> list[str]:
    """The finished versions of a table, oldest first."""
    files, root = _files(spark, path)
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, f"v-*/{_DONE}"))
    return sorted(f.getPath().getParent().toString() for f in found or [])


def write_version(table: DataFrame, path: str) -> None:
    """Replace what readers of path see by table. table may itself be read from path."""
    spark = table.sparkSession
    table.write.json(f"{path}/v-{time.time_ns():020d}-{uuid.uuid4().hex}")
    files, _ = _files(spark, path)
    for old in versions(spark, path)[:-KEPT_VERSIONS]:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(old), True)


def read_version(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest finished version of a table; no rows where there is none."""
    known = versions(spark, path)
    return spark.read.schema(schema).json(known[-1]) if known else spark.createDataFrame([], schema)


#: Fields of a settings file and what they are called here.
FILE_NAMES = {
    "maxResults": "max_results", "maxPages": "max_pages", "limit": "limit", "fetchMode": "fetch_mode", "browserHumanInLoop": "human_in_loop", "ai": "verdicts",
    "save": "save", "sources": "sources", "condition": "condition", "minPrice": "min_price", "maxPrice": "max_price",
}
DEFAULTS = replace(SearchSettings(), save=True)


def _fitting(name: str, value: object) -> object:
    """value as the setting of that name, else the default. A file's types are strict: only true and false are flags, only texts are texts."""
    default = getattr(DEFAULTS, name)
    if name in ("sources", "condition", "fetch_mode"):
        text = value if isinstance(value, str) else ""
        return text.strip() if name == "sources" else text if text in (FETCH_MODES if name == "fetch_mode" else ("new", "used")) else default
    if isinstance(default, bool):
        return value if isinstance(value, bool) else default
    try:
        number = float(value) if isinstance(value, (int, float, str)) else 0.0
    except ValueError:
        number = 0.0
    if not 0 < number < float("inf"):
        return default
    return number if default is None else int(number) if number.is_integer() else default


def settings_of(given: object) -> SearchSettings:
    """Settings from a parsed file; what is missing or doesn't fit is the default, and so is all of what isn't an object."""
    given = given if isinstance(given, Mapping) else {}
    return SearchSettings(**{ours: _fitting(ours, given.get(theirs)) for theirs, ours in FILE_NAMES.items()})


def write_settings(spark: SparkSession, path: str, given: object) -> SearchSettings:
    """Write settings, made to fit, in place of those there."""
    fit = settings_of(given)
    named = {theirs: asdict(fit)[ours] for theirs, ours in FILE_NAMES.items()} | {"condition": "" if fit.condition == "any" else fit.condition}
    write_version(spark.createDataFrame([(json.dumps(named, ensure_ascii=False),)], "settings string"), path)
    return fit


def read_settings(spark: SparkSession, path: str) -> SearchSettings:
    """The settings as they were last written; the defaults, which are written, where there are none."""
    found = read_version(spark, path, "settings string").first()
    return write_settings(spark, path, {}) if found is None else settings_of(json.loads(found["settings"]))

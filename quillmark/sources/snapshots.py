"""Tables kept as snapshots: a commit appears whole or not at all, and writers that meet try again.

Data lie in folders that never change. A version is a small file that lists them; the highest version is the table.
Whoever publishes the next number first has committed; another writer reads the new state and tries the number after it.
Readers hold the folders of the version that they began with.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class SnapshotConflict(RuntimeError):
    """Other writers were faster each time."""


def _files(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _versions(spark: SparkSession, path: str) -> list[int]:
    files, folder = _files(spark, f"{path}/_versions")
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    files, at = _files(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def _publish(spark: SparkSession, source: str, target: str) -> bool:
    """Give a written file its final name; False if there is one of that name already."""
    files, at = _files(spark, source)
    if files.getUri().getScheme() == "file":
        local = lambda p: _files(spark, p)[1].toUri().getPath()
        try:
            os.link(local(source), local(target))
        except FileExistsError:
            return False
        os.unlink(local(source))
        return True
    jvm = spark._jvm
    kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    never = jvm.java.lang.reflect.Array.newInstance(kind, 1)
    jvm.java.lang.reflect.Array.set(never, 0, jvm.java.lang.Enum.valueOf(kind, "NONE"))
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(at, _files(spark, target)[1], never)
    except Exception as error:
        if "FileAlreadyExists" in str(error):
            return False
        raise
    return True


def _state(spark: SparkSession, path: str, version: int | None = None) -> dict:
    known = _versions(spark, path)
    if not known or version is not None and version not in known:
        return {"version": 0, "folders": [], "schema": None}
    version = known[-1] if version is None else version
    return {"version": version, **json.loads(_read_text(spark, f"{path}/_versions/{version:020d}.json"))}


def _table(spark: SparkSession, path: str, state: dict) -> DataFrame | None:
    if not state["folders"]:
        return None
    schema = StructType.fromJson(state["schema"])
    tables = [spark.read.schema(schema).parquet(f"{path}/{f}") for f in state["folders"]]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.select(schema.names)


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The table as last committed, or as of a version; None where nothing has been committed."""
    return _table(spark, path, _state(spark, path, version))


def history(spark: SparkSession, path: str) -> list[int]:
    return _versions(spark, path)


def _commit(spark: SparkSession, path: str, make: Callable[[dict], dict | None], attempts: int) -> int:
    """Publish what ``make`` makes of the current state, again and again until nobody was faster."""
    files, folder = _files(spark, f"{path}/_versions")
    files.mkdirs(folder)
    for _ in range(attempts):
        state = _state(spark, path)
        new = make(state)
        if new is None:
            return state["version"]
        draft = f"{path}/_versions/.draft-{uuid.uuid4().hex}"
        _write_text(spark, draft, json.dumps({"folders": new["folders"], "schema": new["schema"]}))
        if _publish(spark, draft, f"{path}/_versions/{state['version'] + 1:020d}.json"):
            return state["version"] + 1
        files.delete(_files(spark, draft)[1], False)
    raise SnapshotConflict(f"{attempts} attempts to commit to {path} met faster writers")


def _write(df: DataFrame, path: str, by: list[str] | None) -> str:
    name = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{name}", partitionBy=by)
    return name


def append_snapshot(df: DataFrame, path: str, by: list[str] | None = None, attempts: int = 20) -> int:
    """Add rows; they are written once, however many commits come in between. Gives the version."""
    spark = df.sparkSession
    folder, schema = _write(df, path, by), json.loads(df.schema.json())

    def make(state: dict) -> dict:
        if state["schema"] is not None and [(f["name"], f["type"]) for f in state["schema"]["fields"]] != [(f["name"], f["type"]) for f in schema["fields"]]:
            raise ValueError("the table has other columns")
        return {"folders": [*state["folders"], folder], "schema": state["schema"] or schema}

    return _commit(spark, path, make, attempts)


def update_snapshot(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame | None], by: list[str] | None = None, attempts: int = 20) -> int:
    """Replace the table by what ``change`` makes of it; if another commit comes in between, by what it makes of that.

    ``change`` gets None where nothing has been committed, and gives None to leave the table as it is.
    """
    files, _ = _files(spark, path)
    made: list[str] = []

    def make(state: dict) -> dict | None:
        if made:  # nobody has seen it
            files.delete(_files(spark, f"{path}/{made.pop()}")[1], True)
        new = change(_table(spark, path, state))
        if new is None:
            return None
        made.append(_write(new, path, by))
        return {"folders": [made[0]], "schema": json.loads(new.schema.json())}

    return _commit(spark, path, make, attempts)


def compact(spark: SparkSession, path: str, parts: int | None = None, by: list[str] | None = None, attempts: int = 20) -> int:
    """Rewrite all folders as one of ``parts`` files. Rows that others append meanwhile stay; if others replace the table,
    nothing is done."""
    state = _state(spark, path)
    table = _table(spark, path, state)
    if table is None or len(state["folders"]) < 2:
        return state["version"]
    folder = _write(table.coalesce(parts) if parts else table, path, by)

    def make(now: dict) -> dict | None:
        if now["folders"][: len(state["folders"])] != state["folders"]:
            return None
        return {"folders": [folder, *now["folders"][len(state["folders"]) :]], "schema": now["schema"]}

    return _commit(spark, path, make, attempts)


def forget(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete versions before the last ``keep`` and folders that none of these lists; say how many folders went.

    Not while others read old versions or are about to commit.
    """
    files, root = _files(spark, path)
    known = _versions(spark, path)
    used = {f for v in known[-keep:] for f in _state(spark, path, v)["folders"]}
    for version in known[:-keep]:
        files.delete(_files(spark, f"{path}/_versions/{version:020d}.json")[1], False)
    gone = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("data-") and s.getPath().getName() not in used]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)

"""Files that tasks write: temporary names, a manifest, and a commit by renaming."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder, given as a path or a URI."""
    if folder.startswith("file:") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)


def temporary(name: str) -> str:
    """A name no other attempt at the same file uses."""
    return f"_temporary/{name}.{uuid.uuid4().hex}"


def prepare(folder: str) -> None:
    store, root = opened(folder)
    store.create_dir(f"{root}/_temporary", recursive=True)


#: Files that one task of a commit renames.
RENAMED_PER_TASK = 50


def _renamed(folder: str):
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        for batch in batches:
            for temporary_name, name in zip(batch["temporary"].to_pylist(), batch["name"].to_pylist(), strict=True):
                try:
                    store.move(f"{root}/{temporary_name}", f"{root}/{name}")
                except FileNotFoundError:
                    # A lost attempt of this task may have come this far.
                    if store.get_file_info(f"{root}/{name}").type != fs.FileType.File:
                        raise
            yield batch.select(["name"])

    return rename


def commit(spark: SparkSession, folder: str, files: list[dict]) -> None:
    """Give the files of successful attempts their final names, in tasks, then write the manifest.

    Readers go by the manifest alone, so a job that dies before this line has
    left nothing that counts, and leftovers of lost attempts go unread.
    """
    store, root = opened(folder)
    if files:
        names = spark.createDataFrame([(f["temporary"], f["name"]) for f in files], "temporary string, name string")
        done = names.repartition(-(-len(files) // RENAMED_PER_TASK)).mapInArrow(_renamed(folder), "name string").count()
        if done != len(files):
            raise RuntimeError(f"{done} of {len(files)} files were renamed in {folder}")
    store.delete_dir(f"{root}/_temporary")
    manifest = [{k: v for k, v in f.items() if k != "temporary"} for f in sorted(files, key=lambda f: f["name"])]
    with store.open_output_stream(f"{root}/_manifest.tmp") as out:
        out.write(json.dumps({"version": 1, "files": manifest}).encode())
    store.move(f"{root}/_manifest.tmp", f"{root}/manifest.json")


def manifest(folder: str) -> list[dict]:
    store, root = opened(folder)
    with store.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())["files"]

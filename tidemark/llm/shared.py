"""The folder that the driver and all executors share, and tables written to it to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The URI of a new folder under ``spark.checkpoint.dir``.

    The setting is read from the session.  Only where it is unset, as in tests on one machine, a
    temporary folder is made and set.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        ensure_checkpoints(spark)
        base = spark.sparkContext.getCheckpointDir()
    if "://" not in base:
        base = "file://" + (base[5:] if base.startswith("file:") else base)
    return f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder, without replacing one that the cluster names."""
    if not spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidemark-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared checkpoint folder: later steps don't recompute them."""
    ensure_checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a compressed Parquet table in the shared folder, for wide or binary rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fs_and_path(uri: str):
    """(pyarrow file system, path) of a URI, on the driver or on an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def publish(uri: str, data: bytes | memoryview) -> None:
    """Write one file at ``uri`` in one step: attempts of a task that run twice leave one whole file."""
    from pyarrow import fs

    store, path = fs_and_path(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as out:
        out.write(data)
    try:
        store.move(own, path)
    except OSError:  # a store that doesn't replace: another attempt has written the same bytes
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise
        store.delete_file(own)


def mapped(uri: str):
    """A read-only uint8 array over the file at ``uri``, memory-mapped.

    A file of a local (or locally mounted) store is mapped in place; any other is fetched once into
    the process's temporary folder, mapped, and unlinked at once, so nothing stays behind.
    """
    import os

    import numpy as np
    from pyarrow import fs

    store, path = fs_and_path(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with tempfile.NamedTemporaryFile(delete=False) as out, store.open_input_stream(path) as src:
        while part := src.read(1 << 22):
            out.write(part)
    try:
        return np.memmap(out.name, np.uint8, "r") if os.path.getsize(out.name) else np.zeros(0, np.uint8)
    finally:
        os.unlink(out.name)


def packed(*arrays) -> bytes:
    """Arrays as one blob: how many, their bytes, and one after another."""
    import numpy as np

    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64)
    return b"".join([head.tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpacked(blob):
    """The byte arrays of a blob, which is a uint8 array; nothing is copied."""
    import numpy as np

    n = int(blob[:8].view(np.int64)[0])
    out, at = [], 8 + 8 * n
    for s in blob[8 : 8 + 8 * n].view(np.int64).tolist():
        out.append(blob[at : at + s])
        at += s
    return out


def text_column(docs: DataFrame, name: str = "text"):
    """The text column, null as empty."""
    from pyspark.sql import functions as F

    return F.coalesce(docs[name].cast("string"), F.lit(""))


_claims: dict = {}


def claim(name: str, clear=None) -> None:
    """Say that this Python worker now runs an operator: what others have cached in it goes.

    ``clear`` empties the operator's own caches when another one's turn comes.
    """
    import gc

    others = [k for k in _claims if k != name]
    for k in others:
        if (drop := _claims.pop(k)) is not None:
            drop()
    if others:
        gc.collect()
    _claims[name] = clear

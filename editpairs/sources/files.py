"""Files that executors list, open and write themselves, through pyarrow's file systems.

Paths are a column like any other: no list of them passes the driver, and what is read is decoded in the task
that asked for it. Paths without a scheme are local ones, as are those of `file:`.
"""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editpairs.functions import pixels as P
from editpairs.functions import png
from editpairs.schema import IMAGE
from editpairs.sources.shared import written


def store_of(path: str):
    """(file system, the path in it)"""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def opened(path: str):
    """A stream of a file's content; null if there is no such file."""
    store, name = store_of(path)
    try:
        return store.open_input_stream(name)
    except (FileNotFoundError, NotADirectoryError):
        return None
    except OSError:
        if store.get_file_info(name).is_file:
            raise
        return None


def read_bytes(path: str) -> bytes | None:
    """A file's content; null if there is none."""
    with opened(path) or contextlib.nullcontext() as f:
        return None if f is None else f.read()


def put(store, at: str, data: bytes) -> None:
    """Write a file, and its folder where there is none yet."""
    try:
        file = store.open_output_stream(at)
    except FileNotFoundError:
        store.create_dir(at.rpartition("/")[0], recursive=True)
        file = store.open_output_stream(at)
    with file:
        file.write(data)


def named_too(source: str, at: str) -> bool:
    """Make `at` one more name of a local file; False where the disk has no such links, or no more of this file."""
    try:
        try:
            os.link(source, at)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(at), exist_ok=True)
            os.link(source, at)
        except FileExistsError:
            os.remove(at)
            os.link(source, at)
    except OSError:
        return False
    return True


#: Contents of which a task remembers where it wrote them.
REMEMBERED = 1 << 16


def write_files(rows: DataFrame, path: str, content: str, linked: bool = False) -> int:
    """Write `content` of each row to the file at its `path`, in the rows' tasks; the number of files.

    linked: equal contents of a task are one file with several names on local disks that can do so, and take
    an inode and blocks once. It is for files that nobody changes in place; writing them anew is safe.
    """

    def write(batches):
        from pyarrow import fs

        known: dict[bytes, str] = {}
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = data if isinstance(data, bytes) else data.encode()
                store, at = store_of(name)
                if not linked or not isinstance(store, fs.LocalFileSystem):
                    put(store, at, data)
                    continue
                key = hashlib.sha256(data).digest()
                if key in known and named_too(known[key], at):
                    continue
                with contextlib.suppress(FileNotFoundError):
                    os.remove(at)  # other names of what lies there keep their content
                put(store, at, data)
                if len(known) >= REMEMBERED:
                    known.clear()
                known[key] = at
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return rows.select(path, content).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# ---- listing


ENTRY = "dir string, name string, path string, is_folder boolean, n_bytes long"


#: Entries that leave a task at a time.
LISTED = 10_000


def entries(folder: str) -> Iterator[tuple[str, str, bool, int | None]]:
    """(dir, name, is it a folder, bytes) of all that lies directly in a folder, nothing if it is gone; on a local disk one entry is held at a time."""
    from pyarrow import fs

    store, at = store_of(folder)
    scheme = folder[: len(folder) - len(at)] if folder.endswith(at) and not folder.startswith("file:") else ""
    place = scheme + at.rstrip("/")
    if not isinstance(store, fs.LocalFileSystem):
        for f in store.get_file_info(fs.FileSelector(at, allow_not_found=True)):
            yield place, f.base_name, f.type == fs.FileType.Directory, f.size
        return
    with contextlib.suppress(FileNotFoundError), os.scandir(at) as found:
        for f in found:
            is_folder = f.is_dir()
            try:
                size = None if is_folder else f.stat().st_size
            except FileNotFoundError:  # gone by now, or a link to nothing
                continue
            yield place, f.name, is_folder, size


def listing(folders: Iterator[str], most: int = LISTED) -> Iterator[pa.RecordBatch]:
    """ENTRY of folders in batches of one size, whether they come from a wide folder or from very many narrow ones."""
    found = (e for folder in folders for e in entries(folder))
    while held := list(itertools.islice(found, most)):
        dirs, names, kinds, sizes = zip(*held)
        yield pa.RecordBatch.from_pydict({
            "dir": pa.array(dirs, pa.string()), "name": pa.array(names, pa.string()), "path": pa.array([f"{d}/{n}" for d, n in zip(dirs, names)], pa.string()),
            "is_folder": pa.array(kinds, pa.bool_()), "n_bytes": pa.array(sizes, pa.int64()),
        })


def children(folders: DataFrame) -> DataFrame:
    """ENTRY for all that lies directly in folders (path); a folder that is gone has nothing in it."""
    return folders.select("path").mapInArrow(lambda batches: listing(folder for batch in batches for folder in batch.column(0).to_pylist()), ENTRY)


def walk(spark: SparkSession, root: str, tasks: int | None = None):
    """ENTRY level by level below root: a level's folders are dealt out over tasks, so the driver sees their number alone."""
    tasks = tasks or 2 * spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([(root.rstrip("/"),)], "path string")
    while True:
        level = written(children(folders.repartition(tasks)), "listing")
        yield level
        folders = level.filter("is_folder").select("path")
        if folders.isEmpty():
            return


def list_tree(spark: SparkSession, root: str, folders: bool = False) -> DataFrame:
    """dir, name, path, n_bytes of all files (or folders) below root, however deep or wide the tree is. Hidden files are left out."""
    levels = [level.filter("is_folder" if folders else "NOT is_folder") for level in walk(spark, root)]
    out = levels[0]
    for level in levels[1:]:
        out = out.union(level)
    return out.filter(~F.startswith("name", F.lit("."))).drop("is_folder")


# ---- decoding


def default_decoder() -> Callable[[bytes], np.ndarray]:
    """Any format with Pillow on the workers, else PNG; without Pillow another format is an error, not a missing image."""
    try:
        from PIL import Image
    except ImportError:
        def decode(data: bytes) -> np.ndarray:
            if data[:3] == b"\xff\xd8\xff":
                raise LookupError("JPEG files need Pillow on the workers, or a decoder that is given")
            return png.decode(data)

        return decode
    import io

    return lambda data: np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))


def reads(head: bytes) -> bool:
    """Does default_decoder() take a file that begins so, HEAD bytes of it? Without Pillow that is PNG of 8 bits that is not interlaced, with gray, RGB, a palette or alpha besides RGB."""
    try:
        import PIL  # noqa: F401
    except ImportError:
        return len(head) == HEAD and head.startswith(png.SIGNATURE) and head[12:16] == b"IHDR" and head[24] == 8 and head[25] in (0, 2, 3, 6) and head[28] == 0
    return True


#: Bytes up to the end of what a PNG file says of its pixels.
HEAD = 29


def unread(paths: DataFrame) -> DataFrame:
    """Those of the files at `path` that default_decoder() does not take, by their first bytes; what is missing is not among them."""

    def look(batches):
        for batch in batches:
            other = []
            for path in batch.column(0).to_pylist():
                with opened(path) or contextlib.nullcontext() as f:
                    if f is not None and not reads(f.read(HEAD)):
                        other.append(path)
            yield pa.RecordBatch.from_pydict({"path": pa.array(other, pa.string())})

    return paths.select("path").mapInArrow(look, "path string")


def decoded(data: bytes | None, decoder: Callable[[bytes], np.ndarray]) -> np.ndarray | None:
    """RGB pixels; null for what can't be decoded."""
    try:
        return None if not data else P.rgb(decoder(data))
    except (ValueError, OSError):
        return None


def as_images(arrays: list[np.ndarray | None]) -> pa.Array:
    """IMAGE structs of arrays, null where one is missing."""
    missing = pa.array([a is None for a in arrays], pa.bool_())
    side = lambda n: pa.array([None if a is None else a.shape[n] for a in arrays], pa.int32())
    data = pa.array([None if a is None else np.ascontiguousarray(a).tobytes() for a in arrays], pa.binary())
    return pa.StructArray.from_arrays([side(0), side(1), side(2), data], names=IMAGE.names, mask=missing)


#: Bytes of pixels that leave a task at a time, about.
BATCH_BYTES = 32 << 20


def load_pairs(pairs: DataFrame, original: str, edited: str, side: int, decoder=None, opener=None) -> DataFrame:
    """pairs with original_image (side x side) and edited_image (at the original's size), null where a file is missing or broken.

    original, edited: columns of paths. The narrow rows are dealt out by range of both, in order, so a task opens
    and decodes an original once for all its edits, an original with very many edits is shared by as many tasks
    as its rows fill, and pixels are made behind the only exchange. decoder, opener: functions that return, in
    the task, bytes -> array and path -> bytes.
    """
    schema = pairs.select("*", F.lit(None).cast(IMAGE).alias("original_image"), F.lit(None).cast(IMAGE).alias("edited_image")).schema
    rows = pairs.repartitionByRange(original, edited).sortWithinPartitions(original, edited)
    at = [pairs.columns.index(c) for c in (original, edited)]

    def load(batches):
        decode, read = (decoder or default_decoder)(), opener() if opener else read_bytes
        last, square = load, None  # no path yet
        for batch in batches:
            start, held, arrays = 0, 0, []
            for k, (a, b) in enumerate(zip(batch.column(at[0]).to_pylist(), batch.column(at[1]).to_pylist())):
                if a != last:
                    last, square = a, None
                    pixels = decoded(read(a), decode) if a is not None else None
                    square = None if pixels is None or 0 in pixels.shape else P.resize(pixels, side, side)
                pixels = decoded(read(b), decode) if b is not None and square is not None else None
                arrays.append((square, None if pixels is None or 0 in pixels.shape else P.resize(pixels, side, side)))
                held += sum(x.nbytes for x in arrays[-1] if x is not None)
                if held >= BATCH_BYTES or k == batch.num_rows - 1:
                    out = [*batch.slice(start, k + 1 - start).columns, *(as_images(list(x)) for x in zip(*arrays))]
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)
                    start, held, arrays = k + 1, 0, []

    return rows.mapInArrow(load, schema)


def with_images(rows: DataFrame, path: str, decoder=None, opener=None, missing: bool = True) -> DataFrame:
    """rows with the image of the file at their path, read and decoded where they lie; null if it is broken or, where such rows are kept, missing."""
    schema = rows.select("*", F.lit(None).cast(IMAGE).alias("image")).schema
    at = rows.columns.index(path)

    def load(batches):
        decode, read = (decoder or default_decoder)(), opener() if opener else read_bytes
        for batch in batches:
            held, kept, arrays = 0, [], []
            together = lambda: pa.RecordBatch.from_arrays([*batch.take(pa.array(kept)).columns, as_images(arrays)], names=schema.names)  # noqa: E731, B023
            for k, name in enumerate(batch.column(at).to_pylist()):
                data = None if name is None else read(name)
                if data is None and not missing:
                    continue
                kept.append(k)
                arrays.append(decoded(data, decode))
                held += 0 if arrays[-1] is None else arrays[-1].nbytes
                if held >= BATCH_BYTES:
                    yield together()
                    held, kept, arrays = 0, [], []
            if kept:
                yield together()

    return rows.mapInArrow(load, schema)


def load_images(paths: DataFrame, decoder=None, opener=None) -> DataFrame:
    """path and image of each distinct path; null if it is missing or broken."""
    return with_images(paths.select("path").distinct(), "path", decoder, opener)

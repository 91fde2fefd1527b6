"""Files in whatever store Spark reads: small reads, listings, and writes that are whole or not there."""

from __future__ import annotations

import atexit
import hashlib
import uuid

from pyspark.sql import SparkSession

#: Used where all of Spark is one process and names no folder, as in tests.
LOCAL_DIR = "/tmp/checkpoints/lodestrata"
_MADE: list[tuple[SparkSession, str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and the executors share; it goes when the driver ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = LOCAL_DIR
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not _MADE:
        atexit.register(_remove_made)
    _MADE.append((spark, path))
    return path


def _remove_made() -> None:
    for spark, path in _MADE:
        try:
            remove(spark, path)
        except Exception:  # the session is already gone; the folder is the cluster's to clean
            return


def place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    # local files may be written by others, so they have no checksum files beside them
    return fs.getRawFileSystem() if fs.getUri().getScheme() == "file" else fs, at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, path)
    return fs.exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, path)
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files under a folder."""
    fs, at = place(spark, path)
    return fs.getContentSummary(at).getLength()


def read_range(spark: SparkSession, path: str, start: int, length: int) -> bytes:
    """Some bytes of a file, on the driver; for heads, ends and small files."""
    fs, at = place(spark, path)
    stream = fs.open(at)
    try:
        stream.seek(start)
        return bytes(stream.readNBytes(length))
    finally:
        stream.close()


def read_small(spark: SparkSession, path: str) -> bytes:
    return read_range(spark, path, 0, size(spark, path))


def listing(spark: SparkSession, folder: str) -> list[tuple[str, bool]]:
    """(path, whether it is a folder) of what a folder holds, sorted; a glob pattern gives what it matches."""
    fs, at = place(spark, folder)
    found = fs.listStatus(at) if fs.exists(at) else fs.globStatus(at) or []
    return sorted((_plain(x.getPath(), folder), x.isDirectory()) for x in found)


def _plain(at, asked: str) -> str:
    """The path as it would be asked for: with a scheme only where the question had one."""
    return at.toString() if "://" in asked or asked.startswith("file:") else at.toUri().getPath()


def remove(spark: SparkSession, path: str) -> bool:
    fs, at = place(spark, path)
    return fs.delete(at, True)


def copy(spark: SparkSession, from_: str, to: str) -> None:
    """A file, or a folder with all in it, streamed to a new place."""
    (a, x), (b, y) = place(spark, from_), place(spark, to)
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(a, x, b, y, False, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{from_} could not be copied")


def move(spark: SparkSession, from_: str, to: str) -> None:
    """A new name; FileExistsError if it is taken."""
    (fs, x), (_, y) = place(spark, from_), place(spark, to)
    if fs.exists(y) or not fs.rename(x, y):
        raise FileExistsError(to)


def files(spark: SparkSession, path: str) -> list[str]:
    """A file, or all files under a folder, sorted."""
    if not is_folder(spark, path):
        return [path]
    return [f for at, folder in listing(spark, path) for f in (files(spark, at) if folder else [at])]


def text_files(spark: SparkSession, path: str) -> list[str]:
    """The files of one text in its order: the path itself, or the part files of a folder as a writer numbers them."""
    if not is_folder(spark, path):
        return [path] if exists(spark, path) else []
    return [at for at, folder in listing(spark, path) if not folder and at.rsplit("/", 1)[-1].startswith("part-")]


def head(spark: SparkSession, path: str, length: int) -> bytes:
    """The first bytes of a text that stands in a file or in part files."""
    out = b""
    for at in text_files(spark, path):
        more = read_range(spark, at, 0, length - len(out))
        # a part's last line ends with it
        out += b"\n" if out and more and out[-1:] not in (b"\n", b"\r") else b""
        out += more
        if len(out) >= length:
            break
    return out[:length]


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file; of a folder, that of its files' names and digests. Bytes stream, none are held."""

    def one(name: str) -> str:
        fs, at = place(spark, name)
        stream = fs.open(at)
        try:
            return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    if not is_folder(spark, path):
        return one(path)
    parts = [f"{f[len(path.rstrip('/')) :].lstrip('/')}:{one(f)}" for f in files(spark, path)]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def create(spark: SparkSession, path: str, content: bytes) -> None:
    """A new file; FileExistsError if there is one, whoever made it."""
    fs, at = place(spark, path)
    try:
        stream = fs.create(at, False)
    except Exception as error:
        if fs.exists(at):
            raise FileExistsError(path) from error
        raise
    try:
        stream.write(bytearray(content))
        stream.hsync()
    finally:
        stream.close()


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """A file with this content, written beside its place and moved there whole; an older one is replaced."""
    fs, at = place(spark, path)
    staged = f"{path}.{uuid.uuid4().hex[:8]}.part"
    create(spark, staged, content)
    _, from_ = place(spark, staged)
    try:
        if fs.exists(at):
            fs.setPermission(from_, fs.getFileStatus(at).getPermission())
        _replace(spark, fs, from_, at)
    except BaseException:
        fs.delete(from_, False)
        raise


def _replace(spark: SparkSession, fs, from_, to) -> None:
    """One rename that overwrites where the store has it; else the old file goes first."""
    jvm = spark._jvm
    try:
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(from_, to, options)
    except Exception as error:
        if "UnsupportedFileSystem" not in str(error):
            raise
        if fs.exists(to):
            fs.delete(to, False)
        if not fs.rename(from_, to):
            raise OSError(f"{to.toString()} could not be put in its place") from error

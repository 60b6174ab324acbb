"""Repository archives as relations: zip, and tar in any usual packing, read entry by entry under limits.

An archive is one row of bytes, as Spark's ``binaryFile`` source gives it from any store. Entries are unpacked in pieces, and no more of
one than its limit and one byte is ever held, whatever its header states, so a small archive can't unfold into a large one. Entries of a
large archive can be dealt into shares, each of which unpacks its own part of the list and skips the rest.
"""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an archive, entries, bytes of all entries and of one.
MOST_ARCHIVE_BYTES, MOST_ENTRIES, MOST_BYTES, MOST_ENTRY_BYTES = 256 << 20, 50_000, 1 << 30, 2 << 20
PIECE = 1 << 16

_ENTRIES = "archive string, path string, n_bytes long, status string, content binary"
_FIELDS = [("archive", pa.string()), ("path", pa.string()), ("n_bytes", pa.int64()), ("status", pa.string()), ("content", pa.binary())]


class ArchiveError(ValueError):
    """An archive that breaks a rule: it is refused as a whole."""


def is_unsafe(name: str) -> bool:
    """Absolute names, drives, backslashes, NULs, and names that lead out of the archive or are blank."""
    return not name.strip() or name.startswith("/") or "\\" in name or "\0" in name or name[1:2] == ":" or ".." in name.split("/")


def _listed(raw: bytes) -> Iterator[tuple[str, bool, object]]:
    """Name, whether it is a plain file, and a function that opens it, of every entry of a zip or tar archive."""
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as packed:
            for info in packed.infolist():
                link = (info.external_attr >> 16) & 0o170000 == 0o120000
                yield info.filename, not info.is_dir() and not link, (lambda i=info: packed.open(i))
    else:
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:*") as packed:
            for info in packed:
                yield info.name, info.isreg(), (lambda i=info: packed.extractfile(i))


def _unpacked(open_entry, most: int) -> bytes:
    """An entry's bytes, or its first ``most`` and one if it has more."""
    out = bytearray()
    with open_entry() as source:
        while len(out) <= most and (piece := source.read(min(PIECE, most + 1 - len(out)))):
            out += piece
    return bytes(out)


def entries_of(raw: bytes, share: int = 0, shares: int = 1, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, most_entry_bytes: int = MOST_ENTRY_BYTES) -> Iterator[tuple[str, int, str, bytes | None]]:
    """Path below the archive's one root, bytes, status (kept or too_large) and content of the files of one archive.

    Unsafe names, several roots, too many entries or bytes, an archive without an entry and one that can't be read are errors. Folders
    and links are passed over. A file that is too large has its limit and one as its size, and no content. Of ``shares`` only
    the ``share``-th gives rows and counts bytes; every one checks all names.
    """
    root, n, total = None, 0, 0
    try:
        for name, plain, open_entry in _listed(raw):
            n += 1
            if n > most_entries:
                raise ArchiveError("too many entries")
            if is_unsafe(name):
                raise ArchiveError(f"unsafe path {name!r}")
            first, slash, rest = name.partition("/")
            root = first if root is None else root
            if first != root:
                raise ArchiveError("more than one root")
            if not plain or not slash or not rest or n % shares != share:
                continue
            content = _unpacked(open_entry, most_entry_bytes)
            if len(content) > most_entry_bytes:
                yield rest, most_entry_bytes + 1, "too_large", None
                continue
            total += len(content)
            if total > most_bytes:
                raise ArchiveError("too many bytes")
            yield rest, len(content), "kept", content
    except (zipfile.BadZipFile, tarfile.TarError, zlib.error, EOFError, NotImplementedError, RuntimeError) as error:
        raise ArchiveError(f"can't be read: {error}") from error
    if not n:
        raise ArchiveError("no entries")


def archive_entries(archives: DataFrame, shares: int = 1, most_archive_bytes: int = MOST_ARCHIVE_BYTES, most_entries: int = MOST_ENTRIES, most_bytes: int = MOST_BYTES, most_entry_bytes: int = MOST_ENTRY_BYTES, strict: bool = True) -> DataFrame:
    """archive, path, n_bytes, status, content of the files of ``archives`` (archive, content).

    A refused archive is an error if ``strict``, else one row with a null path and the status ``refused: <why>`` and none of its files.
    A null content is refused. With ``shares`` each archive is read in so many tasks, which hold its bytes each.
    """
    names = [n for n, _ in _FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(_FIELDS)], names=names)

        for batch in batches:
            for archive, content, share in zip(batch.column("archive").to_pylist(), batch.column("content"), batch.column("share").to_pylist(), strict=True):
                try:
                    raw = content.as_py()
                    if raw is None or len(raw) > most_archive_bytes:
                        raise ArchiveError("missing or too large")
                    if not strict:  # nothing of an archive comes out before all of it is known to be right
                        for _ in entries_of(raw, share, shares, most_entries, most_bytes, most_entry_bytes):
                            pass
                    held, size = [], 0
                    for path, n, status, found in entries_of(raw, share, shares, most_entries, most_bytes, most_entry_bytes):
                        held.append((archive, path, n, status, found))
                        size += n
                        if size > 8 << 20:
                            yield table(held)
                            held, size = [], 0
                    yield table(held)
                except ArchiveError as error:
                    if strict:
                        raise ArchiveError(f"{archive}: {error}") from error
                    if not share:
                        yield table([(archive, None, None, f"refused: {error}", None)])

    dealt = archives.select(F.col("archive").cast("string").alias("archive"), "content", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    return (dealt.repartition("archive", "share") if shares > 1 else dealt).mapInArrow(run, _ENTRIES)


def stored_archives(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """archive (its file's name), content of the archives in a folder, whose names fit ``pattern``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return rows.select(F.substring_index("path", "/", -1).alias("archive"), "content")


def packed(files: DataFrame, key: list[str], root: str = "root") -> DataFrame:
    """``key``, content: a zip archive of each key's ``files`` (``key``, path, content as bytes), below one root, in the order of their paths.

    An archive is built in one task, so a key's files must fit there. A null content is an empty file.
    """
    import pandas as pd

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
            for path, content in sorted(zip(rows["path"], rows["content"], strict=True), key=lambda x: x[0]):
                target.writestr(zipfile.ZipInfo(f"{root}/{path}", (1980, 1, 1, 0, 0, 0)), content if content is not None else b"", zipfile.ZIP_DEFLATED)
        return rows.iloc[:1][key].assign(content=[out.getvalue()])

    types = ", ".join(f"{c} {files.schema[c].dataType.simpleString()}" for c in key)
    return files.select(*key, "path", "content").groupBy(*key).applyInPandas(pack, f"{types}, content binary")

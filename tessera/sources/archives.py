"""Archives as rows: members of ZIP files, unsafe archives refused before anything is inflated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

MEMBER = "member string, size long, content binary, refused string"


def archive_members(archives: DataFrame, *, content: str, suffixes: tuple[str, ...] = (), max_files: int = 1_000, max_bytes: int = 1 << 30, max_ratio: int = 200) -> DataFrame:
    """Every row of ``archives`` with its members: ``member, size, content, refused``.

    One row a member that has one of ``suffixes`` (all, if none are named). An
    archive that is no ZIP file, has more than ``max_files`` members or
    ``max_bytes`` in all, an encrypted member, a link, a path that is absolute
    or climbs out of the archive, or a member that claims more than
    ``max_ratio`` times its packed size, is refused whole: one row with the
    reason and no member. That is told by the archive's directory, before
    anything is inflated; a member that inflates to more than it claimed or has
    a wrong checksum is refused as a row of its own. Members are inflated one
    at a time. A null or empty archive is refused; an archive without members
    gives no row. ``content`` itself is not passed on.
    """

    @udtf(returnType=MEMBER)
    class Members:
        def eval(self, data):
            import io
            import stat
            import zipfile
            import zlib
            from pathlib import PurePosixPath

            def fault(infos):
                if len(infos) > max_files:
                    return "too many files"
                if sum(i.file_size for i in infos) > max_bytes:
                    return "too large"
                for i in infos:
                    path = PurePosixPath(i.filename.replace("\\", "/"))
                    if i.flag_bits & 0x1:
                        return "encrypted"
                    if stat.S_ISLNK(i.external_attr >> 16):
                        return "link"
                    if path.is_absolute() or ".." in path.parts:
                        return "unsafe path"
                    if i.file_size > max_ratio * max(i.compress_size, 1_024):
                        return "suspicious ratio"
                return None

            try:
                archive = zipfile.ZipFile(io.BytesIO(bytes(data or b"")))
            except (zipfile.BadZipFile, ValueError, NotImplementedError):
                yield None, None, None, "not an archive"
                return
            infos = [i for i in archive.infolist() if not i.is_dir()]
            reason = fault(infos)
            if reason:
                yield None, None, None, reason
                return
            for i in infos:
                if suffixes and PurePosixPath(i.filename.replace("\\", "/")).suffix.lower() not in suffixes:
                    continue
                try:
                    with archive.open(i) as member:
                        held = member.read(i.file_size + 1)
                except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError):
                    yield i.filename, None, None, "damaged"
                    continue
                if len(held) != i.file_size:
                    yield i.filename, None, None, "damaged"
                else:
                    yield i.filename, len(held), held, None

    packed = "_packed"
    while packed in archives.columns:
        packed = "_" + packed
    return archives.withColumnRenamed(content, packed).lateralJoin(Members(F.col(packed).outer())).drop(packed)

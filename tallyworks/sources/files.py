"""File sets, archives and kinds of file."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Bytes of an archive's entry that are read at most, and folders that are walked at most.
ENTRY_CAP, DEPTH_CAP = 64 * 1024 * 1024, 8
# Endings that decide where the content doesn't.
ENDINGS = {"pdf": "pdf", "ofd": "ofd", "xml": "xml", **dict.fromkeys(("jpg", "jpeg", "png", "bmp", "gif", "tif", "tiff", "webp", "heic"), "image")}
BOM = b"\xef\xbb\xbf"
FILES = "path string, content binary"


def read_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, content) of every file below the paths, at most ``DEPTH_CAP`` folders deep; unreadable ones are skipped."""
    roots = [paths] if isinstance(paths, str) else list(paths)
    parts = []
    for root in roots:
        df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(root)
        base = root.rstrip("/").split("://")[-1].rstrip("/")
        below = F.regexp_replace(F.col("path"), F.lit("^.*?" + re.escape(base) + "/?"), F.lit(""))
        depth = F.size(F.split(below, "/")) - 1
        parts.append(df.where(depth <= DEPTH_CAP).select("path", "content"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered(files: DataFrame) -> DataFrame:
    return files.orderBy("path")


def is_ofd(content: bytes) -> bool:
    """A zip with OFD.xml at its root."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return any(n.lower() == "ofd.xml" for n in z.namelist())
    except (zipfile.BadZipFile, OSError, ValueError):
        return False


def entries(content: bytes) -> list[tuple[str, bytes]]:
    """(name, bytes) of an archive's files, each up to the cap; none if it can't be read."""
    out = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    try:
                        with z.open(info) as f:
                            out.append((info.filename, f.read(ENTRY_CAP)))
                    except (zipfile.BadZipFile, OSError, RuntimeError, NotImplementedError):
                        continue
    except (zipfile.BadZipFile, OSError, ValueError):
        return []
    return out


def expand_archives(files: DataFrame) -> DataFrame:
    """Archives that aren't OFD become a row per entry, named archive!entry, one level deep; other files stay."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                if content[:4] == b"PK\x03\x04" and not is_ofd(content):
                    own = [(f"{path}!{name}", data) for name, data in entries(content)]
                    if own:
                        yield pd.DataFrame(own, columns=["path", "content"])
                else:
                    yield pd.DataFrame([(path, content)], columns=["path", "content"])

    plain = F.substring(F.col("content"), 1, 4) != F.lit(b"PK\x03\x04")
    # only archives go through Python
    return files.where(plain).select("path", "content").unionByName(files.where(~plain).select("path", "content").mapInPandas(run, FILES))


@F.pandas_udf(BooleanType())
def _ofd_root(content: pd.Series) -> pd.Series:
    return content.map(lambda x: bool(x) and is_ofd(bytes(x)))


def detect(content: Column, path: Column) -> Column:
    """Kind of file by its first bytes, else by its ending."""
    head = F.hex(F.substring(content, 1, 16))
    body = F.when(head.startswith("EFBBBF"), F.substring(head, 7, 40)).otherwise(head)
    at = lambda text, n=0: F.substring(head, 2 * n + 1, 2 * len(text)) == text.hex().upper()
    image = (
        at(b"\xff\xd8\xff") | at(b"\x89PNG\r\n\x1a\n") | at(b"GIF87a") | at(b"GIF89a") | at(b"BM") | at(b"II*\x00") | at(b"MM\x00*")
        | (at(b"RIFF") & at(b"WEBP", 8)) | at(b"\x00\x00\x01\x00")
    )
    ending = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return (
        F.when(at(b"%PDF"), "pdf")
        .when(at(b"PK\x03\x04"), F.when(_ofd_root(content), "ofd").otherwise("zip"))
        .when(body.startswith(b"<?xml".hex().upper()) | body.startswith(b"<EInvoice".hex().upper()), "xml")
        .when(image, "image")
        .otherwise(F.coalesce(*[F.when(ending == e, F.lit(k)) for e, k in ENDINGS.items()], F.lit("unknown")))
    )


def decode(content: bytes) -> str:
    """Text of an XML file: the encoding named in its first 120 bytes, Chinese ones as GB18030, else UTF-8."""
    data = content.removeprefix(BOM)
    named = data[:120].decode("ascii", "replace").lower()
    chinese = any(x in named for x in ("gb2312", "gbk", "gb18030"))
    return data.decode("gb18030" if chinese else "utf-8", "replace")

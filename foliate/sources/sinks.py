"""Where results go: documents as files, with the guards and save modes of paths, and rows as JSON."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import FoliateError
from .office_files import convert, word_paragraphs, write_word


def absolute(path: str) -> Path:
    """The path, which must be absolute."""
    if not path or not path.strip() or not os.path.isabs(path):
        raise FoliateError("invalid_path", f"not an absolute path: {path}")
    return Path(path)


def readable(path: str) -> Path:
    """An absolute path of a file that is there."""
    out = absolute(path)
    if not out.is_file():
        raise FoliateError("file_not_found", f"no file {path}")
    return out


def writable(path: str, overwrite: bool = False) -> Path:
    """An absolute path that may be written: a file that is there only if it may be overwritten. Folders above it are
    made."""
    out = absolute(path)
    if out.exists() and not overwrite:
        raise FoliateError("file_exists", f"{path} is there; ask for overwrite to replace it")
    out.parent.mkdir(parents=True, exist_ok=True)
    return out


def save(content: bytes, path: str, overwrite: bool = False) -> str:
    """Write one file: beside its place first, so that a reader never meets half of it."""
    out = writable(path, overwrite)
    part = out.with_name(out.name + ".part")
    part.write_bytes(content)
    os.replace(part, out)
    return str(out)


def create_blank(path: str, overwrite: bool = False) -> str:
    return save(write_word([]), path, overwrite)


#: Other names of formats (fixed values).
SAME = {"htm": "html", "text": "txt", "markdown": "md"}


def convert_file(source: str, target: str, name: str | None = None, overwrite: bool = False) -> str:
    """A Word file as another format, told by `name` or else the target's extension."""
    data, out = readable(source).read_bytes(), absolute(target)
    low = (name if name and name.strip() else out.suffix).strip().lstrip(".").lower()
    return save(convert([(style, text) for _, style, text, _ in word_paragraphs(data)], SAME.get(low, low)), target, overwrite)


def save_rows(df: DataFrame, path: str, overwrite: bool = False, format: str = "parquet") -> None:
    """Rows as a folder of files in any store that Spark writes to."""
    try:
        df.write.format(format).mode("overwrite" if overwrite else "errorifexists").save(path)
    except Exception as e:
        if "PATH_ALREADY_EXISTS" in str(e):
            raise FoliateError("file_exists", f"{path} is there; ask for overwrite to replace it") from e
        raise


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, null fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def with_style(styles: Column, name: str) -> Column:
    """The array of style names with `name` in it, added at the end if it is missing in any case."""
    return F.when(F.exists(styles, lambda s: F.lower(s) == name.lower()), styles).otherwise(F.array_append(styles, F.lit(name)))

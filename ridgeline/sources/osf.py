"""Zipped exports: a manifest and the GPX files that it lists."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

from ..config import MAX_ARCHIVE_ITEMS, MAX_EXPANDED_BYTES, MAX_FILE_BYTES, MAX_MANIFEST_BYTES
from .errors import Unreadable

MANIFEST = "items.json"


def safe_path(path: str) -> str | None:
    """The path without leading slashes, or None if it could lead outside."""
    own = path.lstrip("/")
    if not own or "\\" in own or "\0" in own or any(part in ("", ".", "..") for part in own.split("/")):
        return None
    return own


def inspect(archive: zipfile.ZipFile) -> list[str]:
    """The GPX entries that the manifest lists.  Raises Unreadable if the archive breaks a rule."""
    held = [x for x in archive.infolist() if not x.is_dir()]
    names = [safe_path(x.filename) for x in held]
    if None in names:
        raise Unreadable("an unsafe path")
    if len(set(names)) < len(names):
        raise Unreadable("a path comes twice")
    if sum(x.file_size for x in held) > MAX_EXPANDED_BYTES:
        raise Unreadable("the archive expands too far")
    sizes = dict(zip(names, held, strict=True))
    if MANIFEST not in sizes or sizes[MANIFEST].file_size > MAX_MANIFEST_BYTES:
        raise Unreadable("no usable manifest")
    try:
        manifest = json.loads(archive.read(sizes[MANIFEST]))
        version, items = manifest["version"], manifest["items"]
    except (ValueError, KeyError, TypeError):
        raise Unreadable("no usable manifest") from None
    if not isinstance(version, int) or version < 1 or not isinstance(items, list):
        raise Unreadable("no usable manifest")
    wanted = [x for x in items if isinstance(x, dict) and x.get("type") == "GPX"]
    paths = [safe_path(str(x.get("file", ""))) for x in wanted]
    if len(paths) > MAX_ARCHIVE_ITEMS:
        raise Unreadable("too many recordings")
    if None in paths or len(set(paths)) < len(paths):
        raise Unreadable("an unsafe or repeated path in the manifest")
    missing = [p for p in paths if p not in sizes or sizes[p].file_size > MAX_FILE_BYTES]
    if missing:
        raise Unreadable(f"missing or too large: {missing[0]}")
    return paths


def entries(content: bytes) -> Iterator[tuple[str | None, bytes | None, str | None]]:
    """(path, content, error) of each recording, one at a time; a single error row if the archive can't be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            paths = inspect(archive)
            by_path = {safe_path(x.filename): x for x in archive.infolist() if not x.is_dir()}
            for path in paths:
                yield path, archive.read(by_path[path]), None
    except (zipfile.BadZipFile, Unreadable, NotImplementedError, RuntimeError) as problem:
        yield None, None, str(problem) or "not an archive"

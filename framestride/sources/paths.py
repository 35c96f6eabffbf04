"""Dataset roots, portable names and path templates: pure functions on the driver."""

from __future__ import annotations

import glob
import os
import re

from ..errors import DatasetError

# Characters and device names that a path component must avoid on every system.
BARRED = frozenset("/\\:*?\"<>|[]%#")
DEVICES = {"con", "prn", "aux", "nul", "conin$", "conout$"}
NUMBERED = re.compile(r"(com|lpt)[1-9¹²³]")

WIDEST = 1000
_PLACE = re.compile(r"\{\{|\}\}|\{([^}]*)\}|([{}])")


def portable(name: str) -> bool:
    """Whether name is safe as one component of a path on all systems and in URIs."""
    if not name or name in (".", "..") or name[-1] in ". ":
        return False
    if any(c in BARRED or ord(c) < 32 or ord(c) == 127 for c in name):
        return False
    stem = _lower_ascii(name.split(".", 1)[0]).rstrip(" ")
    return stem not in DEVICES and not NUMBERED.fullmatch(stem)


def _lower_ascii(s: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def feature_name(name: str) -> str:
    if not portable(name):
        raise DatasetError(f"feature name must be a portable path component: '{name}'")
    return name


def normal_root(root: str | None) -> str:
    if root is None:
        raise DatasetError("root must not be NULL")
    root = root.strip(" \f\n\r\t\v")
    if not root:
        raise DatasetError("dataset root must not be empty")
    return root.rstrip("/") or "/"


def resolve_root(root: str | None, search_path: list[str] | str | None = None) -> str:
    """An absolute path or URI. A relative root is below the working directory, or, with a search path
    (a list, or one comma-separated string), wherever its info.json is; more than one place is an error."""
    root = normal_root(root)
    if root == "~" or root.startswith("~/"):
        root = os.path.expanduser(root)
    if re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", root) or root.startswith("/"):
        return root
    here = os.path.join(os.getcwd(), root)
    places = [p for p in (search_path.split(",") if isinstance(search_path, str) else search_path or []) if p]
    if not places or os.path.exists(f"{here}/meta/info.json"):
        return here
    found = set()
    for place in places:
        for match in glob.glob(os.path.join(glob.escape(os.path.expanduser(place)), glob.escape(root), "meta", "info.json")):
            found.add(os.path.abspath(os.path.dirname(os.path.dirname(match))))
    if len(found) > 1:
        raise DatasetError(f"dataset root '{root}' matches multiple datasets in the search path; use an explicit path")
    return found.pop() if found else here


def _number(value: int, spec: str, field: str) -> str:
    if value < 0:
        raise DatasetError(f"{field} must be non-negative")
    if not spec:
        return str(value)
    if not (m := re.fullmatch(r"([0-9]*)d", spec)):
        raise DatasetError(f"unsupported path format specifier '{spec}' for {field}")
    width = m[1]
    if len(width) > 8 or int(width or 0) > WIDEST:
        raise DatasetError(f"path format width is too large for {field}")
    return str(value).rjust(int(width or 0), "0" if width[:1] == "0" else " ")


def expand(template: str, chunk: int, file: int, key: str | None = None, what: str = "data_path") -> str:
    """A template with {chunk_index[:spec]}, {file_index[:spec]}, {video_key}, {{ and }}; spec is like 03d."""

    def put(m: re.Match) -> str:
        if m[0] in ("{{", "}}"):
            return m[0][0]
        if m[2] == "{":
            raise DatasetError(f"unclosed placeholder in {what} '{template}'")
        if m[2] == "}":
            raise DatasetError(f"unmatched closing brace in {what} '{template}'")
        field, _, spec = m[1].partition(":")
        if field in ("chunk_index", "file_index"):
            return _number(chunk if field == "chunk_index" else file, spec, field)
        if field == "video_key" and key is not None:
            if spec:
                raise DatasetError(f"unsupported path format specifier '{spec}' for video_key")
            return key
        raise DatasetError(f"unsupported placeholder {{{m[1]}}} in {what}")

    return _PLACE.sub(put, template)


def locate(root: str, template: str, chunk: int, file: int, key: str | None = None, what: str = "data_path") -> str:
    """The template's file below root; every component of what it expands to must be portable."""
    path = expand(template, chunk, file, key, what)
    if not all(map(portable, path.split("/"))):
        raise DatasetError(f"{what} must stay relative to the dataset root and use portable path components: '{path}'")
    return f"{root}/{path}"


def expand_column(template: str, chunk, file, key=None, what: str = "data_path"):
    """expand() as a Spark expression over columns; the template is checked here, the numbers must not be negative."""
    from pyspark.sql import functions as F

    expand(template, 0, 0, None if key is None else "", what)
    parts, at = [], 0
    for m in _PLACE.finditer(template):
        parts.append(F.lit(template[at : m.start()]))
        at = m.end()
        if m[1] is None:
            parts.append(F.lit(m[0][0]))
            continue
        field, _, spec = m[1].partition(":")
        if field == "video_key":
            parts.append(key)
            continue
        number = (chunk if field == "chunk_index" else file).cast("string")
        width = spec.rstrip("d")
        parts.append(F.lpad(number, F.greatest(F.lit(int(width or 0)), F.length(number)), F.lit("0" if width[:1] == "0" else " ")))
    return F.concat(*parts, F.lit(template[at:]))

"""Jobs over single files on the driver: folders, moves, archives and downloads."""

from __future__ import annotations

import shutil
import urllib.request
import zipfile
from pathlib import Path


def create_folder(path: str) -> None:
    Path(path).mkdir(parents=True, exist_ok=True)


def delete_folder(path: str) -> None:
    shutil.rmtree(path, ignore_errors=True)


def delete_file(path: str) -> None:
    Path(path).unlink(missing_ok=True)


def move_file(source: str, target: str, overwrite: bool = False) -> None:
    if Path(target).exists() and not overwrite:
        raise FileExistsError(target)
    shutil.move(source, target)


def extract_archive(path: str, folder: str) -> list[str]:
    """Unpacks a zip archive; members that would leave the folder are refused."""
    root = Path(folder).resolve()
    with zipfile.ZipFile(path) as archive:
        for name in archive.namelist():
            if not (root / name).resolve().is_relative_to(root):
                raise ValueError(f"{name} lies outside the folder")
        archive.extractall(root)
        return archive.namelist()


def download(url: str, path: str | None = None, timeout: float = 60) -> bytes | str:
    """The content of a URL, or the path it was saved to."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        if path is None:
            return answer.read()
        with open(path, "wb") as out:
            shutil.copyfileobj(answer, out)
    return path

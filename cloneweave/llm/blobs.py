"""Files in the shared folder, from executors: any store that pyarrow can open by URI.

Hadoop's names of S3 (``s3a``, ``s3n``) are pyarrow's ``s3``; region, endpoint
and credentials come from the executors' environment, not from Hadoop's settings.
"""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def plain_uri(uri: str) -> str:
    """A Hadoop path as pyarrow writes it: one local slash (file:/x) is file:///x, s3a and s3n are s3."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        return "file://" + uri[5:]
    if uri.startswith(("s3a://", "s3n://")):
        return "s3" + uri[3:]
    return uri


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI."""
    return fs.FileSystem.from_uri(plain_uri(uri))


def attempt_name(folder: str, part: int, suffix: str) -> str:
    """A file name that no other attempt of this task uses; only names that a finished task returned count."""
    return f"{folder.rstrip('/')}/part-{part:06d}-{uuid.uuid4().hex[:12]}{suffix}"


def make_folder(uri: str) -> None:
    system, path = opened(uri)
    system.create_dir(path, recursive=True)


def writer(uri: str):
    system, path = opened(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)

"""Output of single files: bounded, hashed while it is written, and committed whole or not at all."""

from __future__ import annotations

import hashlib
import os
import sys
import tempfile

from sourcelake.sources.manifests import UNSAFE

# They must equal those of the contract.
MAX_OUTPUT, MAX_DIAGNOSTICS, MAX_TEXT = 256 << 20, 200, 4096


class OutputFailed(RuntimeError):
    """Nothing was committed; the text is a stable reason code."""


class Output:
    """Writes text to a file that must not exist yet, outside ``root``, or to standard output where ``path`` is None."""

    def __init__(self, path: str | None, root: str | None = None, limit: int = MAX_OUTPUT):
        self.path, self.limit, self.size, self.digest, self.committed = path, limit, 0, hashlib.sha256(), False
        if path is None:
            self.file, self.temporary = sys.stdout.buffer, None
            return
        folder = os.path.realpath(os.path.dirname(os.path.abspath(path)))
        if root is not None and (folder + os.sep).startswith(os.path.realpath(root) + os.sep):
            raise OutputFailed("output_inside_input")
        if os.path.lexists(path):
            raise OutputFailed("output_exists")
        self.target = os.path.join(folder, os.path.basename(path))
        handle, self.temporary = tempfile.mkstemp(prefix=".output-", dir=folder)
        self.file = os.fdopen(handle, "wb")

    def write(self, text: str) -> None:
        data = text.encode("utf-8", "surrogatepass")
        if self.size + len(data) > self.limit:
            raise OutputFailed("output_limit")
        self.file.write(data)
        self.size += len(data)
        self.digest.update(data)

    def __enter__(self) -> Output:
        return self

    def __exit__(self, kind, *_) -> None:
        try:
            self.file.flush()
            if self.temporary is not None:
                if kind is None:
                    os.fsync(self.file.fileno())
                self.file.close()
                if kind is None:
                    os.link(self.temporary, self.target)  # fails if the target exists by now
            self.committed = kind is None
        except FileExistsError as error:
            raise OutputFailed("output_exists") from error
        finally:
            if self.temporary is not None:
                os.unlink(self.temporary)

    def receipt(self) -> dict:
        return {"destination": "stdout" if self.path is None else "file", "committed": self.committed, "bytes_written": self.size, "sha256": self.digest.hexdigest() if self.committed else None, "limit_bytes": self.limit}


def safe_text(text: str) -> str:
    """Text fit for a terminal: unsafe characters escaped, at most ``MAX_TEXT`` characters."""
    shown = UNSAFE.sub(lambda m: f"\\u{{{ord(m[0]):x}}}", text)
    return shown if len(shown) <= MAX_TEXT else shown[:MAX_TEXT] + "...[truncated]"

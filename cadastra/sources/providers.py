"""Text recognition as a source: a provider turns files into pages, one Arrow batch at a time.

Calls to vendors live outside this repository; a provider is any function from (path, content) to a list of
(page_number, text). PDF libraries are used where they are installed. Providers named in ``disabled`` are skipped, an error
becomes a row, errors that may pass are tried again, and after one that cannot pass (a refused key, a closed account) the
provider is skipped for the rest of the task.
"""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.session import flat_map

Provider = Callable[[str, bytes], list[tuple[int, str]]]
WordProvider = Callable[[str, bytes], list[tuple[int, list[dict]]]]
SCHEMA = "path STRING, provider STRING, page_number INT, text STRING, error STRING"
WORD_SCHEMA = "path STRING, provider STRING, page_number INT, words ARRAY<STRUCT<text: STRING, x0: DOUBLE, x1: DOUBLE, top: DOUBLE>>, error STRING"
# Words in the messages of errors that cannot pass, and of those that may.
TERMINAL = ("permission", "unauthorized", "forbidden", "billing", "disabled", "invalid key", "api key")
RETRYABLE = ("timeout", "timed out", "unavailable", "deadline", "rate limit", "too many requests", "connection")


def plain_text(path: str, content: bytes) -> list[tuple[int, str]]:
    """Pages of a text file, parted by form feeds."""
    return list(enumerate(content.decode("utf-8", "replace").split("\f"), 1))


def pdf_text(path: str, content: bytes) -> list[tuple[int, str]]:
    """Pages of a PDF by the first of the usual libraries that is installed and reads it; the last error if none does."""
    error: Exception = ModuleNotFoundError("no PDF library is installed")
    for read in (_by_pdfplumber, _by_fitz, _by_pypdf):
        try:
            return [(n, " ".join((text or "").split())) for n, text in enumerate(read(content), 1)]
        except Exception as e:  # noqa: BLE001 - the next library may read it
            error = e if not isinstance(e, ModuleNotFoundError) else error
    raise error


def _by_pdfplumber(content: bytes) -> list[str]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [page.extract_text() for page in pdf.pages]


def _by_fitz(content: bytes) -> list[str]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [page.get_text() for page in pdf]


def _by_pypdf(content: bytes) -> list[str]:
    import pypdf

    return [page.extract_text() for page in pypdf.PdfReader(io.BytesIO(content)).pages]


def pdf_words(path: str, content: bytes) -> list[tuple[int, list[dict]]]:
    """Word boxes of the pages of a PDF, in reading order, by the first of the usual libraries that is installed and reads it."""
    error: Exception = ModuleNotFoundError("no PDF library is installed")
    for read in (_words_by_pdfplumber, _words_by_fitz):
        try:
            return [(n, sorted((w for w in words if w["text"].strip()), key=lambda w: (round(w["top"], 1), round(w["x0"], 1)))) for n, words in enumerate(read(content), 1)]
        except Exception as e:  # noqa: BLE001 - the next library may read it
            error = e if not isinstance(e, ModuleNotFoundError) else error
    raise error


def _words_by_pdfplumber(content: bytes) -> list[list[dict]]:
    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [[{k: w[k] for k in ("text", "x0", "x1", "top")} for w in page.extract_words()] for page in pdf.pages]


def _words_by_fitz(content: bytes) -> list[list[dict]]:
    import fitz

    with fitz.open(stream=content, filetype="pdf") as pdf:
        return [[{"text": t, "x0": x0, "x1": x1, "top": y0} for x0, y0, x1, _, t, *_ in page.get_text("words")] for page in pdf]


def read_pages(files: DataFrame, providers: dict[str, Provider], disabled: frozenset[str] = frozenset(), tries: int = 2) -> DataFrame:
    """Every provider's pages of every file (path, content), as text."""
    return _read(files, providers, disabled, tries, SCHEMA)


def read_words(files: DataFrame, providers: dict[str, WordProvider], disabled: frozenset[str] = frozenset(), tries: int = 2) -> DataFrame:
    """Every provider's pages of every file (path, content), as word boxes."""
    return _read(files, providers, disabled, tries, WORD_SCHEMA)


def _read(files: DataFrame, providers: dict, disabled: frozenset[str], tries: int, schema: str) -> DataFrame:
    off: set[str] = set(disabled)  # of one task, once it has begun

    def attempt(name: str, path: str, content: bytes) -> list[tuple]:
        for n in range(tries):
            try:
                return [(path, name, page, text, None) for page, text in providers[name](path, content)]
            except Exception as e:  # noqa: BLE001 - an error of one file must not end the job
                message = f"{type(e).__name__}: {e}"
                if any(w in message.lower() for w in TERMINAL):
                    off.add(name)
                if name in off or n + 1 == tries or not any(w in message.lower() for w in RETRYABLE):
                    return [(path, name, None, None, message)]
        return []

    def run(columns: list[list]) -> list[list]:
        rows = [row for path, content in zip(*columns, strict=True) for name in providers if name not in off for row in attempt(name, path, bytes(content))]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], [], []]

    return flat_map(files.select(F.col("path"), F.col("content")), run, schema)

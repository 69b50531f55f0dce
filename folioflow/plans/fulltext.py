"""Full texts from what was landed of a paper: its TeX archive, else its HTML page, else its PDF.

One function goes through the tiers and stops at the first text, as columns of
separate UDFs would all be computed. Each tier runs in a child process that is
ended when its time is up, so that a broken file costs its row, not the task.
"""

from __future__ import annotations

import io
import logging
import multiprocessing as mp
import shutil
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflow.operators.pages import page_text
from folioflow.operators.tex import main_text

log = logging.getLogger(__name__)
#: Seconds that one tier may take for one paper.
TIMEOUT = 180.0


def pdf_text(data: bytes) -> str | None:
    """Text of a PDF by a library that is installed, without OCR; None where there is none."""
    try:
        import pymupdf4llm

        import pymupdf
    except ImportError:
        return None
    return pymupdf4llm.to_markdown(pymupdf.open(stream=io.BytesIO(data), filetype="pdf"), ignore_code=True) or None


def _child(pipe: object, work: Callable[..., object], args: tuple) -> None:
    try:
        pipe.send((work(*args), None))
    except BaseException as e:
        pipe.send((None, repr(e)))


def bounded(work: Callable[..., object], args: tuple, seconds: float = TIMEOUT) -> object:
    """work(*args) in a child process; None with a warning when it fails, dies or takes longer."""
    ours, theirs = mp.get_context("fork").Pipe(duplex=False)
    child = mp.get_context("fork").Process(target=_child, args=(theirs, work, args), daemon=True)
    child.start()
    theirs.close()
    answer = error = None
    try:
        if ours.poll(seconds):
            answer, error = ours.recv()
        else:
            error = f"more than {seconds:g} s"
    except EOFError:
        error = "the child died"
    finally:
        if child.is_alive():
            child.kill()
        child.join()
        ours.close()
    if error:
        log.warning("%s: %s", getattr(work, "__name__", work), error)
    return answer


def _tex(data: bytes, title: str | None) -> str | None:
    return main_text(data, title)[1]


def full_text(archive: Column, html: Column, pdf: Column, title: Column, seconds: float = TIMEOUT) -> Column:
    """The first tier's text that is not empty; null where no tier has one."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, h, p, t in batches:
            out = []
            for archive, html, pdf, title in zip(a, h, p, t):
                text = bounded(_tex, (bytes(archive), title), seconds) if archive is not None else None
                text = text or (bounded(page_text, (html,), seconds) if html is not None else None)
                out.append(text or (bounded(pdf_text, (bytes(pdf),), seconds) if pdf is not None else None) or None)
            yield pd.Series(out, dtype=object)

    return run(archive, html, pdf, title)


def download(url: str, path: str, seconds: float = 60.0, piece: int = 1 << 20) -> None:
    """Land a file, a piece at a time."""
    with urllib.request.urlopen(url, timeout=seconds) as source, open(path, "wb") as target:
        shutil.copyfileobj(source, target, piece)

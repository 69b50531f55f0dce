"""TeX archives: which file is the main one, and its text with inputs put in."""

from __future__ import annotations

import io
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators.bm25 import B, K1

_WORD = re.compile("[a-zA-Z0-9]+")
_BEGIN = re.compile(r"\\begin\{document\}")
_INPUT = re.compile(r"\\input\{([^}]*)\}")


def cleaned(text: str) -> str:
    """As functions.text.tex_clean, for text that is already in Python."""
    for pattern, new, flags in ((r"%.*\n", "\n", 0), (r"\\begin\{comment\}.*?\\end\{comment\}", "", re.S), (r"\\iffalse.*?\\fi", "", re.S), (r"\n+", "\n", 0), (r"\\\\", "", 0), (r"[ \t\r\f]{3,}", " ", 0)):
        text = re.sub(pattern, new, text, flags=flags)
    return text


def best_match(texts: dict[str, str], query: str) -> str:
    """The key of the text that scores best for the query by BM25; the first of equal ones, and for an empty query."""
    import math

    words = {k: [w.lower() for w in _WORD.findall(t)] for k, t in texts.items()}
    asked = [w.lower() for w in _WORD.findall(query)]
    n, mean = len(words), max(1.0, sum(map(len, words.values())) / max(1, len(words)))
    scores = {}
    for key, ws in words.items():
        total = 0.0
        for q in asked:
            having = sum(q in other for other in words.values())
            f = ws.count(q)
            total += math.log((n - having + 0.5) / (having + 0.5) + 1) * f * (K1 + 1) / (f + K1 * (1 - B + B * len(ws) / mean))
        scores[key] = total
    return max(scores, key=lambda k: scores[k])


def tex_files(archive: bytes) -> tuple[dict[str, str], list[str]]:
    """Path and text of the .tex files and paths of the .bbl files; nothing for what is no tar archive."""
    found, bbl = {}, []
    try:
        with tarfile.open(fileobj=io.BytesIO(archive)) as tar:
            for member in tar:
                if member.isfile() and member.name.endswith(".tex"):
                    found[member.name] = tar.extractfile(member).read().decode("utf-8", errors="ignore")
                elif member.name.endswith(".bbl"):
                    bbl.append(member.name)
    except (tarfile.TarError, EOFError, OSError):
        return {}, []
    return found, bbl


def main_text(archive: bytes | None, title: str | None = None) -> tuple[str | None, str | None]:
    """The main file's path and its clean text with \\input files put in, one level deep; None where there is none."""
    if archive is None:
        return None, None
    files, bbl = tex_files(archive)
    files = {p: cleaned(t) for p, t in files.items()}
    if not files:
        return None, None
    main = None
    if len(bbl) == 1:
        same = bbl[0].removesuffix(".bbl") + ".tex"
        main = same if same in files else None
    elif not bbl and len(files) == 1:
        main = next(iter(files))
    if main is None:
        begins = {p: t for p, t in files.items() if _BEGIN.search(t) and not re.search("example|sample|template", p)}
        if len(begins) == 1:
            main = next(iter(begins))
        elif begins:
            main = best_match(begins, title) if title else next(iter(begins))
    if main is None:
        return None, None

    def put_in(m: re.Match) -> str:
        name = m.group(1) if m.group(1).endswith(".tex") else m.group(1) + ".tex"
        return files.get(name, "")

    return main, _INPUT.sub(put_in, files[main])


def expand_archives(df: DataFrame, id_col: str, archive: str, title: str) -> DataFrame:
    """id, main_path and text of each TeX archive, a row for every input row; nulls where no main file is found."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [main_text(None if a is None else bytes(a), t) for a, t in zip(b["archive"], b["title"])]
            yield pd.DataFrame({"id": b["id"], "main_path": [x for x, _ in found], "text": [y for _, y in found]})

    chosen = df.select(F.col(id_col).cast("long").alias("id"), F.col(archive).alias("archive"), F.col(title).alias("title"))
    return chosen.mapInPandas(run, "id long, main_path string, text string")

"""Documents cut into chunks, as a table function of each document's text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame

#: Titles of sections without prose of their own, and what marks a heading and a fence.
REFERENCE_TITLES = frozenset(("references", "bibliography", "works cited", "citations", "notes", "footnotes", "endnotes", "end notes", "further reading", "sources"))
HEADING = re.compile(r"(#{1,6})[ \t\n\f\r]+(.+?)[ \t\n\f\r]*\Z")
FENCE = re.compile("`{3,}|~{3,}")
#: A bold label within the first ten lines, behind nothing but headings and blank lines; and the rule that ends such a block.
ATTRIBUTION = re.compile(r"(?:[^\S\n]*(?:#[^\n]*)?\n){0,9}[^\S\n]*(?=\*\*)[^\n]*:\*\*")
RULE = re.compile(r"^[^\S\n]*---[^\S\n]*$", re.M)
CHUNKS = "path string, chunk_index int, heading_path array<string>, text string, content_hash string"


def _size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def body_of(text: str) -> str:
    """A document without its front matter or leading attribution block."""
    start = text.lstrip("\n")
    fenced = re.match(r"---\r?\n", start)
    if fenced:
        close = start.find("\n---", 4)
        if close >= 0:
            return start[close + 4 :].lstrip("\n")
    rule = RULE.search(start) if ATTRIBUTION.match(start) else None
    return start[rule.end() + 1 :] if rule else text


def sections(text: str) -> Iterator[tuple[list[str], str]]:
    """Heading path and text of each section that has prose; reference sections and all below them are left out."""
    path: list[str] = []
    held: list[str] = []
    skipped = 0  # depth of the reference section that is being left out
    fenced = False
    for line in text.split("\n"):
        fence = FENCE.match(line)
        heading = None if fence or fenced else HEADING.match(line)
        fenced ^= bool(fence)
        if not heading:
            if not skipped:
                held.append(line)
            continue
        yield list(path), "\n".join(held)
        held = []
        depth, title = len(heading[1]), heading[2]
        if skipped and depth > skipped:
            continue
        skipped = depth if title.strip().lower() in REFERENCE_TITLES else 0
        if not skipped:
            path = [*path[: depth - 1], *[""] * (depth - 1 - len(path)), title]
    yield list(path), "\n".join(held)


def packed(parts: Iterable[str], most: int, between: str) -> Iterator[str]:
    """Parts joined up to ``most`` bytes; each join counts as long as ``between``."""
    held: list[str] = []
    filled = 0
    for part in parts:
        if held and filled + _size(part) + len(between) > most:
            yield between.join(held)
            held, filled = [], 0
        held.append(part)
        filled += _size(part) + len(between)
    if held:
        yield between.join(held)


def split_sentences(paragraph: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])[ \t\n\f\r]+", paragraph) if s]


def pieces(text: str, most: int) -> Iterator[str]:
    """Paragraphs packed to ``most`` bytes; a longer paragraph by its sentences, of which a longer one stays whole."""
    paragraphs = filter(None, (p.strip() for p in re.split(r"\n[^\S\n]*(?:\n[^\S\n]*)+", text)))
    for long, some in groupby(paragraphs, lambda p: _size(p) > most):
        if not long:
            yield from packed(some, most, "\n\n")
            continue
        for paragraph in some:
            # of sentences neither the last nor the next one's space counts
            yield from packed(split_sentences(paragraph), most + 2, " ")


def chunks_of(text: str | None, most: int = 12_000) -> list[tuple[list[str], str]]:
    """``(heading path, text)`` of a document's chunks, in order."""
    body = body_of(text or "")
    out = []
    has_headings = False
    fenced = False
    for line in body.split("\n"):
        if FENCE.match(line):
            fenced = not fenced
        elif not fenced and HEADING.match(line):
            has_headings = True
            break
    for path, part in sections(body) if has_headings else [([], body)]:
        part = part.strip()
        if part:
            out += [(path, part)] if has_headings and _size(part) <= most else [(path, p) for p in pieces(part, most)]
    return out


def chunk_documents(docs: DataFrame, path_col: str, text_col: str, most: int = 12_000) -> DataFrame:
    """``CHUNKS`` of every document; null and blank documents have none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (path, i, heads, text, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())
                for path, whole in zip(pdf["path"], pdf["text"])
                for i, (heads, text) in enumerate(chunks_of(whole, most))
            ]
            yield pd.DataFrame(rows, columns=["path", "chunk_index", "heading_path", "text", "content_hash"])

    return docs.selectExpr(f"cast({path_col} as string) as path", f"{text_col} as text").mapInPandas(cut, CHUNKS)

"""Splitting of texts into chunks. Splitters are plain functions of one text; columns apply them in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, functions as F

# Marks that end a sentence, how far back one is looked for, and the separator of joined parts.
SENTENCE_ENDS = ".!?\n"
LOOK_BACK = 200
JOINT = "\n\n"
# Structural boundaries in the order in which they are split on.
STRUCTURE = (
    r"\n#{1,6}\s+.+?\n",
    r"\n\n+",
    r"\n[-*+]\s+",
    r"\n\d+\.\s+",
    r"\n```.*?```\n",
    r"\n\|\s*.+?\|\s*\n",
)
CHUNK = "array<struct<content:string,index:int,start_char:int,end_char:int,true_start:int,token_count:int,split_method:string>>"

SectionSplitter = Callable[[str], list[str]]


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes in characters. The overlap has to be below the size, and the least size positive."""

    size: int = 1000
    overlap: int = 200
    most: int = 2000
    least: int = 100
    semantic: bool = True

    def __post_init__(self):
        if not 0 <= self.overlap < self.size:
            raise ValueError("chunk overlap must be less than chunk size")
        if self.least <= 0:
            raise ValueError("minimum chunk size must be positive")


def split_boundaries(text: str, config: ChunkConfig) -> list[str]:
    """Pieces of about the size that end behind a sentence mark in their last stretch, each starting inside the one before.

    A start always moves on, so settings whose overlap reaches back past a cut end too.
    """
    pieces, start, n = [], 0, len(text)
    while start + config.size < n:
        end = start + config.size
        low = max(start + config.least, end - LOOK_BACK) + 1
        mark = max((text.rfind(c, low, end + 1) for c in SENTENCE_ENDS), default=-1)
        cut = mark + 1 if mark >= 0 else end
        pieces.append(text[start:cut])
        start = max(cut - config.overlap, start + 1)
    if start < n:
        pieces.append(text[start:])
    return pieces


def _pack(parts, size: int):
    """Greedy joins of parts while the joined text is within the size."""
    held = ""
    for part in parts:
        joined = held + JOINT + part if held else part
        if len(joined) <= size:
            held = joined
            continue
        if held:
            yield held
        held = part
    if held:
        yield held


def pack_paragraphs(text: str, config: ChunkConfig) -> list[str]:
    """Paragraphs joined up to the size; longer ones are first split at sentence ends."""
    parts = []
    for paragraph in filter(None, (p.strip() for p in re.split(r"\n\s*\n", text))):
        parts += split_boundaries(paragraph, config) if len(paragraph) > config.size else [paragraph]
    return list(_pack(filter(None, (p.strip() for p in parts)), config.size))


def split_structure(text: str) -> list[str]:
    """Sections between headings, blank lines, list items, code and tables; separators are sections too, blank ones are dropped."""
    sections = [text]
    for pattern in STRUCTURE:
        sections = [p for s in sections for p in re.split(f"({pattern})", s, flags=re.M | re.S) if p.strip()]
    return sections


def split_semantic(text: str, config: ChunkConfig, long_section: SectionSplitter | None = None) -> tuple[list[str], str]:
    """(pieces, how they were made): sections joined up to the size, oversized ones given to ``long_section``.

    What it returns counts where its length is within the limits; if nothing does, or it fails, sentence ends decide. Texts within the
    size, and texts of which no piece reaches the least size, are split at sentence ends.
    """
    if not config.semantic or len(text) <= config.size:
        return split_boundaries(text, config), "simple"
    pieces, run = [], []

    def flush():
        pieces.extend(p.strip() for p in _pack(run, config.size))
        run.clear()

    for section in split_structure(text):
        if len(section) > max(config.most, config.size):
            flush()
            pieces += _long(section, config, long_section)
        else:
            run.append(section)
    flush()
    pieces = [p for p in pieces if len(p.strip()) >= config.least]
    return (pieces, "semantic") if pieces else (split_boundaries(text, config), "simple")


def _long(section: str, config: ChunkConfig, splitter: SectionSplitter | None) -> list[str]:
    try:
        found = [p.strip() for p in splitter(section)] if splitter else []
    except Exception:  # a provider's failure must not lose the section
        found = []
    return [p for p in found if config.least <= len(p) <= config.most] or split_boundaries(section, config)


def chunk_simple(text: str | None, config: ChunkConfig) -> list[tuple]:
    """Chunks of packed paragraphs. start_char is nominal: each chunk advances by its length less the overlap."""
    rows, at, seen = [], 0, 0
    for k, piece in enumerate(pack_paragraphs(text, config) if text and text.strip() else []):
        true = text.find(piece.split(JOINT)[0], seen)
        rows.append((piece, k, at, at + len(piece), true, len(piece) // 4, "simple"))
        at += max(0, len(piece) - config.overlap)
        seen = max(seen, true)
    return rows


def chunk_semantic(text: str | None, config: ChunkConfig, long_section: SectionSplitter | None = None) -> list[tuple]:
    """Chunks by structure. start_char is looked for behind the chunk before; true_start from that chunk's own start."""
    if not text or not text.strip():
        return []
    pieces, how = split_semantic(text, config, long_section)
    rows, at, seen = [], 0, 0
    for k, piece in enumerate(pieces):
        start = found if (found := text.find(piece, at)) >= 0 else at
        true = text.find(piece, seen)
        rows.append((piece.strip(), k, start, start + len(piece), true, len(piece.strip()) // 4, how))
        at, seen = start + len(piece), max(seen, true + 1)
    return rows


def chunk_column(content: Column, config: ChunkConfig = ChunkConfig(), simple: bool = False, long_section: SectionSplitter | None = None) -> Column:
    """Chunks of a text column as an array of structs; blank and null texts have none."""

    @F.pandas_udf(CHUNK)
    def run(texts: pd.Series) -> pd.Series:
        names = ("content", "index", "start_char", "end_char", "true_start", "token_count", "split_method")
        make = (lambda t: chunk_simple(t, config)) if simple else (lambda t: chunk_semantic(t, config, long_section))
        return texts.map(lambda t: [dict(zip(names, r)) for r in make(t)])

    return run(content)


def pieces_column(content: Column, config: ChunkConfig) -> Column:
    """Pieces of ``split_boundaries`` as an array of strings."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_boundaries(t, config) if t else [])

    return run(content)


def fixed_stride(content: Column, size: int, overlap: int) -> Column:
    """Pieces when no sentence end can be looked for (size within the least size): one every size - overlap characters. No Python."""
    step = size - overlap
    count = F.when(F.length(content) <= size, 1).otherwise(F.ceil((F.length(content) - size) / step) + 1).cast("int")
    # one pass over the text: every match takes a step and looks ahead for a piece, while substrings would each count from the start
    cut = F.slice(F.regexp_extract_all(content, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1)), F.lit(1), count)
    return F.when(F.length(content) > 0, cut).otherwise(F.array().cast("array<string>"))

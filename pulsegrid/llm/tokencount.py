"""Token counts by offset mapping: whole documents are encoded once, and tokens are attributed to the sections they lie in."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Pre-tokenizer of the byte-level vocabulary (a fixed value of the vocabulary file).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A section ends after a line break, or after a sentence's end and the blanks that follow.
SENTENCES = r"(?:[.!?][\x20\x09-\x0D]|\n)[\x20\x09-\x0D]*"
RULES = ("start", "end", "majority")
#: White space as the pre-tokenizer knows it, in runs that its backtracking had better not see.
LONG_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{1000,}")


@cache
def _encoding(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the bytes of each of its tokens."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encoded(text: str, encoding: tiktoken.Encoding) -> list[int]:
    """Tokens of ``text``. A long run of white space is a piece by itself but for its last character, which goes with what
    follows, as PATTERN has it; it is merged as one piece, so that runs of any length are encoded."""
    tokens, begin = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        tokens += encoding.encode_ordinary(text[begin : run.start()])
        tokens += encoding._encode_single_piece(text[run.start() : end])
        begin = end
    return tokens + encoding.encode_ordinary(text[begin:])


def token_spans(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character and end character of every token. Byte-level tokens follow each other without gaps, so lengths give offsets;

    tokens that share the bytes of one character all span it.
    """
    encoding, sizes = _encoding(path)
    ends = np.cumsum(sizes[np.array(encoded(text, encoding), np.int64)])
    if not len(ends):
        return ends, ends
    starts = np.concatenate(([0], ends[:-1]))
    if len(text) == ends[-1]:
        return starts, ends
    character = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80) - 1
    return character[starts], character[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """The section (of ``bounds[i] .. bounds[i + 1]``) of each token, and whether it crosses a boundary.

    start: the section of its first character; end: of its last; majority: the one with most of its characters, of equals the first.
    """
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, ends - 1, side="right") - 1
    crossing = first != last
    if rule == "start":
        return first, crossing
    if rule == "end":
        return last, crossing
    section = first.copy()
    for t in np.flatnonzero(crossing).tolist():  # few tokens, of few characters
        cuts = np.clip(bounds[first[t] : last[t] + 2], starts[t], ends[t])
        section[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return section, crossing


def count_sections(docs: DataFrame, path: str, boundary: str = SENTENCES, rule: str = "majority", text_col: str = "text", fields: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """``docs`` with n_tokens, n_sections, n_crossing and section_tokens (array, one count per section) after ``prefix``.

    The document is the text, or ``fields`` joined by line breaks; it is encoded whole and once. Without ``fields``, sections
    end where ``boundary`` matches; with them, each field (and the break behind it) is one section. Every token counts in exactly one
    section. A null field or text is empty; an empty text is one empty section. Input columns of these names are replaced.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [prefix + n for n in ("n_tokens", "n_sections", "n_crossing", "section_tokens")]
    docs = docs.drop(*names)
    ends_at = re.compile(boundary)

    def sections(values: list[str | None]) -> tuple[str, np.ndarray]:
        if fields:
            parts = [v or "" for v in values]
            text = "\n".join(parts)
            return text, np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts[:-1]], dtype=np.int64), [len(text)]))
        text = values[0] or ""
        cuts = [m.end() for m in ends_at.finditer(text)]
        return text, np.array([0, *cuts] + ([len(text)] if not cuts or cuts[-1] < len(text) else []), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1024):
                rows = batch.slice(begin, 1024)
                totals, sizes, crossings, lists = [], [], [], []
                for values in zip(*[rows.column(c).to_pylist() for c in fields or (text_col,)], strict=True):
                    text, bounds = sections(values)
                    section, crossing = attribute(*token_spans(text, path), bounds, rule)
                    totals.append(len(section))
                    sizes.append(len(bounds) - 1)
                    crossings.append(int(crossing.sum()))
                    lists.append(np.bincount(section, minlength=len(bounds) - 1))
                added = [pa.array(totals, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crossings, pa.int64()), pa.array(lists, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *added], [*rows.schema.names, *names])

    kinds = [T.LongType(), T.LongType(), T.LongType(), T.ArrayType(T.LongType())]
    return docs.mapInArrow(count, T.StructType([*docs.schema.fields, *[T.StructField(n, k) for n, k in zip(names, kinds, strict=True)]]))

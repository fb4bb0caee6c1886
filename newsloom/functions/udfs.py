"""Arrow UDFs, for what Spark has no built-in function for. Each works on whole batches."""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from urllib.parse import urljoin

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import vocabulary as V


@F.pandas_udf(T.StringType())
def unescape(c: pd.Series) -> pd.Series:
    """All HTML entities resolved."""
    return c.map(lambda x: html.unescape(x) if x is not None else None)


@F.pandas_udf(T.StringType())
def ascii_fold(c: pd.Series) -> pd.Series:
    """Entities resolved, letters decomposed, what is not ASCII dropped."""
    return c.map(lambda x: unicodedata.normalize("NFKD", html.unescape(x or "")).encode("ascii", "ignore").decode("ascii"))


def _fold(value: str) -> str:
    out = []
    for ch in value:
        if ch in V.LATIN_EXTRA:
            out.append(V.LATIN_EXTRA[ch])
        elif ch > "\x7f" and unicodedata.name(ch, "").find("LATIN") >= 0:
            out.extend(c for c in unicodedata.normalize("NFKD", ch) if unicodedata.combining(c) == 0)
        else:
            out.append(ch)
    return "".join(out)


@F.pandas_udf(T.StringType())
def match_key(c: pd.Series) -> pd.Series:
    """A loose key of names: case, accents of Latin letters, marks and punctuation do not count."""
    marks, quotes = str.maketrans("", "", "™®©"), str.maketrans("", "", "™®©'‘’`´")

    def key(x: str | None) -> str:
        value = unicodedata.normalize("NFKC", html.unescape(x or "").translate(marks)).casefold()
        value = _fold(value).translate(quotes)
        return " ".join("".join(ch if ch in "0123456789" or "a" <= ch <= "z" or "؀" <= ch <= "ۿ" else " " for ch in value).split())

    return c.map(key)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of matching blocks of two texts, 0 if one is empty; not symmetric."""
    return pd.Series([SequenceMatcher(a=x, b=y).ratio() if x and y else 0.0 for x, y in zip(a, b, strict=True)], index=a.index, dtype="float64")


# fixed values: letters counted apart, the others together, and up to how many
_LETTERS = {ch: k for k, ch in enumerate("abcdefghijklmnopqrstuvwxyz0123456789 ")}
_MOST, _KINDS = 6, 10
MARKS = 4


@F.pandas_udf(T.ArrayType(T.LongType()))
def letter_marks(c: pd.Series) -> pd.Series:
    """How often each letter occurs, six times at most, one bit a time: bits that differ between two texts are letters without a partner."""

    def marks(x: str | None) -> list[int]:
        out, counts = [0] * MARKS, Counter(_LETTERS.get(ch, len(_LETTERS)) for ch in x or "")
        for kind, n in counts.items():
            out[kind // _KINDS] |= ((1 << min(n, _MOST)) - 1) << kind % _KINDS * _MOST
        return out

    return c.map(marks)


_WORD, _BLOCK, _PAIRS = 64, 64, 1 << 16


class _Titles:
    """A side of a cell: texts with their letter marks, and the codes and masks of their letters, made once."""

    def __init__(self, cell: dict, side: str):
        self.h, self.text = cell[f"{side}_h"], cell[f"{side}_title"]
        self.marks = np.array(cell[f"{side}_m"], np.int64).reshape(-1, MARKS)
        self.length = np.array([len(x) for x in self.text], np.int64)

    def codes(self) -> np.ndarray:
        out = np.full((len(self.text), int(self.length.max(initial=0))), len(_LETTERS) + 1, np.intp)
        for k, x in enumerate(self.text):
            out[k, : len(x)] = [_LETTERS.get(ch, len(_LETTERS)) for ch in x]
        return out

    def masks(self) -> np.ndarray:
        """Of each letter the places it has, one bit a place; the last, for places after an end, has none."""
        out = np.zeros((len(self.text), len(_LETTERS) + 2), np.uint64)
        for k, x in enumerate(self.text):
            for at, ch in enumerate(x[:_WORD]):
                out[k, _LETTERS.get(ch, len(_LETTERS))] |= np.uint64(1 << at)
        return out


def _common(codes: np.ndarray, masks: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each pair, bit by bit in parallel; b within a word. Rare letters are all one, so it may be too long, never too short."""
    v = np.full(len(a), ~np.uint64(0))
    for at in range(codes.shape[1]):
        u = v & masks[b, codes[a, at]]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v).astype(np.int64)


def _bounded(cell: dict, threshold: float, seq: float, jac: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b and the bound of the score of a cell's pairs that may reach the threshold: first by their letters, then by their common subsequence."""
    a, b = _Titles(cell, "a"), _Titles(cell, "b")
    shared = cell["o"] / (cell["a_n"] + cell["b_n"] - cell["o"]) * jac
    least = (threshold - 1e-9 - shared) / seq
    near: list[list] = [[], []]
    for at in range(0, len(a.text), _BLOCK):
        x = slice(at, at + _BLOCK)
        letters = np.zeros((len(a.text[x]), len(b.text)), np.uint8)
        for k in range(MARKS):
            letters += np.bitwise_count(a.marks[x, k, None] ^ b.marks[None, :, k])
        most = np.minimum((a.length[x, None] + b.length[None, :]) * (1 - least), 255).astype(np.uint8)  # no more letters than 240 are counted
        i, j = np.nonzero(letters <= most)
        near[0].append(i + at)
        near[1].append(j)
    i, j = (np.concatenate(x) for x in near)
    codes, masks, bounds = a.codes(), b.masks(), [np.zeros(0)]
    for at in range(0, len(i), _PAIRS):
        x, y = i[at : at + _PAIRS], j[at : at + _PAIRS]
        common = np.where(b.length[y] > _WORD, np.minimum(a.length[x], b.length[y]), _common(codes, masks, x, y))
        bounds.append(2.0 * common / (a.length[x] + b.length[y]) * seq + shared)
    bound = np.concatenate(bounds)
    fits = bound >= threshold - 1e-9
    return np.array(a.h, np.int64)[i[fits]], np.array(b.h, np.int64)[j[fits]], bound[fits]


def bounded_cells(threshold: float, seq: float, jac: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: rows are cells (o, a_n, a_h, a_title, a_m, b_n, ...), all of whose titles a share o words with all titles b; gives (a_h, b_h, bound)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = _bounded({n: batch.column(n)[row].as_py() for n in batch.schema.names}, threshold, seq, jac)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a_h", "b_h", "bound"])

    return run


@F.pandas_udf(T.StringType())
def join_url(base: pd.Series, url: pd.Series) -> pd.Series:
    return pd.Series([urljoin(x or "", y or "") for x, y in zip(base, url, strict=True)], index=base.index)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_nodes(c: pd.Series) -> pd.Series:
    """Every object of a list of JSON documents, nested ones too, as JSON text in document order."""

    def of(documents) -> list[str]:
        todo, found = [json.loads(d) for d in documents if d is not None][::-1], []
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                found.append(json.dumps(node, ensure_ascii=False))
                node = list(node.values())
            if isinstance(node, list):
                todo.extend(reversed(node))
        return found

    return c.map(lambda x: [] if x is None else of(x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescape_each(c: pd.Series) -> pd.Series:
    """All HTML entities of each text of a list resolved."""
    return c.map(lambda values: None if values is None else [None if x is None else html.unescape(x) for x in values])


def _jpeg(data: bytes) -> tuple[int, int] | None:
    """Width and height of the first frame header; other segments are passed over by their lengths."""
    at = 2
    while found := _SEGMENT.search(data, at):
        marker, length = found["marker"][0], int.from_bytes(found["length"] or b"", "big")
        if marker in _FRAMES:
            frame = data[found.end() : found.end() + 5]
            return (int.from_bytes(frame[3:5], "big"), int.from_bytes(frame[1:3], "big")) if len(frame) == 5 else None
        if length < 2:
            return None
        at = found.end("marker") + length
    return None


# fixed values: markers of image headers
_SEGMENT = re.compile(rb"\xff+(?P<marker>[\x01-\xd7\xda-\xfe])(?P<length>..)?", re.DOTALL)
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
_HEADERS = [
    # a header that the format's files begin with, and how its fields give width and height
    (re.compile(rb"\x89PNG\r\n\x1a\n.{8}(.{4})(.{4})", re.DOTALL), lambda w, h: (int.from_bytes(w, "big"), int.from_bytes(h, "big"))),
    (re.compile(rb"RIFF.{4}WEBPVP8X.{8}(.{3})(.{3})", re.DOTALL), lambda w, h: (1 + int.from_bytes(w, "little"), 1 + int.from_bytes(h, "little"))),
    (re.compile(rb"RIFF.{4}WEBPVP8L.{4}\x2f(.{4})(?=.{5})", re.DOTALL), lambda bits: tuple(1 + (int.from_bytes(bits, "little") >> k) % 0x4000 for k in (0, 14))),
]


def _dimensions(data: bytes | None) -> tuple[int, int]:
    for header, size in _HEADERS:
        if found := header.match(data or b""):
            return size(*found.groups())
    return (_jpeg(data) if data and data.startswith(b"\xff\xd8") else None) or (0, 0)


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_dimensions(c: pd.Series) -> pd.DataFrame:
    """Of PNG, JPEG and WebP headers; 0 by 0 where the format does not say."""
    return pd.DataFrame([_dimensions(x) for x in c], columns=["width", "height"])

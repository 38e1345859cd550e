"""Fill-in-middle: texts are cut at two drawn boundaries between units and their parts put in another order, and back.

A text is an array of UTF-32 code points. Every code point has a class; where neighbours differ in class a unit ends, so the
boundaries are the flat indices of differences. Two drawn ranks pick two of the boundaries; the pieces between are slices of
the array, encoded anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from .common import STEP_BYTES
from .tokens import text_steps

#: What stands before the prefix, the suffix and the middle; a text that holds one of them stays plain.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents so many are cut, and of a hundred cut ones so many have the suffix first.
CUT_PERCENT, SUFFIX_FIRST_PERCENT = 90, 20
_SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def text_of(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def char_classes(points: np.ndarray) -> np.ndarray:
    """Every code point differs from its neighbours."""
    return np.arange(len(points)) & 1


def word_classes(points: np.ndarray) -> np.ndarray:
    """White space (\\x20, \\x09 to \\x0D) against the rest: words and the gaps between them are the units."""
    return np.isin(points, _SPACES)


def line_classes(points: np.ndarray) -> np.ndarray:
    """A line with its line feed is a unit."""
    return np.r_[0, np.cumsum(points[:-1] == 10)] if len(points) else points


UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"char": char_classes, "word": word_classes, "line": line_classes}


def boundaries(points: np.ndarray, unit: str = "char") -> np.ndarray:
    """Where units begin or end: 0, every place before which the class changes, and the end. A text of n units has n + 1."""
    if not len(points):
        return np.zeros(1, np.int64)
    classes = UNITS[unit](points)
    return np.r_[0, np.flatnonzero(classes[1:] != classes[:-1]) + 1, len(points)]


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four unsigned 32-bit numbers of a document: the first hex groups of sha256 of `seed:doc_id`."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def transformed(text: str, h: list[int], unit: str, marks: tuple[str, str, str], cut_percent: int, suffix_first: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text by its four draws."""
    points = code_points(text)
    at = boundaries(points, unit)
    n = len(at) - 1
    if not text or any(m in text for m in marks) or h[2] % 100 >= cut_percent:
        return n, "plain", None, None, text
    low, high = (int(x) for x in at[np.sort([h[0] % (n + 1), h[1] % (n + 1)])])
    p, s, m = marks
    prefix, middle, suffix = text_of(points[:low]), text_of(points[low:high]), text_of(points[high:])
    if h[3] % 100 < suffix_first:
        return n, "spm", low, high - low, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", low, high - low, "".join((p, prefix, s, suffix, m, middle))


def restored(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> str:
    """The text that `transformed` was given, from its output and form alone."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


def _checked(marks: tuple[str, str, str]) -> None:
    """A mark inside another, or one that begins in the end of one, could be found where none was set."""
    for i, a in enumerate(marks):
        for j, b in enumerate(marks):
            if not a or (i != j and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError("marks must be distinct, not empty, and must not overlap")


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: str = "1", marks: tuple[str, str, str] = MARKS, cut_percent: int = CUT_PERCENT, suffix_first: int = SUFFIX_FIRST_PERCENT) -> DataFrame:
    """Cuts every whole text of docs(doc_id, text) into prefix, middle and suffix at boundaries between units and reorders them.

    unit: `char` (code points), `word` (runs of white space and of the rest) or `line`. Draws come from seed and doc_id alone,
    so rows of one doc_id are drawn alike, null ids like an empty one. form: `plain` (the text as it is: null and empty texts,
    texts that hold a mark, and those beyond cut_percent), `psm` (prefix, suffix, middle) or `spm` (suffix, prefix, middle).
    Repeated rows give a row each, an empty table none; other columns are ignored; a text takes about eight bytes of memory
    for each code point in its task. Returns doc_id, n (units), form, prefix_chars, middle_chars (code points, null if plain),
    output.
    """
    _checked(marks)
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            keys = batch.column(0).cast(pa.int64())
            for i, texts in text_steps(batch.column(1), STEP_BYTES):
                part = keys.slice(i, len(texts))
                rows = [transformed(t, draws(seed, k), unit, marks, cut_percent, suffix_first) for k, t in zip(part.to_pylist(), texts, strict=True)]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part, *columns], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore_texts(rows: DataFrame, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """rows of fill_in_middle with a column `restored`: the text made from `output` and `form` alone. A null output stays null."""
    _checked(marks)
    plain = rows.drop("restored")
    schema = StructType([*plain.schema, StructField("restored", StringType())])

    def run(batches):
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            forms = batch.column(at["form"])
            for i, texts in text_steps(batch.column(at["output"]), STEP_BYTES):
                part = batch.slice(i, len(texts))
                valid = part.column(at["output"]).is_valid().to_pylist()
                back = [restored(t, f, marks) if v else None for t, f, v in zip(texts, forms.slice(i, len(texts)).to_pylist(), valid, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.string())], names=[*at, "restored"])

    return plain.mapInArrow(run, schema)

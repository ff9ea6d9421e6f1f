"""Vectorised text normalisation: Arrow kernels over whole batches, never a Python loop over characters."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Page headers and footers, each on a line of its own (RE2 and Python alike).
PAGE = (
    r"(?m)^[ \t]*(?:Page \d+ of \d+[^\n]*|-- ?[^\n]{0,60} / \d+ --|[^\n]{3,80} {2,}\S+ {2,}- ?\d+ ?-|\[p\. ?\d+\][^\n]*)[ \t]*$"
)
#: Number of a paragraph at the start of a line.
NUMBER = r"(?m)^[ \t]*(?:<p>)?[ \t]*(?:\[\d{1,3}\]|\(\d{1,3}\)|§ ?\d{1,3}|\d{1,3}\.)(?:<p>|[ \t])+"
TAG = r"<[^<>\n]{1,40}>"
_page, _number, _tag = re.compile(PAGE, re.A), re.compile(NUMBER, re.A), re.compile(TAG)
_hyphen = re.compile(r"[-‐‑\xad]\s*\n\s*|\xad")
# Fixed value: marks that stand for a blacked-out word.
BLANK = r"\[(?:redacted|name withheld|\.\.\.|…|omitted)\]|█+|\*{3,}|_{3,}"
_blank = re.compile(BLANK)
# Fixed value: entities that stand for no letter or digit.
MARKS = r"&(?:nbsp|amp|lt|gt|quot|apos|shy|ndash|mdash|hellip|lsquo|rsquo|ldquo|rdquo|#160|#39|#34|#38|#x27|#xa0|#xA0);"
#: A word longer than this counts as several, so that a number of words bounds a number of characters.
LONGEST = 64


def sub(texts: pa.Array, pattern: str, by: str) -> pa.Array:
    return pc.replace_substring_regex(texts, pattern=pattern, replacement=by)


def without_pages(texts: pa.Array) -> pa.Array:
    """Line ends made equal, lines of page headers emptied; null stays null."""
    return sub(sub(texts, r"\r\n?", "\n"), PAGE, "")


def slices(batch: pa.RecordBatch, text: str, rows: int, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``rows`` rows and, but for single longer texts, ``size`` bytes of text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64"))
    lo = 0
    while lo < batch.num_rows:
        before = total[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(total, before + size, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def squeezed_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """:func:`squeezed` of all texts as one stream of UTF-8 bytes and the offsets of the texts in it; null counts as empty.

    Texts with entities that stand for letters, or that only look like entities, are squeezed one by one."""
    t = sub(without_pages(pc.fill_null(texts, "")), NUMBER, "\n")
    t = sub(sub(t, TAG, " "), MARKS, " ")
    odd = pc.match_substring_regex(t, r"&[#A-Za-z]").to_numpy(zero_copy_only=False)
    t = sub(sub(pc.utf8_lower(t), BLANK, " "), r"[^\p{L}\p{N}]+", "")
    if isinstance(t, pa.ChunkedArray):
        t = t.combine_chunks()
    if odd.any():
        t = pa.array([squeezed(texts[i].as_py() or "") if o else x for i, (o, x) in enumerate(zip(odd, t.to_pylist()))], type=pa.string())
    _, offsets, data = t.buffers()
    first = np.frombuffer(offsets, dtype="int32")[t.offset : t.offset + len(t) + 1].astype("int64") if len(t) else np.zeros(1, dtype="int64")
    stream = np.frombuffer(data, dtype="uint8")[first[0] : first[-1]] if data is not None else np.empty(0, dtype="uint8")
    return stream, first - first[0]


def cleaned(text: str) -> str:
    """Lower-case text without markup, page headers and numbers of paragraphs, words at line ends put together again."""
    t = _page.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))
    t = html.unescape(_tag.sub(" ", _number.sub("\n", t))).lower()
    return _blank.sub(" \u2588 ", _hyphen.sub("", t))


def squeezed(text: str) -> str:
    """Lower-case letters and digits only, of the cleaned text."""
    return "".join(c for c in cleaned(text) if c.isalnum())


def squeezed_words(text: str) -> list[str]:
    """Words between blanks, reduced to lower-case letters and digits."""
    words = ("".join(c for c in w if c.isalnum()) for w in text.lower().split())
    return [w for w in words if w]


def document_words(text: str) -> list[str]:
    """Words of the cleaned text; what was blacked out counts as one word, a word of more than ``LONGEST`` characters as several."""
    words = ("\u2588" if "\u2588" in w else "".join(c for c in w if c.isalnum()) for w in cleaned(text).split())
    return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]

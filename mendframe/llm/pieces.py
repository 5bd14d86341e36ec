"""Texts of an Arrow batch as codes of distinct blank-separated pieces, so that each distinct piece is tokenised once."""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def split_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct pieces between single blanks (U+0020), the code of each piece, and the offsets of the texts' codes.

    "a  b" has the pieces "a", "" and "b"; an empty or null text has the piece "".
    """
    lists = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
    coded = pc.dictionary_encode(lists.flatten())
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), offsets - offsets[0]


def gather(flat: np.ndarray, starts: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """flat[starts[c]:starts[c + 1]] of all codes c one after the other, and where each begins (one more at the end)."""
    lengths = np.diff(starts)[codes]
    ends = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    index = np.arange(ends[-1], dtype=np.int64) - np.repeat(ends[:-1] - starts[:-1][codes], lengths)
    return flat[index], ends

"""Words of whole blocks of texts: told apart by Arrow, looked up once each, and put together by numpy."""

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from auditloom.llm.shared import give_back, slices


def array_slices(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of a batch with about ``limit`` bytes of text each; null is the empty text."""
    texts = batch.column(column).cast(pa.large_string()).fill_null("")
    for start, end in slices(pc.binary_length(texts).to_numpy(), limit):
        yield batch.slice(start, end - start), texts.slice(start, end - start)
    # Workers stay for later stages; what this batch took goes back.
    give_back()


def spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers begins[i], begins[i] + 1, ... of every range, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(begins - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class RowsByWord:
    """A list of values for each word seen, all in one flat array.

    ``work_out`` gives the values of new words, end to end, and their lengths. With more
    than ``most`` words the table starts anew.
    """

    def __init__(self, dtype, most: int, work_out: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.dtype, self.most, self.work_out = dtype, most, work_out
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.empty(0, dtype=self.dtype)
        self.begins = self.lengths = np.empty(0, dtype=np.int64)

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each word in the table; good until the next call."""
        told = words.dictionary_encode()
        # Several times faster than to_pylist, and the same words.
        different = told.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > self.most:
            self._clear()
        known = self.known
        numbers = np.fromiter(map(known.get, different, repeat(-1)), dtype=np.int64, count=len(different))
        at = np.flatnonzero(numbers < 0)
        if len(at):
            new = different[at].tolist()
            values, lengths = self.work_out(new)
            numbers[at] = np.arange(len(known), len(known) + len(new))
            known.update(zip(new, range(len(known), len(known) + len(new))))
            begins = len(self.flat) + np.cumsum(lengths) - lengths
            self.flat = np.concatenate([self.flat, values.astype(self.dtype, copy=False)])
            self.begins = np.concatenate([self.begins, begins])
            self.lengths = np.concatenate([self.lengths, lengths])
        return numbers[told.indices.to_numpy()]

    def gather(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of many words, end to end, and the length of each."""
        lengths = self.lengths[numbers]
        return self.flat[spread(self.begins[numbers], lengths)], lengths


def sums_of(lengths: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of neighbouring lengths between the offsets."""
    total = np.concatenate([[0], np.cumsum(lengths)])
    return total[offsets[1:]] - total[offsets[:-1]]

"""Token counts: whole texts under a byte-pair vocabulary; huge ones in overlapping chunks that are spliced.

A text longer than `chunk` characters is cut into chunks that overlap. Each is
encoded on its own, with the byte offset of every token. Two neighbours are
spliced at a position of their overlap where both have a token boundary and
where the text itself proves one: a single space that follows something other
than white space and precedes a letter. The pre-tokenizer's expression can hold
a space inside a match only within a run of white space, so no match crosses
such a place, whatever comes before; from there both encodings agree, and that
is checked on the tokens of the rest of the overlap. Where an overlap has no
such place, or the check fails, it is widened twofold, up to the whole rest of
the text, so that the count always equals that of the text encoded at once.

Defined results: null text has a null count, empty text 0; rows are counted
each for itself, so repeated rows and null ids change nothing; other columns
are ignored. Special tokens' strings count as ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 32_768, 512
_PROVEN = r"(?<=\S) (?=\p{L})"


class Encoder:
    """A vocabulary of ranks as tiktoken has it, with the byte length of each token."""

    def __init__(self, path: str = VOCABULARY) -> None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.length[i] = len(token)
        self.proven = regex.compile(_PROVEN)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int64)

    def whole(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def boundaries(self, tokens: np.ndarray) -> np.ndarray:
        """Byte offsets at which tokens begin, and the end."""
        return np.concatenate([[0], np.cumsum(self.length[tokens])])

    def splice(self, a: np.ndarray, b: np.ndarray, before: int, shared: str) -> tuple[int, int] | None:
        """Tokens of a to keep, and of b to skip; before: bytes of a ahead of the overlap, whose text is shared."""
        left, right = self.boundaries(a), self.boundaries(b)
        for m in self.proven.finditer(shared):
            p = len(shared[: m.start()].encode())
            i, j = int(np.searchsorted(left, before + p)), int(np.searchsorted(right, p))
            if i >= len(left) or left[i] != before + p or j >= len(right) or right[j] != p:
                continue
            # all tokens up to the last proven place of the overlap must agree: beyond it a's end may cut a match
            last = None
            for last in self.proven.finditer(shared, m.end()):
                pass
            if last is None:
                continue
            q = len(shared[: last.start()].encode())
            u, v = int(np.searchsorted(left, before + q)), int(np.searchsorted(right, q))
            if u < len(left) and v < len(right) and left[u] == before + q and right[v] == q and np.array_equal(a[i:u], b[j:v]):
                return i, j
            return None
        return None

    def chunked(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
        """Tokens of a text, chunks it took, and how often an overlap was widened."""
        n = len(text)
        if n <= chunk:
            return self.whole(text), 1, 0
        starts = range(0, n, chunk)
        count, skip, chunks, widened = 0, 0, 0, 0
        for start in starts:
            stop = min(n, start + chunk)
            if stop == n:
                count += len(self.encode(text[start:])) - skip
                chunks += 1
                break
            width = overlap
            while True:
                end = min(n, stop + width)
                a = self.encode(text[start:end])
                chunks += 1
                if end == n:
                    count += len(a) - skip
                    return count, chunks, widened
                # the head of the next chunk is all that the splice needs of it
                b = self.encode(text[stop:end])
                got = self.splice(a, b, len(text[start:stop].encode()), text[stop:end])
                if got is not None and got[0] >= skip:
                    count += got[0] - skip
                    skip = got[1]
                    break
                width *= 2
                widened += 1
        return count, chunks, widened


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_tokens, n_bytes, chunks and widened for each row."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for b in batches:
            rows = []
            for v in b.column(1):
                t = v.as_py()
                rows.append((None, None, 0, 0) if t is None else (*(x := encoder.chunked(t, chunk, overlap))[:1], len(t.encode()), *x[1:]))
            tokens, size, chunks, widened = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (tokens, size, chunks, widened))], names=["doc_id", "n_tokens", "n_bytes", "chunks", "widened"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(kernel, "doc_id long, n_tokens long, n_bytes long, chunks long, widened long")

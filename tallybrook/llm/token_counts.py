"""Token counts of whole texts by a public tokenizer, with overlap resynchronisation.

Huge documents are encoded as overlapping chunks with offsets.  Neighbouring
chunks are spliced at a *proven* stable boundary: a position in the overlap where
both encodings begin a pre-token.  The byte-level pre-tokenizer is a left-to-right
scan without look-behind, so from such a position on the right chunk continues as
the whole text would; and the left chunk is right up to there, because at least
``_EDGE`` more characters of it follow.  If an overlap holds no such position the
overlap is widened, in the limit to the whole text.

Ordinary documents are cut where the scan always restarts, before a space that
follows a character that is no white space; equal cuts are encoded once per block
and remembered, which is most of the work on prose.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallybrook.llm.text import blocks, buffer_of, small_batches

#: Characters of the left chunk that must follow a splice; longer than any special token.
_EDGE = 32
_MEMO_ROWS = 700_000
_BLOCK = 4 << 20
_encoders: dict[str, "Encoder"] = {}

_SPACE_ASCII = np.zeros(256, dtype=bool)
_SPACE_ASCII[[0x20, *range(0x09, 0x0E), 0x1C, 0x1D, 0x1E, 0x1F]] = True


class Encoder:
    """One tokenizer per Python worker, with the counts of the cuts seen so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.plain = Tokenizer.from_file(path)
        self.plain.no_truncation()
        self.plain.no_padding()
        self.spans = Tokenizer.from_file(path)
        self.spans.no_truncation()
        self.spans.no_padding()
        self.spans.post_processor = processors.ByteLevel(trim_offsets=False)
        self.memo: dict[str, int] = {}
        added = {i: len(t.content.encode()) for i, t in self.plain.get_added_tokens_decoder().items()}
        # in a byte-level vocabulary each character of a token stands for one byte
        self.lengths = np.array([added.get(i, len(self.plain.id_to_token(i) or "")) for i in range(max(self.plain.get_vocab().values()) + 1)])

    @staticmethod
    def at(path: str) -> "Encoder":
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def count_cuts(self, cuts: list[str]) -> np.ndarray:
        """Tokens of each of some distinct strings."""
        if len(self.memo) > _MEMO_ROWS:
            self.memo.clear()
        memo = self.memo
        new = [c for c in cuts if c not in memo]
        whole = [c for c in new if c[0] == " " and c[-1] > " " and c[-1].isascii()]
        rest = [c for c in new if not (c[0] == " " and c[-1] > " " and c[-1].isascii())]
        for i in range(0, len(whole), 8192):
            self._count_joined(whole[i : i + 8192])
        for i in range(0, len(rest), 4096):
            self._count_each(rest[i : i + 4096])
        return np.fromiter(map(memo.__getitem__, cuts), dtype=np.int64, count=len(cuts))

    def _count_each(self, cuts: list[str]) -> None:
        self.memo.update(zip(cuts, (len(e.ids) for e in self.plain.encode_batch_fast(cuts, add_special_tokens=False)), strict=True))

    def _count_joined(self, cuts: list[str]) -> None:
        """Cuts that begin with a space and end in no white space stay apart in one text: one call, far less overhead."""
        ids = np.array(self.plain.encode_batch_fast(["".join(cuts)], add_special_tokens=False)[0].ids)
        ends = np.cumsum([len(c.encode()) for c in cuts])
        heads = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        counts = np.diff(np.searchsorted(heads, ends), prepend=0)
        if heads[-1] + self.lengths[ids[-1]] == ends[-1] and np.isin(ends[:-1], heads).all():
            self.memo.update(zip(cuts, counts.tolist(), strict=True))
        else:
            self._count_each(cuts)

    def starts(self, text: str) -> tuple[dict[int, int], int]:
        """Where pre-tokens begin, with the number of tokens before; and the number of all tokens."""
        e = self.spans.encode(text, add_special_tokens=False)
        words, offsets = e.word_ids, e.offsets
        return {offsets[i][0]: i for i in range(len(words)) if not i or words[i] != words[i - 1]}, len(words)

    def count_huge(self, text: str, chunk: int, overlap: int) -> tuple[int, int]:
        """Tokens of one text by overlapping chunks of ``chunk + overlap`` characters, and how many chunks were spliced."""
        while chunk + overlap < len(text):
            total, begin, at, before, many = 0, 0, 0, self.starts(text[: chunk + overlap]), 1
            while True:
                heads, size = before
                first = heads[at - begin]
                if begin + chunk + overlap >= len(text):
                    return total + size - first, many
                nxt = begin + chunk
                after = self.starts(text[nxt : nxt + chunk + overlap])
                last = begin + chunk + overlap - _EDGE
                common = next((p for p in sorted(after[0]) if nxt + p <= last and nxt - begin + p in heads), None)
                if common is None:
                    break
                at = nxt + common
                total += heads[at - begin] - first
                begin, before, many = nxt, after, many + 1
            overlap *= 4
            chunk = max(chunk, 2 * overlap)
        return len(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids), 1


def _cut_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row starts, and every space that follows a byte that can't end a white space character."""
    space = data == 0x20
    prev = np.zeros(len(data), np.uint8)
    prev[1:] = data[:-1]
    prev2 = np.zeros(len(data), np.uint8)
    prev2[2:] = data[:-2]
    wide = (prev >= 0x80) & (((prev2 == 0xC2) & ((prev == 0x85) | (prev == 0xA0))) | (prev2 == 0x9A) | (prev2 == 0x80) | (prev2 == 0x81))
    cut = space & ~_SPACE_ASCII[prev] & ~wide
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    return np.flatnonzero(cut)


def _count_block(encoder: Encoder, column: pa.Array, huge: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = buffer_of(column)
    sizes = np.diff(offsets)
    chunks = np.ones(len(sizes), dtype=np.int64)
    tokens = np.zeros(len(sizes), dtype=np.int64)
    long = sizes > huge
    if long.any():  # bytes first: characters are no more
        for row in np.flatnonzero(long):
            text = column[int(row)].as_py()
            tokens[row], chunks[row] = encoder.count_huge(text, huge, overlap) if len(text) > huge + overlap else (-1, 1)
        long &= tokens >= 0
        short = np.flatnonzero(~long)
        column = column.take(pa.array(short))
        data, offsets = buffer_of(column)
    else:
        short = np.arange(len(sizes))
    if len(data):
        starts = _cut_starts(data, offsets)
        bounds = np.append(starts, len(data)).astype(np.int32)
        cuts = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
        counts = encoder.count_cuts(cuts.dictionary.to_pylist())[cuts.indices.to_numpy()]
        total = np.concatenate([[0], np.cumsum(counts)])
        edges = np.searchsorted(starts, offsets)
        tokens[short] = total[edges[1:]] - total[edges[:-1]]
    return sizes, tokens, chunks


def count_tokens(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, huge_chars: int = 8_192, overlap_chars: int = 256) -> DataFrame:
    """Per row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``), n_chunks (overlapping chunks that were
    spliced; 1 for a text of at most ``huge_chars`` + ``overlap_chars`` characters).

    ``tokenizer`` is the path of a byte-level BPE file of the ``tokenizers`` library,
    readable on every executor.  No begin, end or added special tokens; special
    strings inside texts as the library does by default; no truncation or padding.
    A null or empty text has 0 bytes and 0 tokens.  Repeated rows and null ids are
    kept as they are; other columns are not read.  An empty table gives no rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(tokenizer)
        for block in blocks(batches, "text", _BLOCK):
            sizes, tokens, chunks = _count_block(encoder, block.column("text"), huge_chars, overlap_chars)
            yield pa.RecordBatch.from_arrays([block.column("id"), pa.array(sizes), pa.array(tokens), pa.array(tokens > limit), pa.array(chunks)], names=[id_col, "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(task, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean, n_chunks long")

"""BPE encoding and decoding with content-defined chunk reuse (operator 3).

A rolling hash over the last bytes cuts every text into chunks; where the bytes
agree the cuts agree, so passages that documents share give equal chunks, and a
chunk that a task has met before is not encoded again.  A cut may fall anywhere,
even inside a character.  Each join is repaired: the bytes from the last white
space before it to the first one behind it are encoded anew, over as many chunks
as have no white space.  There both sides agree exactly, since the tokenizer's
pre-tokens never contain white space and its normalizer treats what lies on the
two sides on its own; a tokenizer without that property is refused.  New chunks
are encoded word by word, again each word once.

Both memories are bounded by ``MOST_CHUNK_BYTES`` and ``MOST_WORDS`` and emptied
when full, so they change the time but never the ids.  Nothing is shuffled.

Nulls and odd rows: a null or empty text has no tokens; rows that repeat are
encoded each; a null id stays null.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import mix, small_batches, trim

CHUNK_BYTES, WINDOW_DOUBLINGS = 512, 5
MOST_CHUNK_BYTES, MOST_WORDS = 8_000_000, 120_000
#: One random number per byte value.
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32)
_SPACE = frozenset(b" \t\n\r\x0b\x0c")


def cuts(data: bytes, mean: int = CHUNK_BYTES) -> list[int]:
    """Ends of the chunks: where the hash of the last 32 bytes has its top bits at zero."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for i in range(WINDOW_DOUBLINGS):
        # h covers 2^i bytes; the same sum 2^i places before, shifted by as many bits, doubles it.
        w = 1 << i
        wider = h.copy()
        wider[w:] += h[:-w] << np.uint32(w) if w < len(h) else 0
        h = wider
    ends = (np.flatnonzero(h < np.uint32(2**32 // mean)) + 1).tolist()
    if not ends or ends[-1] != len(data):
        ends.append(len(data))
    return ends


class Codec:
    """Encoder and decoder of one tokenizer, with bounded memories of words and chunks."""

    def __init__(self, tokenizer_json: str, chunk_bytes: int = CHUNK_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.chunk_bytes = chunk_bytes
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.stops: dict[bytes, bytes] = {}
        self.chunks: dict[bytes, tuple] = {}
        self.chunk_size = 0
        self.spelled = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.word_end = np.array([t.endswith("</w>") for t in self.spelled])
        self.reused = self.encoded = 0
        self._require_white_space_joins()

    def forget(self) -> None:
        for memory in (self.words, self.stems, self.stops, self.chunks):
            memory.clear()
        self.chunk_size = 0

    def _direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _require_white_space_joins(self) -> None:
        sides = ["ab", "it's", "é", "éx", "12", "!?", "<|", " z"]
        for a in sides:
            for b, s in zip(sides[::-1], " \n\t\r\x0b\x0c \n"):
                whole, left, right = self._direct([a + s + b, a, b])
                if whole != left + right:
                    raise ValueError("this tokenizer's tokens depend on white space; chunk joins could not be repaired exactly")
        if any(set(t.content.encode()) & _SPACE for t in self.tok.get_added_tokens_decoder().values()):
            raise ValueError("an added token contains white space")

    def _learn(self, words: Iterable[bytes]) -> None:
        """Ids of words not met before; a letter word and the stops behind it are encoded each for itself.

        Between a letter and ``.`` or ``,`` there is always a pre-token's end.
        """
        new = {w for w in words if w not in self.words}
        if not new:
            return
        if len(self.words) + len(new) > MOST_WORDS:
            self.words.clear()
            new = set(words)
        parts, stems, odd = {}, set(), []
        for w in new:
            stem = w.rstrip(b".,")
            # ASCII letters may be lowered first: the normalizer does it anyway.
            if not stem.isalpha():
                stem = stem.decode("utf-8", "replace")
                if not stem.isalpha():
                    odd.append(w)
                    continue
            else:
                stem = stem.lower().decode("ascii")
            parts[w] = stem, w[len(w.rstrip(b".,")) :]
            stems.add(stem)
        if len(self.stems) + len(stems) > MOST_WORDS:
            self.stems.clear()
        self._learn_stems([x for x in stems if x not in self.stems])
        for w, ids in zip(odd, self._direct([w.decode("utf-8", "replace") for w in odd])):
            self.words[w] = np.array(ids, "<u4").tobytes()
        for w, (stem, stops) in parts.items():
            if stops and stops not in self.stops:
                if len(self.stops) > 10_000:
                    self.stops.clear()
                self.stops[stops] = np.array(self._direct([stops.decode()])[0], "<u4").tobytes()
            self.words[w] = self.stems[stem] + (self.stops[stops] if stops else b"")

    def _learn_stems(self, stems: list[str], at_once: int = 2_000) -> None:
        """Letter words are one pre-token each, so many go through the tokenizer at once and part at the word ends."""
        for i in range(0, len(stems), at_once):
            some = stems[i : i + at_once]
            ids = np.array(self._direct([" ".join(some)])[0], "<u4")
            ends = np.flatnonzero(self.word_end[ids]) + 1
            if len(ends) == len(some):
                raw, start = ids.tobytes(), 0
                for stem, end in zip(some, ends.tolist()):
                    self.stems[stem] = raw[4 * start : 4 * end]
                    start = end
            else:
                for stem, own in zip(some, self._direct(some)):
                    self.stems[stem] = np.array(own, "<u4").tobytes()

    def _cut(self, chunk: bytes) -> tuple[bytes, list[bytes] | None, bytes]:
        """(bytes up to the first white space, words between, bytes after the last); words None without white space."""
        pieces = chunk.split()
        if len(pieces) == 1 and len(pieces[0]) == len(chunk):
            return chunk, None, b""
        head = b"" if chunk[0] in _SPACE else pieces.pop(0)
        tail = b"" if chunk[-1] in _SPACE else pieces.pop()
        return head, pieces, tail

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text."""
        if self.chunk_size > MOST_CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_size = 0
        fresh: dict[bytes, tuple] = {}
        plans, joins = [], []
        for text in texts:
            data, start = (text or "").encode("utf-8"), 0
            plan, window = [], []
            for end in cuts(data, self.chunk_bytes) if data else []:
                chunk = data[start:end]
                start = end
                known = self.chunks.get(chunk) or fresh.get(chunk)
                if known is None:
                    known = fresh[chunk] = self._cut(chunk)
                    self.encoded += 1
                else:
                    self.reused += 1
                window.append(known[0])
                if known[1] is not None:
                    plan += [b"".join(window), chunk]
                    joins.append(plan[-2])
                    window = [known[2]]
            plan.append(b"".join(window))
            joins.append(plan[-1])
            plans.append(plan)
        every = [w for _, words, _ in fresh.values() if words for w in words] + [w for w in joins if w]
        self._learn(every)
        of = self.words.__getitem__
        for chunk, (head, words, tail) in fresh.items():
            ids = None if words is None else b"".join(map(of, words))
            self.chunks[chunk] = head, ids, tail
            self.chunk_size += len(chunk) + len(ids or b"") + 250
        out = []
        for plan in plans:
            parts = [(of(x) if x else b"") if i % 2 == 0 else self.chunks[x][1] for i, x in enumerate(plan)]
            out.append(np.frombuffer(b"".join(parts), "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces, special ones included."""
        return " ".join(map(self.spelled.__getitem__, ids.tolist()))


_OUT = {"n_tokens": ("bigint", pa.int64()), "token_ids": ("array<int>", pa.list_(pa.int32())), "decoded": ("string", pa.large_string()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}


def encode(docs: DataFrame, tokenizer_path: str, outputs: tuple[str, ...] = ("n_tokens", "token_ids"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the wanted ``outputs`` of every row.

    ``decoded`` is the decoder's text; ``ids_sha256`` digests the ids as
    little-endian 32-bit numbers, ``decoded_sha256`` the decoded text in UTF-8.
    The tokenizer's file is read by the driver and sent with the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    wants_text = any(o.startswith("decoded") for o in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        codec = Codec(shared.value)
        for b in small_batches(batches, "_text"):
            made: dict[str, list] = {o: [] for o in outputs}
            for ids in codec.encode(b.column(1).to_pylist()):
                decoded = codec.decode(ids) if wants_text else ""
                for o, column in made.items():
                    if o == "n_tokens":
                        column.append(len(ids))
                    elif o == "token_ids":
                        column.append(ids.astype(np.int32))
                    elif o == "decoded":
                        column.append(decoded)
                    else:
                        column.append(hashlib.sha256(ids.tobytes() if o == "ids_sha256" else decoded.encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, _OUT[o][1]) if o != "decoded" else pa.array(c, pa.string()) for o, c in made.items())], [id_col, *outputs])
        codec.forget()
        trim()

    schema = ", ".join([f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}", *(f"{o} {_OUT[o][0]}" for o in outputs)])
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)

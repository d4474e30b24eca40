"""BPE encoding by reuse of content-defined chunks, and decoding.

A rolling hash over 16 bytes cuts each text into chunks of about `2 ** bits` bytes, so that texts with a common passage get the same
chunks there. A worker encodes each distinct chunk once, by itself (a bounded store across its batches; no shuffle of texts is spent
on sharing between workers). Where two chunks meet, the ids at the cut may be wrong, so the join is repaired: the last words of the one and the first of
the other are encoded again as one string, which has to give the very ids that the chunks have for the outermost words on either side.
If it does, the chunks' ids agree with those of the text from there on and the string's ids replace those between; if not, the two
chunks are encoded again as one, and so on until all joins agree. Agreement at a word is proof enough only if ids depend on nothing beyond white space
(see tokens.words_split); for a vocabulary file without that property texts are encoded whole.

Cases: null is the empty text, without ids; texts of any length; repeated rows are encoded each (from the store); other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import slices
from .tokens import Encoder, encoder

#: Chunks that a worker keeps.
MOST_CHUNKS = 20_000
_TABLE = np.random.default_rng(20).integers(1 << 32, size=256, dtype=np.uint32)


def cuts(data: bytes, bits: int = 10, least: int = 64) -> list[int]:
    """Ends of the chunks of data: after bytes where the hash of the last 16 is 0 in its low bits, at a character's end."""
    n = len(data)
    if n <= least:
        return [n] if n else []
    b = np.frombuffer(data, np.uint8)
    h, step, base = _TABLE[b], 1, np.uint32(0x9E3779B1)
    while step < 16 and len(h) > step:
        h = h[:-step] * base + h[step:]
        step, base = 2 * step, np.uint32(int(base) ** 2 & 0xFFFFFFFF)
    ends = np.flatnonzero((h >> np.uint32(32 - bits)) == 0) + step
    ends = ends[(ends < n) & ((b[np.minimum(ends, n - 1)] & 0xC0) != 0x80)]
    out, last = [], 0
    for e in ends.tolist():
        if e - last >= least:
            out.append(e)
            last = e
    return [*out, n]


#: Words on either side of a cut that are encoded again; the outermost has to agree.
MARGIN = 2


class Chunk:
    """ids of a run of bytes: of its first and last MARGIN words apart, and of the words between."""

    __slots__ = ("data", "head", "body", "tail", "head_ids", "tail_ids")

    def __init__(self, data: bytes):
        self.data = data
        words = data.split()
        # a run of few words has nothing between its ends that could stay as it is
        self.head, self.tail = (words[:MARGIN], words[-MARGIN:]) if len(words) >= 2 * MARGIN else (words, None)
        self.body, self.head_ids, self.tail_ids = b"", [], []

    def strings(self) -> list[bytes]:
        if self.tail is None:
            return [*self.head]
        words = self.data.split()
        return [*self.head, b" ".join(words[MARGIN:-MARGIN]), *self.tail]

    def take(self, ids: list[bytes]) -> None:
        if self.tail is None:
            self.head_ids = ids
        else:
            self.head_ids, self.body, self.tail_ids = ids[:MARGIN], ids[MARGIN], ids[MARGIN + 1 :]


class ChunkEncoder:
    def __init__(self, tokens: Encoder):
        self.tokens, self.kept = tokens, {}

    def chunks(self, needed: set[bytes]) -> dict[bytes, Chunk]:
        """Chunks of these bytes, from the store or encoded together."""
        new = [Chunk(c) for c in needed - self.kept.keys()]
        strings = [c.strings() for c in new]
        flat = self.tokens.encode([x.decode("utf-8", "surrogatepass") for own in strings for x in own])
        at = 0
        for c, own in zip(new, strings):
            c.take(flat[at : at + len(own)])
            at += len(own)
        known = {c.data: c for c in new}
        room = MOST_CHUNKS - len(known)
        known |= {c: self.kept[c] for c in needed - known.keys()}
        # a full store keeps the chunks of this batch only
        self.kept = self.kept | known if len(self.kept) <= room else known if room >= 0 else {}
        return known

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if not self.tokens.by_word:
            return self.tokens.encode(texts)
        parts: list[list[bytes]] = []
        for t in texts:
            data, last = (t or "").encode("utf-8", "surrogatepass"), 0
            own: list[bytes] = []
            for e in cuts(data):
                # a run of few words is one with the next: every join has MARGIN words of its own on both sides
                if own and len(own[-1].split(None, 2 * MARGIN)) < 2 * MARGIN:
                    own[-1] += data[last:e]
                else:
                    own.append(data[last:e])
                last = e
            parts.append(own)
        done: list[bytes | None] = [None] * len(parts)
        waiting = list(range(len(parts)))
        while waiting:
            known = self.chunks({c for i in waiting for c in parts[i]})
            windows, joins = [], []
            for i in waiting:
                for a, b in zip(parts[i], parts[i][1:]):
                    a, b = known[a], known[b]
                    glue = b"" if a.data[-1:].strip() and b.data[:1].strip() else b" "
                    windows.append((b" ".join(a.tail or a.head) + glue + b" ".join(b.head[:MARGIN])).decode("utf-8", "surrogatepass"))
            joins = iter(self.tokens.encode(windows))
            still = []
            for i in waiting:
                own = [known[c] for c in parts[i]]
                out, merged = [b"".join(own[0].head_ids), own[0].body] if own else [], None
                for k, (a, b) in enumerate(zip(own, own[1:])):
                    ids = next(joins)
                    # a run of few words, the text's last, has no outer word to agree with: it is within the window
                    left, right = a.tail_ids[0] if a.tail else b"", b.head_ids[MARGIN - 1] if b.tail else b""
                    whole = a.tail is not None and (b.tail is not None or len(b.head) <= MARGIN)
                    if merged is None and not (whole and len(ids) >= len(left) + len(right) and ids.startswith(left) and ids.endswith(right)):
                        merged = k
                    out += [ids, b.body]
                if merged is None:
                    if own and own[-1].tail:
                        out += own[-1].tail_ids
                    done[i] = b"".join(out)
                else:
                    parts[i][merged : merged + 2] = [parts[i][merged] + parts[i][merged + 1]]
                    still.append(i)
            waiting = still
        return done


_state: dict[str, tuple[ChunkEncoder, list[bytes]]] = {}


def _of(path: str) -> tuple[ChunkEncoder, list[bytes]]:
    if path not in _state:
        tokens = encoder(path)
        pieces = [(tokens.tokenizer.id_to_token(i) or "").encode() for i in range(tokens.tokenizer.get_vocab_size(with_added_tokens=True))]
        _state[path] = ChunkEncoder(tokens), pieces
    return _state[path]


def decode(ids: np.ndarray, path: str) -> bytes:
    """As the library's decode(ids, skip_special_tokens=False), in UTF-8; files with a decoder step are decoded by the library."""
    coder, pieces = _of(path)
    if coder.tokens.tokenizer.decoder is not None:
        return coder.tokens.tokenizer.decode(ids.tolist(), skip_special_tokens=False).encode()
    return b" ".join(map(pieces.__getitem__, ids.tolist()))


def encode_decode(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, _ = _of(path)
        for batch in slices(batches, 1024):
            ids = coder.encode(batch.column(1).to_pylist())
            shas, back, texts = [], [], []
            for x in ids:
                shas.append(hashlib.sha256(x).hexdigest())
                plain = decode(np.frombuffer(x, "<u4"), path)
                back.append(hashlib.sha256(plain).hexdigest())
                if with_ids:
                    texts.append(plain.decode())
            columns = [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(shas, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary()), pa.array(texts, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids)

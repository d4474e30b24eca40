"""Exact token ids by the tokenizers library, each distinct word encoded once per worker.

The public word BPE drops white space and never lets a token cross it: its normalizer works on single characters
(NFC never composes with ASCII white space) and no pre-token holds white space. So the ids of a text are the ids of its words,
split at ASCII white space, one after the other; special tokens hold no white space either. `words_split` states that assumption
for a vocabulary file, and texts are encoded whole when it does not hold.
"""

from __future__ import annotations

import json
import os
from array import array
from itertools import islice

import numpy as np

#: Words longer than this are encoded, not kept.
LONG = 200
#: Characters of several texts that are split into words at once.
AT_ONCE = 16 << 20

def words_split(path: str) -> bool:
    """True if the tokenizer splits by a regex that leaves all white space out, after character-wise normalizers."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    steps = (d.get("normalizer") or {}).get("normalizers", [])
    pre = (d.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = all(x["type"] in ("NFC", "Lowercase") or x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " " for x in steps)
    split = bool(pre) and pre[0]["type"] == "Split" and pre[0]["behavior"] == "Removed" and pre[0]["invert"]
    whole = not any(c.isspace() for t in d.get("added_tokens", []) for c in t["content"])
    return plain and split and whole and not d.get("post_processor")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """encode(texts): the ids of each text as bytes, little-endian unsigned 32-bit. At most `most` words are kept.

    A new word of Latin letters below U+0250 (there NFC changes nothing, lower case works on single characters and the
    letter classes are old) is cut by the file's own pattern, and the library's model encodes each part once; the library
    encodes every other word whole.
    """

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_word, self.most, self.kept, self.parts = words_split(path), most, {}, {}
        self.special = [t["content"] for t in json.load(open(path, encoding="utf-8")).get("added_tokens", [])]
        if self.by_word:
            with open(path, encoding="utf-8") as f:
                pre = json.load(f)["pre_tokenizer"]["pretokenizers"]
            self.cut = regex.compile(pre[0]["pattern"]["Regex"]).findall
            self.letters = byte_letters()
            # no added token is letters alone, or letters and one mark; others are looked for
            self.plain = not any(x.rstrip(".,").isalpha() for x in self.special) and self.cut("straße.") == ["straße", "."]
            self.marked = regex.compile("|".join(map(regex.escape, ["<|", *self.special]))).search
            self.latin = regex.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+").fullmatch if [x["type"] for x in pre[1:]] == ["ByteLevel"] else lambda _: None

    def whole(self, texts: list[str]) -> list[bytes]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def part(self, piece: str) -> bytes:
        found = self.parts.get(piece)
        if found is None:
            coded = piece.encode().decode("latin-1").translate(self.letters) if not piece.isascii() else piece
            found = array("I", [t.id for t in self.model.tokenize(coded)]).tobytes()
            if len(piece) <= LONG and len(self.parts) < 2 * self.most:
                self.parts[piece] = found
        return found

    def words(self, words: list[bytes]) -> dict[bytes, bytes]:
        out, odd, known, part = {}, [], self.parts.get, self.part
        for w in words:
            s = w.decode("utf-8", "surrogatepass")
            low = s.lower()
            found = known(low)
            if found is None:
                # letters alone are one part of the pattern; a mark at the end is another
                head = low[:-1] if low[-1] in ".," else low
                if len(w) > LONG or not head:
                    pass
                elif self.plain and (head.isascii() or self.latin(s)) and head.isalpha():
                    found = part(head) if head is low else (known(head) or part(head)) + part(low[-1])
                elif self.latin(s) and not self.marked(s):
                    found = b"".join(map(part, self.cut(low)))
                if found is None:
                    odd.append(w)
                    continue
            out[w] = found
        return out | dict(zip(odd, self.whole([w.decode("utf-8", "surrogatepass") for w in odd]))) if odd else out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Full stores stay as they are until most words of a call are new. Long calls go in halves, which bounds the lists of words."""
        texts = [t or "" for t in texts]
        if len(texts) > 1 and sum(map(len, texts)) > AT_ONCE:
            half = len(texts) // 2
            return self.encode(texts[:half]) + self.encode(texts[half:])
        if not self.by_word:
            return self.whole(texts)
        split = [t.encode("utf-8", "surrogatepass").split() for t in texts]
        seen = set().union(*split) if split else set()
        new = seen - self.kept.keys()
        if len(self.kept) >= self.most and len(new) > 0.8 * len(seen):
            self.kept, self.parts, new = {}, {}, seen
        ids = self.words(list(new))
        room = max(0, self.most - len(self.kept))
        extra = [w for i, w in enumerate(ids) if i >= room or len(w) > LONG]
        self.kept.update(ids)
        of = self.kept.__getitem__
        out = [b"".join(map(of, p)) for p in split]
        for w in extra:
            del self.kept[w]
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

"""Encoding whole texts with a tokenizer file of the tokenizers library.

A text is split where the file's own pre-tokenizer always ends a piece (at blanks); the library
encodes each different piece, and a text's ids are its pieces' ids joined. A worker keeps the
ids of pieces it has seen, so frequent words are encoded once. Texts that may hold one of the
file's added tokens (such as an end mark) go whole to the library, as do all texts of files whose
pre-tokenizer is not one of the two known kinds. The kept pieces are bounded in
number; which of them are kept changes speed alone.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np

#: Pieces kept by one Python worker for one file. Beyond half of them a piece is kept from its second sight on.
KEPT_PIECES = 250_000
#: Characters of texts that are looked up at a time.
CHUNK_CHARS = 1_000_000
_SEEN_BITS = 22
_ENCODERS: dict[str, Encoder] = {}

_BLANK_BESIDE = re.compile(r"[^\S ] | [^\S ]")
_BEFORE_LONE_BLANK = re.compile(r"(?<=\S)(?= \S)")
_ODD = re.compile(r"[\s\x01]")


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; its kept pieces outlive a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # only the parts that matter: parsing the file would leave its whole vocabulary in memory
        part = lambda x: json.loads(x.__getstate__()) if x is not None else None
        self.kind = self._kind({"pre_tokenizer": part(self.tokenizer.pre_tokenizer), "normalizer": part(self.tokenizer.normalizer)})
        #: matches wherever the library could find an added token, whatever its normalizer does to case
        added = [x.content.strip() for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None
        #: of each added token its longest run of anything but letters, which is quick to look for
        self.marks = {max(re.findall(r"[^A-Za-z]+", x), key=len, default="") for x in added}
        self.n_ids = self.tokenizer.get_vocab_size()
        #: between pieces that are encoded together; always ids of its own
        self.separator = {"leading blank": "\n", "no blank": " \x01 "}.get(self.kind, "")
        self.separator_ids = self._ids(self.separator)
        self.kept: dict[str, bytes] = {}
        self.seen = bytearray(1 << _SEEN_BITS)
        self.n_seen = 0

    @staticmethod
    def _kind(spec: dict) -> str:
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
            return "leading blank"  # a lone blank before a word belongs to it
        parts = pre.get("pretokenizers") or [{}]
        pattern = (parts[0].get("pattern") or {}).get("Regex", "")
        if parts[0].get("type") == "Split" and parts[0].get("invert") and parts[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in pattern:
            return "no blank"  # blanks are dropped and no piece holds one
        return "other"

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text; where blanks lead pieces, all but the first stand without theirs."""
        if self.kind == "no blank":
            return text.replace("\n", " ").split(" ")
        if self.kind == "other":
            return [text]
        if "  " in text or _BLANK_BESIDE.search(text):
            first, *rest = _BEFORE_LONE_BLANK.split(text)
            return [first, *(x[1:] for x in rest)]
        return text.split(" ")

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pieces as they stand after a blank."""
        lead = " " if self.kind == "leading blank" else ""
        plain, out = [], {}
        for x in pieces:
            if len(self.separator_ids) != 1 or _ODD.search(x):
                out[x] = array("I", self._ids(lead + x)).tobytes()
            else:
                plain.append(x)
        joined = [plain[i : i + 100] for i in range(0, len(plain), 100)]
        texts = [self.separator.join([lead + x for x in part]) for part in joined]
        for part, e in zip(joined, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            at = np.flatnonzero(ids == self.separator_ids[0])
            raw, start = ids.tobytes(), 0
            for x, end in zip(part, [*at.tolist(), len(ids)], strict=True):
                out[x], start = raw[4 * start : 4 * end], end + 1
        return out

    def _keep(self, new: dict[str, bytes]) -> None:
        for x, ids in new.items():
            if len(self.kept) >= KEPT_PIECES // 2:
                if len(self.kept) >= KEPT_PIECES:
                    return
                k = hash(x) & ((1 << _SEEN_BITS) - 1)
                if not self.seen[k]:
                    self.seen[k] = 1
                    self.n_seen += 1
                    continue
            self.kept[x] = ids
        if self.n_seen > 1 << (_SEEN_BITS - 1):
            self.seen, self.n_seen = bytearray(1 << _SEEN_BITS), 0

    def _encode_chunk(self, texts: list[str]) -> list[bytes]:
        get, missing, found, firsts = self.kept.get, set(), [], []
        for t in texts:
            if any(x in t for x in self.marks) and self.added.search(t):
                found.append(([array("I", self._ids(t)).tobytes()], [], []))
                firsts.append(b"")
                continue
            pieces = self._pieces(t)
            if self.kind == "leading blank":
                firsts.append(array("I", self._ids(pieces[0])).tobytes())
                pieces[0] = ""
            else:
                firsts.append(b"")
            ids = list(map(get, pieces))
            if self.kind == "leading blank":
                ids[0] = b""
            gaps = [i for i, x in enumerate(ids) if x is None] if None in ids else []
            missing.update([pieces[i] for i in gaps])
            found.append((ids, gaps, [pieces[i] for i in gaps]))
        new = self._encode(list(missing))
        out = []
        for k, (ids, gaps, pieces) in enumerate(found):
            for i, x in zip(gaps, pieces, strict=True):
                ids[i] = new[x]
            out.append(firsts[k] + b"".join(ids))
        self._keep(new)
        return out

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        part, size = [], 0
        for t in texts:
            if part and size + len(t) > CHUNK_CHARS:
                yield from self._encode_chunk(part)
                part, size = [], 0
            part.append(t)
            size += len(t)
        if part:
            yield from self._encode_chunk(part)

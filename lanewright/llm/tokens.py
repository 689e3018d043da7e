"""Fast exact token ids for byte-level BPE files of the tokenizers library.

The pre-tokenizer never lets a piece span the place before a space that stands before a
character that is not white space.  So a text falls into chunks there (mostly words), chunks are
encoded once and remembered in a bounded table of two generations, and a text's ids are its
chunks' ids in a row.  New chunks are encoded by tiktoken over the same vocabulary, read from the
tokenizers file, if its merges stand in the order of the ids (then both libraries merge alike);
else, and for texts with special strings of the vocabulary, by the tokenizers library itself.
Memory: at most two times ``ENTRIES`` chunks of at most ``LONGEST`` characters.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

ENTRIES, LONGEST, AT_ONCE = 250_000, 48, 20_000
#: The pre-tokenizer pattern of byte-level BPE files with use_regex: a fixed value.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[str, ChunkEncoder] = {}
_ODD = re.compile(r" (?:\s|\Z)")
_BREAK = re.compile(r" (?=\S)")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _byte_of() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as bytes, if its merges stand in the order of the ids they make."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("type") != "BPE" or model.get("ignore_merges"):
        return None
    merged = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        return None
    special, byte = {t["content"] for t in spec["added_tokens"]}, _byte_of()
    return {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in special}


class ChunkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.fast = None
        if (ranks := _ranks(path)) is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.lead = np.zeros(max(ranks.values()) + 1, bool)
            self.lead[[v for k, v in ranks.items() if k[:1] == b" "]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, texts: list[str]) -> list[bytes]:
        """Of texts without special strings."""
        if self.fast is None:
            return self._library(texts)
        return [np.array(self.fast.encode_ordinary(t), "<u4").tobytes() for t in texts]

    def _chunks(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of each part behind a space; a chunk starts where an id starts with a space."""
        inner = [x for x in parts if " " in x]
        out = dict(zip(inner, self._plain([" " + x for x in inner]), strict=True))
        plain = [x for x in parts if " " not in x]
        if self.fast is None:
            return out | dict(zip(plain, self._plain([" " + x for x in plain]), strict=True))
        for at in range(0, len(plain), AT_ONCE):
            some = plain[at : at + AT_ONCE]
            ids = np.array(self.fast.encode_ordinary(" " + " ".join(some)), "<u4")
            raw, cuts = ids.tobytes(), [*(np.flatnonzero(self.lead[ids]) * 4).tolist(), len(ids) * 4]
            out.update((x, raw[a:b]) for x, a, b in zip(some, cuts[:-1], cuts[1:], strict=True))
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null as empty."""
        out: list[bytes | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        for i, t in enumerate(texts):
            t = t or ""
            if any(s in t for s in self.special):
                out[i] = self._library([t])[0]
            else:
                split.append((i, _BREAK.split(t) if _ODD.search(t) else t.split(" ")))
        seen: set[str] = set()
        for _, parts in split:
            seen.update(parts[1:])
        if len(self.ids) > ENTRIES:
            self.old, self.ids = self.ids, {}
        seen -= self.ids.keys()
        again = {x: self.old[x] for x in seen & self.old.keys()}
        new = self._chunks(list(seen - again.keys()))
        known = self.ids
        known.update(again)
        known.update(new)
        for i, parts in split:
            out[i] = self._plain([parts[0]])[0] + b"".join([known[x] for x in parts[1:]])
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        return out


def encoder(path: str) -> ChunkEncoder:
    """One for each Python worker and vocabulary."""
    if path not in _LOADED:
        _LOADED[path] = ChunkEncoder(path)
    return _LOADED[path]

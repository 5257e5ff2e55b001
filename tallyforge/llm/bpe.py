"""Byte-level BPE ids of whole texts.

The ids are those of the ``tokenizers`` library for the given vocabulary file. Where that
file's ids rank its merges, as byte-level vocabularies do, the same table drives
``tiktoken``, which gives equal ids in a quarter of the time; any other file goes to
``tokenizers`` itself. ``tests/llm`` holds the two against each other. Added tokens of the
file (such as an end of text) that stand in a text have their own ids, as they have there.
"""

from __future__ import annotations

import json
import os

import numpy as np

_held: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: printable
    ones for themselves, the rest in order from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranked_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Bytes -> id and added token -> id, if the ids rank the merges of the file; else None."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    model, split = held["model"], held.get("pre_tokenizer") or {}
    if held.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space"):
        return None
    vocabulary, byte = model["vocab"], byte_characters()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [vocabulary["".join(m)] for m in merges]
    if made != sorted(made):
        return None
    added = held.get("added_tokens", ())
    if any(t.get(flag) for t in added for flag in ("lstrip", "rstrip", "single_word")):
        return None
    own = {t["content"]: t["id"] for t in added}
    return {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if t not in own}, own


def added_tokens(path: str) -> list[dict]:
    with open(path, encoding="utf-8") as f:
        return json.load(f).get("added_tokens", [])


class Encoder:
    """ids(text): the ids as unsigned 32-bit integers. ``cuttable``: no added token holds a
    space or takes in the white space around it."""

    def __init__(self, path: str):
        found = ranked_vocabulary(path)
        self.cuttable = not any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in added_tokens(path))
        if found is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            held = Tokenizer.from_file(path)
            self.ids = lambda text: np.array(held.encode(text, add_special_tokens=False).ids, np.uint32)
        else:
            import public_tokenizers
            import tiktoken

            ranks, own = found
            held = tiktoken.Encoding(
                os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own
            )
            allowed = set(own)
            self.ids = lambda text: held.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())

    def count(self, text: str) -> int:
        return len(self.ids(text))


def encoder(path: str | None = None) -> Encoder:
    """The process's encoder for the tokenizer file at ``path``."""
    path = path or default_path()
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]

"""Token ids by public vocabularies.

For sentence pieces each distinct chunk of text is segmented once per worker.  A chunk is a stretch
of text whose ids do not depend on what stands around it.  The table of chunks holds packed ids, lives
as long as the Python worker and is emptied at a fixed size, so its memory is bounded for any input.
"""

from __future__ import annotations

import base64
import json
import os
import re
import unicodedata
from collections.abc import Callable

import numpy as np

#: Chunks in a worker's table before it is emptied.
TABLE = 300_000
#: Longer chunks are segmented without being kept.
LONG = 64

_TABLES: dict[tuple[str, str], dict[str, bytes]] = {}
_LOADED: dict[tuple[str, str], object] = {}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def joined(words: list[str], table: dict[str, bytes], segment: Callable[[list[str]], list[bytes]]) -> bytes:
    """The packed ids of the words in their order; each word not yet in the table is segmented once."""
    new = [w for w in dict.fromkeys(words) if w not in table]
    if new:
        if len(table) + len(new) > TABLE:
            table.clear()
            new = list(dict.fromkeys(words))
        own = dict(zip(new, segment(new), strict=True))
        if max(map(len, new)) > LONG or len(new) > TABLE:
            at = {w: table.get(w) or own.get(w, b"") for w in words}
            table.update((w, own[w]) for w in new[:TABLE] if len(w) <= LONG)
            return b"".join(map(at.__getitem__, words))
        table.update(own)
    return b"".join(map(table.__getitem__, words))


def _json_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if ("json", path) not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED["json", path] = Tokenizer.from_file(path)
    return _LOADED["json", path]


def whole(path: str, texts: list[str]) -> list[bytes]:
    """By the tokenizers library, text by text."""
    return [packed(e.ids) for e in _json_tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _word_end_bpe(path: str):
    """Merge ranks for a vocabulary whose words end in a mark: the zero byte stands for the mark."""
    if ("ends", path) not in _LOADED:
        import regex
        import tiktoken

        with open(path) as f:
            model = json.load(f)
        byte, special = _byte_of(), {t["content"] for t in model["added_tokens"]}
        ranks = {}
        for piece, i in model["model"]["vocab"].items():
            if piece not in special:
                ended = piece.endswith("</w>") and piece != "</w>"
                ranks[bytes(byte[c] for c in (piece[:-4] if ended else piece)) + b"\0" * ended] = i
        pattern = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        _LOADED["ends", path] = (tiktoken.Encoding("ends", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}), regex.compile(pattern), special)
    return _LOADED["ends", path]


#: The vocabulary's own pattern, on ASCII alone.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x20\x09-\x0Da-z0-9]+")


def _unknown() -> np.ndarray:
    """Of every code point whether the Unicode tables here do not know it; those of the tokenizers library are newer."""
    if ("unknown", "") not in _LOADED:
        _LOADED["unknown", ""] = np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])
    return _LOADED["unknown", ""]


def word_bpe(path: str, text: str) -> bytes:
    """Lower-cased BPE with word ends, by the same merges run over marked words in one call; a text with a special token, a zero or a
    code point that is unknown here goes to the library."""
    bpe, pattern, special = _word_end_bpe(path)
    if "\0" in text or any(s in text for s in special):
        return whole(path, [text])[0]
    if text.isascii():
        words = _ASCII_WORDS.findall(text.lower())
    elif _unknown()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].any():
        return whole(path, [text])[0]
    else:
        words = pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
    return packed(bpe.encode_ordinary("\0".join([*words, ""])))


def _byte_bpe(path: str):
    """The merge ranks beside a byte-level vocabulary, name.tiktoken for name.json."""
    if ("ranks", path) not in _LOADED:
        import public_tokenizers
        import tiktoken

        with open(re.sub(r"\.json$", ".tiktoken", path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED["ranks", path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED["ranks", path]


def byte_bpe(path: str, text: str) -> bytes:
    """Byte-level BPE, by the same merges; a text that may name a special token goes to the library."""
    return whole(path, [text])[0] if "<|" in text else packed(_byte_bpe(path).encode_ordinary(text))


def _pieces(path: str):
    if ("pieces", path) not in _LOADED:
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        crossing = [i for i in range(p.get_piece_size()) if re.search("[^▁]▁", p.id_to_piece(i))]
        if crossing or p.encode("a  b") != p.encode("a") + p.encode(" b"):
            raise ValueError("pieces of this model cross white space: segment whole texts with it")
        _LOADED["pieces", path] = p
    return _LOADED["pieces", path]


_MARKED = re.compile(r" +[^ ]*")


def piece_ids(path: str, text: str) -> bytes:
    """Sentence pieces without begin and end.  No piece crosses from a letter to a blank's mark, so a
    run of marks with the letters behind it is a chunk; the library puts the first mark itself."""
    p = _pieces(path)
    if not text:
        return b""
    text = text.replace("▁", " ")
    words = text.split(" ")
    if not all(words):
        words = [c[1:] for c in _MARKED.findall(" " + text)]
        if not all(words):
            return packed(p.encode(text))
    return joined(words, _TABLES.setdefault(("piece", path), {}), lambda new: [packed(x) for x in p.encode(new, num_threads=1)])


def piece_text(path: str, ids: list[int]) -> str:
    return _pieces(path).decode(ids)

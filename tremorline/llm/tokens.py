"""Token ids of whole texts by the public tokenizer libraries, chunk by chunk.

A text is cut where every pattern used here ends a piece anyway: before a single space and
a word, between a word and the punctuation after it, around other white space. Equal chunks
have equal ids, so a worker keeps the ids of the chunks it has seen and asks the library
for new ones only. What it keeps is bounded in bytes: two generations of ``MEMORY_BYTES``
/ 2 each, of which the older one goes when the younger one is full, while chunks still met
move on to the next; chunks longer than ``LONG`` are never kept. Ids are bytes:
little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterator
from types import ModuleType

import pyarrow as pa

MEMORY_BYTES = 192 << 20  # what a worker keeps of chunks and their ids
LONG = 256  # characters of a chunk above which it is not kept
_ENTRY_BYTES = 260  # a chunk's share of dictionary, list and objects besides its characters and ids

# Latin letters in blocks that hold nothing but letters, without the one (U+0130) whose
# lower case is a letter and a mark.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
_AFTER = r"(?=[.,;:!?\s]|\Z)"
# For patterns that join a space to the word after it.
SPACED = re.compile(rf" ?[{_LETTERS}]++{_AFTER}| ?\S+|\s+(?!\S)|\s+")
# Punctuation that ends a piece, and is one, where it follows a letter and ends a chunk.
_MARKS = frozenset(".,;:!?")
# Characters that Python takes for white space and the libraries don't.
_ODD = "\x1c\x1d\x1e\x1f"
# Beyond these letters lower case may depend on the neighbours or on the order of steps.
_BEYOND_LATIN = re.compile("[^\x00-\u012f\u0131-\u024f]")
# Every pattern used here takes such a chunk whole.
WORD = re.compile(f" ?[{_LETTERS}]+")

# The alphabet of byte-level vocabularies: printable bytes stand for themselves, the
# others for the characters from 256 on, in order.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def byte_characters(text: str) -> str:
    """UTF-8 bytes of ``text``, each as its character in byte-level vocabularies."""
    if text.isascii() and " " not in text:
        return text
    return text.encode().decode("latin-1").translate(_BYTES)


def beyond_latin(text: str) -> bool:
    """Whether lower case may depend on more than the single character."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(_BEYOND_LATIN.search(text))
    return False


class _Generation(dict):
    """Ids by chunk, taken from the generation before or encoded where they are missing."""

    def __init__(self, before: dict[str, bytes], encode_one: Callable[[str], bytes]) -> None:
        self.before, self.encode_one, self.size = before, encode_one, 0

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.get(chunk)
        if ids is None:
            ids = self.encode_one(chunk)
        if len(chunk) <= LONG:
            self[chunk] = ids
            self.size += _ENTRY_BYTES + 2 * len(chunk) + len(ids)
        return ids


class ChunkEncoder:
    """Texts to ids through a bounded memory of chunks.

    ``encode_one`` gives the ids of a chunk, ``encode_whole`` those of a text. Texts with
    characters on which the libraries and Python disagree are encoded whole, and so are
    texts that hold one of ``whole_if``. ``lower`` says that case makes no difference to
    the ids, so that chunks may be remembered in lower case.
    """

    def __init__(
        self,
        cut: Callable[[str], list[str]],
        encode_one: Callable[[str], bytes],
        memory_bytes: int = MEMORY_BYTES,
        lower: bool = False,
        whole_if: tuple[str, ...] = (),
        encode_whole: Callable[[str], bytes] | None = None,
    ) -> None:
        self.cut, self.encode_one, self.lower = cut, encode_one, lower
        self.half = memory_bytes // 2
        self.whole_if = (*_ODD, *whole_if)
        self.encode_whole = encode_whole or encode_one
        self.known = _Generation({}, encode_one)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text, in order."""
        for text in texts:
            if self.known.size > self.half:
                # the generation before stays to be asked, older ones go
                self.known.before = {}
                self.known = _Generation(self.known, self.encode_one)
            plain = text.lower() if self.lower and not beyond_latin(text) else text
            if any(s in plain for s in self.whole_if):
                yield self.encode_whole(text)
            else:
                yield b"".join(map(self.known.__getitem__, self.cut(plain)))


def worker_memory() -> dict[str, object]:
    """What a Python worker keeps from task to task.

    The functions of this package travel by value with their module's globals; a module
    that only the worker knows does not.
    """
    return sys.modules.setdefault("tremorline_worker_memory", ModuleType("tremorline_worker_memory")).__dict__


def library_encoder(path: str, memory_bytes: int = MEMORY_BYTES, control: bool = True) -> ChunkEncoder:
    """Encoder for a ``tokenizers`` file, one per worker process.

    Strings of the file's added tokens are those tokens, as in the library's plain call;
    without ``control`` they are encoded as the characters they are made of.
    """
    encoders, key = worker_memory(), f"tokenizers:{path}:{memory_bytes}:{control}"
    if key not in encoders:
        from tokenizers import Tokenizer

        plain, tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        drops_spaces = not tokenizer.encode(" ", add_special_tokens=False).ids

        lowers = "Lowercase" in str(tokenizer.normalizer)
        tokenize = tokenizer.model.tokenize
        added = tuple(t.content for t in plain.get_added_tokens_decoder().values()) if control else ()

        def encode_one(chunk: str) -> bytes:
            if drops_spaces and chunk[-1] in _MARKS and WORD.fullmatch(chunk, 0, len(chunk) - 1):
                known = encoder.known
                return known[chunk[:-1]] + known[chunk[-1]]
            # What the steps before the model leave of a word of Latin letters is known:
            # its bytes as characters. Anything else goes through all of them.
            if WORD.fullmatch(chunk) and (not lowers or chunk.islower()):
                return array("I", [i.id for i in tokenize(byte_characters(chunk))]).tobytes()
            return array("I", tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

        def encode_whole(text: str) -> bytes:
            used = plain if control else tokenizer
            return array("I", used.encode(text, add_special_tokens=False).ids).tobytes()

        # Where white space is dropped, chunks are what stands between it.
        cut = str.split if drops_spaces else SPACED.findall
        encoder = encoders[key] = ChunkEncoder(cut, encode_one, memory_bytes, lowers, added, encode_whole)
    return encoders[key]


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; a missing text is an empty one."""
    return ["" if t is None else t for t in column.to_pylist()]

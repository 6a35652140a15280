"""Token ids of whole texts, chunk by chunk.

A blank between two characters that are not white space always begins a new match
of the pre-tokenizing pattern, so a text can be cut there and each chunk encoded
on its own.  Chunks repeat, and their ids are kept in a bounded cache as the bytes
that go into the result.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np

from riskframe.llm.common import process_cache

#: Chunks of an age; a worker process keeps two ages.
CACHED_CHUNKS = 200_000
#: Characters up to which a chunk is worth keeping.
CACHED_LENGTH = 64
#: Chunks encoded in one call of the tokenizer.
BATCH = 50_000
#: Chunks joined to one string for the tokenizer.
JOINED = 128
#: Characters of text worked on at a time (one text is never cut for it).
WINDOW = 2_000_000

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than the blank.
_SPACES = [c for c in map(chr, range(0x10000)) if c != " " and c.isspace()]


def loose(text: str) -> bool:
    """Whether a blank stands beside other white space."""
    return "  " in text or any(c in text and (" " + c in text or c + " " in text) for c in _SPACES)


def split(text: str) -> list[str]:
    """Chunks of a text; all but the first lack the blank before them."""
    return _CUT.split(text) if loose(text) else text.split(" ")


def windows(texts: list[str | None]) -> Iterator[list[str]]:
    """Texts in runs of about WINDOW characters; null counts as empty."""
    run, size = [], 0
    for t in texts:
        run.append(t or "")
        size += len(run[-1])
        if size >= WINDOW:
            yield run
            run, size = [], 0
    if run:
        yield run


class Kept:
    """Ids of chunks that follow ``blank``, kept across texts and tasks: those seen
    lately, and those of the time before, of which the ones seen again move on."""

    def __init__(self, name: str, blank: str, encode: Callable[[list[str]], list[bytes]], size: int):
        self.size = size
        self.ages: list[dict[str, bytes]] = process_cache().setdefault(f"{name} {blank!r}", [{}, {}])
        self.blank, self.encode = blank, encode

    def of(self, chunks: set[str]) -> Callable[[str], bytes]:
        """A lookup that has all of ``chunks``."""
        if len(self.ages[0]) >= self.size:
            self.ages[:] = {}, self.ages[0]
        known, older = self.ages
        long: dict[str, bytes] = {}
        new = []
        for c in chunks:
            if c not in known:
                ids = older.get(c)
                if ids is None:
                    new.append(c)
                else:
                    known[c] = ids
        for i in range(0, len(new), BATCH):
            part = new[i:i + BATCH]
            for c, ids in zip(part, self.encode([self.blank + c for c in part])):
                (known if len(c) <= CACHED_LENGTH else long)[c] = ids
        return (long | {c: known[c] for c in chunks if c not in long}).__getitem__ if long else known.__getitem__


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.  ``encode`` maps a list
    of strings to a list of such bytes; it must give the same for equal strings."""

    def __init__(self, name: str, encode: Callable[[list[str]], list[bytes]], size: int = CACHED_CHUNKS):
        self.first, self.later = Kept(name, "", encode, size // 4), Kept(name, " ", encode, size)

    def texts(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; null counts as empty."""
        for run in windows(texts):
            cut = [split(t) for t in run]
            first = self.first.of({d[0] for d in cut})
            later = self.later.of({c for d in cut for c in d[1:]})
            for d in cut:
                yield first(d[0]) + b"".join(map(later, d[1:]))


def tokenizers_encoder(path: str) -> ChunkEncoder:
    """Ids by a ``tokenizers`` file; strings of special tokens are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    cache = process_cache()
    key = f"tokenizers {path}"
    if key not in cache:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        vocabulary = tokenizer.get_vocab()
        lengths = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=np.int64)
        lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        cache[key] = tokenizer, lengths
    tokenizer, lengths = cache[key]

    def singly(chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(chunks: list[str]) -> list[bytes]:
        return encode_joined(chunks, singly, lengths)

    return ChunkEncoder(key, encode, 3 * CACHED_CHUNKS // 2)


def joinable(chunk: str) -> bool:
    """Whether a chunk begins and ends as ``split`` cuts inside a text."""
    return len(chunk) > 1 and chunk[0] == " " and not chunk[1].isspace() and not chunk[-1].isspace()


def encode_joined(chunks: list[str], singly: Callable[[list[str]], list[bytes]], lengths: np.ndarray) -> list[bytes]:
    """Ids of each chunk as bytes.  Chunks that could follow each other in a text are
    encoded as one, and the ids are divided where the bytes of their tokens, one character
    each in a byte-level vocabulary (``lengths`` by id), meet the ends of the chunks.
    Where they don't, and for all other chunks, each chunk is encoded by itself."""
    out: list[bytes | None] = [None] * len(chunks)
    able = [i for i, c in enumerate(chunks) if joinable(c)]
    runs = [able[s:s + JOINED] for s in range(0, len(able), JOINED)]
    for run, joined in zip(runs, singly(["".join([chunks[i] for i in run]) for run in runs])):
        ends = np.cumsum([len(chunks[i].encode("utf-8", "surrogatepass")) for i in run])
        after = np.cumsum(lengths[np.frombuffer(joined, dtype=np.uint32)])
        last = np.searchsorted(after, ends)
        if not len(after) or after[-1] != ends[-1] or (after[last] != ends).any():
            continue
        cuts = [0, *(4 * (last + 1)).tolist()]
        for i, a, b in zip(run, cuts, cuts[1:]):
            out[i] = joined[a:b]
    rest = [i for i, ids in enumerate(out) if ids is None]
    for i, ids in zip(rest, singly([chunks[i] for i in rest])):
        out[i] = ids
    return out

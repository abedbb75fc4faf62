"""Token ids of whole texts by public tokenizers, a run of words at a time.

These tokenizers never join characters across the start of a run of spaces, so a text's ids are those of its words put
together, and a word's ids are looked up once in a task. Texts go through in pieces of bounded length.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words that a task remembers, some 100 MB of them; it forgets all when there are more.
MEMORY = 1 << 19
#: Bytes of a piece of a long text, about.
PIECE = 1 << 20


def vocabulary(name: str) -> str:
    """Where a worker finds a file of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of these characters are split here as the tokenizers split them; Unicode versions agree on them. Others go to the tokenizers whole.
_COMMON = re.compile(r"[\t\n\r\x20-\x7E\xA1-\xFF]*")


def stand_ins() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 ones for themselves, for the others those from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    odd = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(odd)) for b in range(256)]


class Splitter:
    """Ids of words: their parts by a pattern, each by the tokenizer's model alone and once; what isn't common by the whole tokenizer."""

    def __init__(self, tokenizer, pattern: str, lower: bool, plain: str | None = None):
        import regex

        self.tokenizer, self.parts, self.lower, self.plain = tokenizer, regex.compile(pattern).findall, lower, plain
        self.known: dict[str, bytes] = {}
        self.table = dict(enumerate(stand_ins()))

    def ids(self, word: str) -> bytes:
        """Four bytes a token."""
        if not _COMMON.fullmatch(word) or self.plain and self.plain in word:
            return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        out = []
        for part in self.parts(word.lower() if self.lower else word):
            found = self.known.get(part)
            if found is None:
                if len(self.known) >= MEMORY // 2:
                    self.known.clear()
                # bytes as Latin-1 characters, and those as their stand-ins
                found = self.known[part] = array("I", [t.id for t in self.tokenizer.model.tokenize(part.encode().decode("latin-1").translate(self.table))]).tobytes()
            out.append(found)
        return b"".join(out)


class Known(dict):
    """What is known of words, most of them at once; learn(words) tells it of new ones."""

    def __init__(self, learn, most: int = MEMORY):
        self.learn, self.most = learn, most

    def all(self, words: list[str]) -> list:
        found = list(map(self.get, words))
        if None in found:
            new = list({w for w, x in zip(words, found, strict=True) if x is None})
            if len(self) + len(new) > self.most:
                self.clear()
                new = list(set(words))
            self.update(zip(new, self.learn(new), strict=True))
            found = list(map(self.get, words))
        return found


class Words:
    """The ids of words, as bytes: four a token, little-endian, unsigned."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        split = Splitter(self.model, r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", lower=True, plain="<|")
        self.known = Known(lambda words: list(map(split.ids, words)))

    def ids(self, text: bytes) -> Iterator[np.ndarray]:
        """The ids of a text of which space, tab, newline and the like are no part; bytes that are no UTF-8 count as U+FFFD."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > PIECE and (cut := text.find(b" ", at + PIECE)) > 0:
                end = cut
            words = text[at:end].decode("utf-8", "replace").split(" ")
            yield np.frombuffer(b"".join(self.known.all(words)), "<u4")
            at = end


#: The character that stands for a space in pieces.
_SPACE = "▁"


#: Fixed value: how the byte-level tokenizer splits text before its merges.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A token is its id in so many low bits, and its length in bytes above them.
ID_BITS = 17


class Twice:
    """Runs of spaces and what follows up to the next, by two tokenizers: a byte-level one and one of pieces.

    Where a text may be cut for both is before a run of spaces.

    The byte-level vocabulary comes from its file; ids rise with the rank of merges, so tiktoken's merging gives its ids.
    """

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        vocab = Tokenizer.from_file(byte_path).get_vocab(with_added_tokens=False)
        of = {c: b for b, c in enumerate(stand_ins())}
        ranks = {bytes(map(of.__getitem__, t)): i for t, i in vocab.items() if set(t) <= of.keys()}
        # the special token is in the file's vocabulary too, but no merge leads to it
        special = {t for t in ranks if t.startswith(b"<|") and t.endswith(b"|>")}
        self.bytes = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks={t: i for t, i in ranks.items() if t not in special}, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        first, second = [b""] * (max(vocab.values()) + 1), []
        for t, i in ranks.items():
            first[i] = t
        for i in range(self.pieces.get_piece_size()):
            t = self.pieces.id_to_piece(i)
            second.append(bytes([int(t[3:5], 16)]) if self.pieces.is_byte(i) else t.replace(_SPACE, " ").encode())
        self.first, self.second = ((x, np.array([(len(t) << ID_BITS) | i for i, t in enumerate(x)], "<u4")) for x in (first, second))
        self.space = self.pieces.piece_to_id(_SPACE)
        self.known = Known(self.learn, MEMORY // 4)

    def learn(self, runs: list[str]) -> list[bytes | bool]:
        """Of each run how many tokens the first gives, those, and those of the second, four bytes each; False if their bytes aren't the run's."""
        if not runs:
            return []
        whole = "".join(runs).encode()
        bytes_of = pc.binary_length(pa.array(runs, pa.large_string())).to_numpy().astype(np.int64)
        first, second = [self.bytes.encode_ordinary(r) for r in runs], [x or [self.space] for x in self.pieces.encode([r[1:] for r in runs], num_threads=1)]
        flat, told, right = [], [], True
        for ids, (known, word) in ((first, self.first), (second, self.second)):
            every, sizes = list(chain.from_iterable(ids)), np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(b"".join(map(known.__getitem__, every)))
            told.append((word[every] if every else word[:0], sizes))
            ends = np.concatenate([[0], np.cumsum(told[-1][0] >> ID_BITS, dtype=np.int64)])[np.concatenate([[0], np.cumsum(sizes)])]
            right = right & (np.diff(ends) == bytes_of)
        if right.all() and not flat[0] == flat[1] == whole:  # as long as their runs, but not the same
            x, y, z = (np.frombuffer(b, np.uint8) for b in (whole, *flat))
            right[np.searchsorted(np.cumsum(bytes_of), np.flatnonzero((x != y) | (x != z)), "right")] = False
        if not right.all():
            out = np.full(len(runs), False, object)
            out[right] = self.learn([r for r, ok in zip(runs, right, strict=True) if ok])
            return out.tolist()
        (a, n_a), (b, n_b) = told
        sizes = 1 + n_a + n_b
        ends = np.cumsum(sizes)
        starts = ends - sizes
        words = np.empty(ends[-1], "<u4")
        words[starts] = n_a
        words[np.arange(len(a)) + np.repeat(starts + 1 - (np.cumsum(n_a) - n_a), n_a)] = a
        words[np.arange(len(b)) + np.repeat(starts + 1 + n_a - (np.cumsum(n_b) - n_b), n_b)] = b
        raw = words.tobytes()
        return [raw[i:j] for i, j in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]

    def cut(self, text: bytes) -> list[bytes]:
        """" " + text in pieces of about PIECE bytes, each of whole runs; none of an empty text."""
        at, out = 0, []
        while at < len(text):
            end = len(text)
            if end - at > PIECE:
                cut = text.find(b" ", at + PIECE)
                while cut > 0 and text[cut - 1] == 32:  # within a run of spaces
                    cut = text.find(b" ", cut + 1)
                end = cut if cut > 0 else end
            out.append((b"" if at else b" ") + text[at:end])
            at = end
        return out

    def good(self, piece: bytes) -> bool:
        """Do both tokenizers give back its bytes? Those of no UTF-8 they don't."""
        try:
            piece.decode()
        except UnicodeDecodeError:
            return False
        return False not in self.known.all(runs_of([piece])[0].dictionary.to_pylist())


def runs_of(pieces: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The runs of pieces of valid UTF-8 that each begin with a space, one after the other, and at which of them pieces begin, with the end."""
    data = b"".join(pieces)
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
    space = np.frombuffer(data, np.uint8) == 32
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[edges[:-1]] = True
    at = np.append(np.flatnonzero(starts), len(data))
    runs = pa.Array.from_buffers(pa.string(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)])
    return runs.dictionary_encode(), np.searchsorted(at, edges)

"""Token ids of whole texts with a public tokenizer, remembering what space-separated units encode to.

Byte-pair merges never cross a pre-token and the pre-tokens of both vocabularies never cross the spaces at which texts
are split here, so a unit's ids don't depend on its neighbours. Texts with other white space than single spaces and
line ends between words go through the tokenizer whole, and so do those that hold an added token's content, which is
that token's id as in the library's plain encode.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from eventloom.llm.common import remembering

#: Units remembered by a worker, in two halves: bounds its memory. When one is full, the units of the other that weren't met
#: meanwhile are forgotten.
REMEMBERED = 500_000

#: The pre-token patterns of the two vocabularies, as their files state them (fixed values).
SPACED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
UNSPACED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Below it, libraries agree on letters, digits, case and normal forms; units with other characters go through the tokenizer whole.
LATIN_END = "\u0250"


def byte_signs() -> dict[int, int]:
    """Byte-level vocabularies show printable bytes as themselves and the others, in order, as 256, 257, ..."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}


#: Each byte's sign as a 16-bit code point; null stays, as it parts pieces.
SIGN_OF = np.array([b and byte_signs().get(b, b) for b in range(256)], "<u2")
#: Signs that are a pre-token of their own, as many as there are, behind letters and before nothing, in both patterns.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
#: Words of letters below LATIN_END, but for the one that isn't a letter any more in lower case.
WORD = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
ID = attrgetter("id")


def plain(text: str) -> bool:
    """Printable words with one space or line end between them."""
    flat = text.replace("\n", " ")
    return flat.isprintable() and "  " not in flat and flat[0] != " " and flat[-1] != " "


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes, without any end id.

    splits_added: the content of an added token, like <|endoftext|>, is split as other text is; the operators don't.
    """

    def __init__(self, path: str, keeps_space: bool, splits_added: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = splits_added
        self.added = [] if splits_added else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Whether a space belongs to the token behind it (byte-level vocabulary) or is dropped.
        self.keeps_space = keeps_space
        self.tokenize = self.tokenizer.model.tokenize
        self.split = regex.compile(SPACED if keeps_space else UNSPACED).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if t and ((self.keeps_space and not plain(t)) or any(a in t for a in self.added))]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(whole, self.raw([texts[i] for i in whole]), strict=True):
            out[i] = ids
        odd = set(whole)
        cut = [i for i, t in enumerate(texts) if t and i not in odd]
        # Units are remembered with the space or line end before them if the vocabulary keeps it; the first unit of a text
        # has no space before it.
        firsts = [b""] * len(cut)
        if self.keeps_space:
            parts = [texts[i].replace("\n", " \n").partition(" ") for i in cut]
            firsts, rest = self.raw([p[0] for p in parts]), [p[2] for p in parts]
        else:
            rest = [texts[i].replace("\n", " ") for i in cut]
        for i, first, ids in zip(cut, firsts, self.joined(rest), strict=True):
            out[i] = first + ids
        return out

    def joined(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of units with a space between them. All texts look up each distinct unit once, and words without
        the signs behind them, which are pre-tokens of their own."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        word = pc.ascii_rtrim(coded.dictionary, SIGNS)
        word = pc.if_else(pc.match_substring_regex(word, WORD), word, coded.dictionary)
        words = word.dictionary_encode()
        behind = (pc.binary_length(coded.dictionary).to_numpy() - pc.binary_length(word).to_numpy()).astype(np.int64)
        signed = np.flatnonzero(behind)
        signs = [u[-n:] for u, n in zip(strings(coded.dictionary.take(pa.array(signed))), behind[signed].tolist(), strict=True)]
        names = strings(words.dictionary)
        found = self.known_ids(names)
        # Behind the words, in the same row of ids, come the distinct signs.
        kinds = {x: k for k, x in enumerate(dict.fromkeys(signs), len(found))}
        found += self.known_signs(list(kinds))
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        # A unit is a word, or a word and signs: its ids are put together before those of the texts.
        of = np.stack([words.indices.to_numpy().astype(np.int64), np.full(len(word), -1)], 1)
        of[signed, 1] = np.fromiter((kinds[x] for x in signs), np.int64, len(signs))
        pairs = of.ravel()[of.ravel() >= 0]
        ids = np.frombuffer(b"".join(found), "<u4")[spread(start[pairs], size[pairs])]
        each = size[of[:, 0]]
        each[signed] += size[of[signed, 1]]
        codes = coded.indices.to_numpy()
        sizes = each[codes]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        data = ids[spread((np.cumsum(each) - each)[codes], sizes)].tobytes()
        cuts = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def known_ids(self, units: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        found = list(map(self.known.get, units))
        if None in found:
            # Most texts have some new units: only these are looked up again.
            missing = [u for u, ids in zip(units, found, strict=True) if ids is None]
            older = list(map(self.older.get, missing))
            self.known.update((u, ids) for u, ids in zip(missing, older, strict=True) if ids is not None)
            self.learn([u for u, ids in zip(missing, older, strict=True) if ids is None])
            found = [self.known[u] if ids is None else ids for u, ids in zip(units, found, strict=True)]
        return found

    def known_signs(self, signs: list[str]) -> list[bytes]:
        """The ids of signs behind a word; there are few distinct ones."""
        return self.merged(signs, range(1, len(signs) + 1))

    def learn(self, units: list[str]) -> None:
        pieces, ends, common, strange = [], [], [], []
        for u in units:
            if not (u.isascii() or max(u) < LATIN_END) or not (u.isalpha() or u.lstrip("\n").isprintable()):
                strange.append(u)
                continue
            shown = u.lower() if not self.keeps_space else u if u[:1] == "\n" or not u else " " + u
            if u.isalpha() and (self.keeps_space or shown.isalpha()):
                pieces.append(shown)
            else:
                pieces += self.split(shown)
            common.append(u)
            ends.append(len(pieces))
        self.known.update(zip(common, self.merged(pieces, ends), strict=True))
        self.known.update(zip(strange, self.raw([" " + u if self.keeps_space and u[0] != "\n" else u for u in strange]), strict=True))

    def merged(self, pieces: list[str], ends: Iterable[int]) -> list[bytes]:
        """The ids of pre-tokens in a row, by the tokenizer's own merges, cut behind so many of them. No piece holds a null sign."""
        if not pieces:
            return [b"" for _ in ends]
        # All pieces get the vocabulary's signs at once.
        shown = SIGN_OF[np.frombuffer("\0".join(pieces).encode(), np.uint8)].tobytes().decode("utf-16-le").split("\0")
        ids: list[int] = []
        counts = [0]
        for piece in shown:
            ids += map(ID, self.tokenize(piece))
            counts.append(4 * len(ids))
        packed, cuts = np.array(ids, "<u4").tobytes(), [0, *(counts[k] for k in ends)]
        return [packed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs that begin at `starts`, one run after the other."""
    ends = np.cumsum(sizes)
    at = np.repeat(starts - (ends - sizes), sizes)
    at += np.arange(len(at))
    return at


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, keeps_space: bool) -> Encoder:
    """One per worker process: what it remembers serves later tasks too."""
    remembering(f"tokens {path}", _ENCODERS)
    if (path, keeps_space) not in _ENCODERS:
        _ENCODERS[path, keeps_space] = Encoder(path, keeps_space, splits_added=False)
    return _ENCODERS[path, keeps_space]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

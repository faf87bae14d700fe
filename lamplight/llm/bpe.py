"""BPE encoding and decoding by prefix-sharing trie traversal.

Distinct words are put into a trie in the form of their sorted list, in which neighbours share prefixes; walking
that list is the depth-first traversal. At every node the last token of the prefix's encoding is kept. It is
unique: the encoding of a prefix ends in the one token that fits the last token of the prefix it leaves behind.
So shared prefixes are encoded once, and a word's encoding is read off backwards.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamplight.llm.common import pieces

#: Unicode white space, as the tokenizer's patterns take it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
#: The same over lower-case Latin-1.
CHUNK = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\t-\\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
END = "</w>"
#: Bytes of keys and values in a generation of results kept between batches (the objects around them cost more).
CACHE_BYTES = 4_000_000
#: Pairs of tokens whose border is remembered.
CACHE_PAIRS = 400_000
#: Bytes of text that are encoded together; their results leave as one batch. A longer text stands alone.
RUN_BYTES = 1_000_000


def byte_letters() -> list[str]:
    """Printable stand-ins for the 256 bytes: printable Latin-1 stands for itself, the rest follows from 256."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Generations:
    """Results kept between batches. When the young are too large they become the old, and the old go; what is
    asked for again turns young. So memory is bounded in bytes, whatever the length of a word, and forgetting costs
    time but changes no result."""

    def __init__(self) -> None:
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0

    def age(self) -> None:
        if self.held > CACHE_BYTES:
            self.old, self.young, self.held = self.young, {}, 0

    def put(self, key: str | bytes, value: bytes) -> None:
        self.young[key] = value
        self.held += len(key) + len(value) + 16

    def missing(self, keys: set) -> set:
        """Those of the keys that neither generation has; found old ones turn young."""
        keys = keys - self.young.keys()
        again = keys & self.old.keys()
        for k in again:
            self.put(k, self.old[k])
        return keys - again


class WordBPE:
    """A word-level byte BPE read from a tokenizer file (lower case, white space dropped, word ends marked)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.names: dict[int, str] = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.specials = regex.compile("|".join(f"({regex.escape(t)})" for t in self.special)) if self.special else None
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank: dict[tuple[str, str], int] = {m: i for i, m in enumerate(merges)}
        #: A token's parts and the rank at which it arises; single letters have neither.
        self.parts = {a + b: (a, b) for a, b in reversed(merges)}
        self.arises = {a + b: i for i, (a, b) in reversed(list(enumerate(merges)))}
        self.longest = max(len(t) - len(END) * t.endswith(END) for t in self.ids)
        self.letters = byte_letters()
        self.map = dict(enumerate(self.letters))
        #: Tokens that encode as themselves, by id; 0 and up.
        self.valid = {t: i for t, i in self.ids.items() if self._own(t)}
        self._fit: dict[int, bool] = {}  # by the left token's id, times 2^32, plus the right one's
        self.packed = [struct.pack("<I", i) for i in range(max(self.names) + 1)]
        self.size = [len(self.names.get(i, "")) for i in range(max(self.names) + 1)]
        self.named = [self.names.get(i, "").encode("utf-8") for i in range(max(self.names) + 1)]
        self.words: Generations = Generations()
        self.chunks: Generations = Generations()

    def _own(self, token: str) -> bool:
        """Whether the token, as letters, encodes as itself."""
        body = token[: -len(END)] if token.endswith(END) else token
        if not body:
            return False
        return self.plain([*body[:-1], body[-1] + (END if token.endswith(END) else "")]) == [token] and (len(body) == 1 or token in self.parts)

    def plain(self, symbols: list[str]) -> list[str]:
        """BPE as defined: the pair of lowest rank, leftmost first, until none is left."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            symbols = [*symbols[:best], symbols[best] + symbols[best + 1], *symbols[best + 2 :]]
        return symbols

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right stay apart when their letters are encoded together.

        Undoing the merges on both sides of the border from the latest back: at each moment the two pieces at
        the border stood side by side, and had their pair a merge that comes before the merge which takes one
        of them away, BPE would have joined them.
        """
        found = self._fit[left << 32 | right] = self._fits(self.names[left], self.names[right])
        return found

    def _fits(self, left: str, right: str) -> bool:
        never = 1 << 60
        until_left = until_right = never  # the rank at which the piece vanishes into a larger one
        while True:
            rank = self.rank.get((left, right))
            # of equal ranks the leftmost pair goes first: the left piece is taken before, the right piece after
            if rank is not None and rank < until_left and rank <= until_right:
                return False
            a, b = self.arises.get(left, -1), self.arises.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                left, until_left = self.parts[left][1], a
            else:
                right, until_right = self.parts[right][0], b

    def encode_words(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, token ids) of distinct words in sorted order; a word is a string of byte letters, not empty."""
        find, known, longest, size = self.valid.get, self._fit.get, self.longest, self.size
        last: list[int] = [-1]  # at each depth of the present path: the last token there
        before = ""
        for word in sorted(words):
            n, shared, most = len(word), 0, min(len(word) - 1, len(before), len(last) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for i in range(shared + 1, n):
                for j in range(i - longest if i > longest else 0, i):
                    token = find(word[j:i])
                    if token is not None:
                        if not j:
                            break
                        fit = known(last[j] << 32 | token)
                        if self.fits(last[j], token) if fit is None else fit:
                            break
                last.append(token)
            marked = word + END
            for j in range(n - longest if n > longest else 0, n):
                token = find(marked[j:])
                if token is not None:
                    if not j:
                        break
                    fit = known(last[j] << 32 | token)
                    if self.fits(last[j], token) if fit is None else fit:
                        break
            tokens, at = [token], j
            while at:
                token = last[at]
                tokens.append(token)
                at -= size[token]
            tokens.reverse()
            before = word
            yield word, tokens

    def learn(self, words: set[str]) -> None:
        """Encode words (as in the text) and keep the ids."""
        spelled = {w if w.isascii() and w.isprintable() else w.encode("utf-8").decode("latin-1").translate(self.map): w for w in words}
        packed, put = self.packed.__getitem__, self.words.put
        for letters, tokens in self.encode_words(list(spelled)):
            put(spelled[letters], packed(tokens[0]) if len(tokens) == 1 else b"".join(map(packed, tokens)))

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens: composed, lower case letter by letter, white space dropped."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case here does not look at the neighbours
                text = text.replace("Σ", "σ")
        return WORDS.findall(text.lower())

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, the latter marked by a leading blank."""
        if self.specials is None or not any(t in text for t in self.special):
            return self.split(text)
        out: list[str] = []
        for part in self.specials.splititer(text):
            if part in self.special:
                out.append(" " + part)
            elif part:
                out += self.split(part)
        return out

    def forget(self) -> None:
        """Drop what is kept between runs; the worker that held it may serve other stages for long."""
        self.words, self.chunks = Generations(), Generations()
        self._fit.clear()

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """Of each text the ids, as little-endian unsigned 32-bit integers.

        A text in Latin-1 without special tokens is first cut at ASCII white space: neither composition nor a
        word reaches over it, so each such chunk is looked up on its own. Any other text is split as a whole.
        """
        if len(self._fit) > CACHE_PAIRS:
            self._fit.clear()
        for cache in (self.words, self.chunks):
            cache.age()
        split: list[tuple[dict, list]] = []
        chunks: set[bytes] = set()
        words: set[str] = set()
        for text in texts:
            try:
                if any(t in text for t in self.special):
                    raise UnicodeError
                parts = text.encode("latin-1").split()
                split.append((self.chunks.young, parts))
                chunks.update(parts)
            except UnicodeError:
                parts = self.pieces(text)
                split.append((self.words.young, parts))
                words.update(parts)
        new = {c: CHUNK.findall(c.decode("latin-1").lower()) for c in self.chunks.missing(chunks)}
        words.update(*new.values())
        self.words.young.update((" " + t, struct.pack("<I", i)) for t, i in self.special.items())
        self.learn(self.words.missing(words))
        ids = self.words.young
        for c, parts in new.items():
            self.chunks.put(c, ids[parts[0]] if len(parts) == 1 else b"".join(map(ids.__getitem__, parts)))
        for known, parts in split:
            yield b"".join(map(known.__getitem__, parts))

    def decode(self, packed: bytes) -> bytes:
        """The tokens of packed ids, joined by spaces (the file names no decoder), in UTF-8."""
        return b" ".join(map(self.named.__getitem__, array("I", packed)))


@lru_cache(maxsize=2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def _encoded(path: str, digests: bool, decoded: bool):
    """A run's ids (and texts) are made, sent on and forgotten before the next run begins."""
    kind = pa.string() if digests else pa.binary()

    def shown(value: bytes) -> bytes | str:
        return hashlib.sha256(value).hexdigest() if digests else value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        try:
            for batch in batches:
                for part in pieces(batch, 1, RUN_BYTES):
                    counts, ids, said = [], [], []
                    for packed in bpe.encode_texts(["" if t is None else t for t in part.column(1).to_pylist()]):
                        counts.append(len(packed) // 4)
                        ids.append(shown(packed))
                        if decoded:
                            said.append(shown(bpe.decode(packed)))
                    columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids, kind)]
                    yield pa.RecordBatch.from_arrays([*columns, *([pa.array(said, kind)] if decoded else [])], ["doc_id", "n_tokens", "ids", *(["decoded"] if decoded else [])])
        finally:
            bpe.forget()
            pa.default_memory_pool().release_unused()

    return run


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, decoded: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids and, unless decoded=False, decoded.

    ids holds the token ids as little-endian unsigned 32-bit integers and decoded the UTF-8 text of those ids;
    with digests=True both are their SHA-256 in hex. A null text counts as empty and has no ids. Each row is
    encoded on its own, so repeated rows repeat their result; an empty table gives no rows; other columns of
    docs are not read. A word of any length is one path in the trie. A worker holds one run of texts of RUN_BYTES (or
    one longer text) with its results, and caches bounded in bytes.
    """
    kind = "string" if digests else "binary"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _encoded(path, digests, decoded), f"doc_id long, n_tokens long, ids {kind}" + f", decoded {kind}" * decoded
    )

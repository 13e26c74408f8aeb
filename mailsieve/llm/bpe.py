"""BPE encoding and decoding by traversal of a prefix-sharing trie.

The encoding of a prefix is fixed by its last token: what is left of it is the encoding of a
shorter prefix, and two neighbours are right exactly if no merge would have crossed
their border.  So the distinct words of a batch form a trie, a depth-first walk hands each node
the last-token states of its ancestors, and a prefix that many words share is encoded once.
A word is read off by walking back over the last tokens; a very long word costs time in
proportion to its length.

Vocabulary and rules come from a public tokenizer file; its path is a parameter.
"""

from __future__ import annotations

import functools
import gc
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import remembered

#: Bytes of words kept between batches of a worker (each word counts its letters four times, for its text and ids,
#: and 200 for objects).  Past half of it the words are set aside; those met again come back, the others go next time.
KEPT_BYTES = 192 << 20
#: Characters of text taken together; bounds the words in memory, not what is read.
BATCH_CHARS = 4_000_000
#: Words of so many bytes have their states found in order, so that asking for one never goes deep.
DEEP = 256
_UNKNOWN = [-1] * DEEP
_NEVER = 1 << 40


def _byte_names() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


def _classes(limit: int) -> tuple[str, str]:
    """Letters and numbers below ``limit`` as character classes."""
    kinds = {"L": [], "N": []}
    for c in range(limit):
        if (k := unicodedata.category(chr(c))[0]) in kinds:
            spans = kinds[k]
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return tuple("".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in kinds[k]) for k in "LN")


class TrieEncoder:
    """Encoder for one tokenizer file (byte-level BPE with marked word ends)."""

    #: Below this code point the word pattern is compiled to plain classes; other texts
    #: take the tokenizer file's own normaliser and splitter.
    PLAIN = 0x500

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.path, self.suffix = path, model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        names = _byte_names()
        to_byte = {n: b for b, n in enumerate(names)}
        self.names = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.first = [vocab[n] for n in names]
        self.last = [vocab[n + self.suffix] for n in names]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]):
            pair, made = (vocab[a], vocab[b]), vocab[a + b]
            self.rank.setdefault(pair, r)
            self.parts.setdefault(made, (*pair, r))
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.size: dict[int, int] = {}
        for token, i in vocab.items():
            ends = bool(self.suffix) and token.endswith(self.suffix) and len(token) > len(self.suffix)
            raw = bytes(to_byte[c] for c in (token[:-len(self.suffix)] if ends else token))
            if i in self.parts or len(raw) == 1:
                (self.final if ends else self.inner)[raw] = i
                self.size[i] = len(raw)
        self.spines: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        self.inner_lengths = self._lengths(self.inner)
        self.final_lengths = self._lengths(self.final)
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.aside: dict[str, bytes] = {}
        self.letters = 0
        letters, numbers = _classes(self.PLAIN)
        space = r"\t-\r \u0085 "
        self.plain = re.compile(
            f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.beyond = re.compile(f"[^\\u0000-\\u{self.PLAIN - 1:04x}]")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @staticmethod
    def _lengths(tokens: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
        """For two to four last bytes: lengths of the tokens that end in them, and of their own ends
        that are tokens, longest first."""
        found: dict[bytes, set[int]] = {}
        for raw in tokens:
            if len(raw) > 1:
                for n in range(2, min(4, len(raw)) + 1):
                    found.setdefault(raw[-n:], set()).add(len(raw))
        for k, lengths in found.items():
            lengths.update(n for n in range(2, len(k)) if k[-n:] in tokens)
        return {k: tuple(sorted(v, reverse=True)) for k, v in found.items()}

    # -- neighbours ---------------------------------------------------------------
    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(piece, rank that makes it, rank that uses it up) along one edge of a token."""
        if (token, side) not in self.spines:
            out, used = [], _NEVER
            while token in self.parts:
                a, b, r = self.parts[token]
                out.append((token, r, used))
                token, used = (a, b)[side], r
            out.append((token, -1, used))
            self.spines[(out[0][0], side)] = out
            return out
        return self.spines[(token, side)]

    def _neighbours(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens."""
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            known, rank = True, self.rank
            for a, made_a, used_a in self._spine(left, 1):
                for b, made_b, used_b in self._spine(right, 0):
                    r = rank.get((a, b))
                    if r is not None:
                        at = max(r, made_a, made_b)
                        if at < used_a and at <= used_b:
                            known = False
                            break
                if not known:
                    break
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            self.fits[key] = known
        return known

    def _last_token(self, raw: bytes, end: int, state: list[int], tokens, lengths, single) -> int:
        """Last token of the encoding of ``raw[:end]``, from the states of the prefixes it asks for."""
        known_fits = self.fits.get
        ends = lengths.get(raw[end - 4:end]) if end > 3 else None
        for n in ends or lengths.get(raw[end - 3:end] if end > 2 else raw[:end]) or (2,):
            at = end - n
            if at > 0:
                t = tokens.get(raw[at:end])
                if t is not None:
                    left = state[at]
                    if left < 0:
                        if at == 1:
                            left = state[1] = self.first[raw[0]]
                        else:
                            left = state[at] = self._last_token(raw, at, state, self.inner, self.inner_lengths, self.first)
                    known = known_fits(left << 20 | t)
                    if known or known is None and self._neighbours(left, t):
                        return t
            elif not at:
                t = tokens.get(raw[:end])
                if t is not None:
                    return t
        return single[raw[end - 1]]

    def _walk(self, words: Iterable[str]) -> None:
        """Depth-first over the trie of ``words``: sorted words visit its nodes in order, and
        the stack of states is cut back to the prefix shared with the word before.  A node's state is
        found when it is first asked for and kept for all words below; a long word's, all in order."""
        ordered = sorted(words)                                # by code points, which is the order of their bytes
        raws = list(map(str.encode, ordered))
        state, last_token, size = [0], self._last_token, self.size
        inner = self.inner, self.inner_lengths, self.first
        final = self.final, self.final_lengths, self.last
        found, ends = [], []                                   # all ids, each word's from its end; where each word's ids end
        add = found.append
        for raw, shared in zip(raws, _shared(raws)):
            n = len(raw)
            known = len(state) - 1
            if shared < known:
                known = shared
            if n <= known:
                known = n - 1
            state[known + 1:] = _UNKNOWN[known + 1:n] if n < DEEP else [-1] * (n - 1 - known)
            if n >= DEEP:
                for end in range(1, n):
                    if state[end] < 0:
                        state[end] = last_token(raw, end, state, *inner)
            t = last_token(raw, n, state, *final)
            add(t)
            at = n - size[t]
            while at > 0:
                t = state[at]
                if t < 0:
                    t = state[at] = last_token(raw, at, state, *inner)
                add(t)
                at -= size[t]
            ends.append(len(found))
        ids = array("I", found)
        ids.reverse()
        laid, whole = ids.tobytes(), 4 * len(found)
        self.words.update([(w, laid[whole - 4 * b:whole - 4 * a]) for w, a, b in zip(ordered, [0, *ends], ends)])

    # -- texts --------------------------------------------------------------------
    #: What the vocabulary's splitter takes for text and str.split() for white space.
    ODD_SPACE = re.compile("[\x1c-\x1f]")

    @functools.cached_property
    def _library(self):
        from tokenizers import Tokenizer
        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> str | None:
        """A text as the splitter sees it, if white space is all that its chunks must be cut at."""
        if text.isascii() or self.beyond.search(text) is None:
            plain = unicodedata.normalize("NFC", text)
            if not self.ODD_SPACE.search(plain) and (plain.isascii() or self.beyond.search(plain) is None):
                return plain.replace("Σ", "σ").lower()
        return None

    def _split(self, text: str) -> list[str]:
        """White-space chunks of a plain text; of any other, the splitter's own words."""
        if (plain := self._plain(text)) is not None:
            return plain.split()
        found = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        back = _back()
        return [bytes(back[c] for c in piece).decode("utf-8") for piece, _ in found]

    def _pieces(self, text: str) -> list[str | int]:
        """Words of a text; control strings of the vocabulary come as ids."""
        if self.specials is None or "<" not in text:
            return self._split(text)
        out: list[str | int] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out += self._split(part)
        return out

    def _recall(self, chunks: list[str]) -> tuple[list[bytes | None], list[str]]:
        """What is known of distinct chunks, each looked up once, and those that are not known; chunks set aside come back."""
        found = list(map(self.words.get, chunks))
        at = [k for k, ids in enumerate(found) if ids is None]
        if not at:
            return found, []
        missed = [chunks[k] for k in at]
        self.letters += sum(map(len, missed))
        if self.aside:
            new = []
            for k, c, ids in zip(at, missed, map(self.aside.get, missed)):
                if ids is None:
                    new.append(c)
                else:
                    found[k] = self.words[c] = ids
            missed = new
        return found, missed

    def _learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of distinct chunks, new ones encoded; no word of the splitter reaches over white space, so a
        chunk's ids are those of its words, one after another."""
        if 200 * len(self.words) + 4 * self.letters > KEPT_BYTES // 2:
            self.aside, self.words, self.letters = self.words, {}, 0
        plain, beyond, cut, whole = self.plain.findall, self.beyond.search, [], []
        found, new = self._recall(chunks)
        for c in new:
            if not c.isalpha() and (c.isascii() or beyond(c) is None) and (w := plain(c)) != [c]:
                cut.append((c, w))
            else:
                whole.append(c)
        self._walk(whole)
        self._walk(self._recall(list(set().union(*[w for _, w in cut])))[1])
        known = self.words.__getitem__
        self.words.update([(c, b"".join(map(known, w))) for c, w in cut])
        if new:
            found = [known(c) if ids is None else ids for c, ids in zip(chunks, found)]
        return found

    def _encode_plain(self, texts: list[str], others: set[str]) -> Iterator[bytes]:
        """Ids of texts that only white space cuts; ``others`` are learnt with them.

        Each chunk is numbered, so a distinct one is looked up once however often it stands there; the
        ids of all texts are then taken from those of the distinct chunks in one go.
        """
        lists = pc.utf8_split_whitespace(pa.array(texts, pa.large_string()))
        chunks = lists.values.dictionary_encode()
        distinct = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._learn(distinct + list(others.difference(distinct)) if others else distinct)[:len(distinct)]
        number, border = chunks.indices.to_numpy(), lists.offsets.to_numpy()
        del lists, chunks, distinct
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(sizes) - sizes
        laid = np.frombuffer(b"".join(known), "<u4")
        many = sizes[number]
        ends = np.concatenate([[0], np.cumsum(many)])          # ids before each chunk of the texts
        kind = np.int32 if ends[-1] < 1 << 31 else np.int64    # no more ids are laid than stand in the texts
        places = np.repeat((starts[number] - ends[:-1]).astype(kind), many)
        places += np.arange(len(places), dtype=kind)
        ids, border = laid[places].tobytes(), (4 * ends[border]).tolist()
        return (ids[a:b] for a, b in zip(border, border[1:]))

    def encode_many(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end]) <= BATCH_CHARS):
                chars += len(texts[end])
                end += 1
            collects = gc.isenabled()
            gc.disable()               # very many words are made and none refers back; looking through them costs time
            try:
                split = [self._plain(t) if self.specials is None or "<" not in t else None for t in texts[start:end]]
                odd = [self._pieces(t) for t, plain in zip(texts[start:end], split) if plain is None]
                words = set().union(*odd)
                control = [w for w in words if isinstance(w, int)] if self.specials else ()
                plain = self._encode_plain([t for t in split if t is not None], words.difference(control))
                for i in control:
                    self.words[i] = array("I", [i]).tobytes()
            finally:
                if collects:
                    gc.enable()
            known, odd = self.words.__getitem__, iter(odd)
            for t in split:
                yield next(plain) if t is not None else b"".join(map(known, next(odd)))
            start = end

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary has no decoder of its own: token strings joined by a space."""
        return " ".join(map(self.names.__getitem__, ids))


def _shared(ordered: list[bytes]) -> list[int]:
    """Bytes that each word shares with the one before it."""
    if not ordered:
        return []
    width = 32
    laid = np.frombuffer(b"".join([raw[:width].ljust(width, b"\xff") for raw in ordered]), np.uint8).reshape(-1, width)
    differ = laid[1:] != laid[:-1]
    out = [0, *np.where(differ.any(1), differ.argmax(1), width).tolist()]
    for k in [k for k, n in enumerate(out) if n == width]:
        raw, before = ordered[k], ordered[k - 1]
        at, most = width, min(len(raw), len(before))
        while at < most and raw[at] == before[at]:
            at += 1
        out[k] = at
    return out


@functools.cache
def _back() -> dict[str, int]:
    return {n: b for b, n in enumerate(_byte_names())}


def encoder(path: str) -> TrieEncoder:
    """One encoder for each worker process; its word memory is kept between tasks."""
    if sys.byteorder != "little":
        raise RuntimeError("token ids are laid out for little-endian machines")
    return remembered(("bpe", path), lambda: TrieEncoder(path))


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def encode_decode(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """Encode and decode whole texts; one pass over the rows, no shuffle.

    Takes ``doc_id, text`` (other columns are ignored).  A null or empty text has no tokens and
    decodes to the empty string.  Repeated rows are encoded alike.  Returns ``doc_id, n_tokens,
    ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded``.
    """
    kept = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if keep_ids else []
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            names, many = batch.column("doc_id"), batch.num_rows
            step = 1000
            for at in range(0, many, step):
                texts = [t or "" for t in batch.column("text").slice(at, step).to_pylist()]
                rows = {n: [] for n in schema.names}
                for raw in enc.encode_many(texts):
                    ids = array("I", raw)
                    decoded = enc.decode(ids)
                    rows["n_tokens"].append(len(ids))
                    rows["ids_sha256"].append(hashlib.sha256(raw).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    if keep_ids:
                        rows["ids"].append(ids.tolist())
                        rows["decoded"].append(decoded)
                rows["doc_id"] = names.slice(at, step)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[f.name], f.type) if f.name != "doc_id" else rows["doc_id"].cast(pa.int64())
                     for f in schema], schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(
        run, ddl + (", ids array<int>, decoded string" if keep_ids else ""))

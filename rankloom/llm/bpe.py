"""Exact BPE by backtracking, and decoding by an offset table.

A word's tokens are found from left to right: the longest token at the position is taken if the pair table allows it
after the token before, else a shorter one, and if none is left the last token is given up. Places that turned out to be
dead ends are not entered twice, and a match reads no further than the longest token, so the time is linear in the word.
The pair table holds whether two tokens stand side by side in the merges' own result; its entries are made when first
asked for. Chunks beyond ASCII get their normal form and their words from the tokenizer file's own normaliser and word
pattern, as run by the library, so that both follow the library's Unicode tables.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import docs_of, held, in_arrow, slices

#: The words' pattern of the tokenizer file, for ASCII, and the signs that str.split() takes for spaces but
#: \s doesn't.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z]+|[0-9]|[^\sA-Za-z0-9]+"
NOT_SPACES = ("\x1c", "\x1d", "\x1e", "\x1f")
#: Distinct words and chunks that a task remembers before it starts anew, and the length of the longest of them.
MEMORY, LONG = 500_000, 128


def byte_signs() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Text chunk -> its ids as little-endian bytes; unknown chunks are encoded once."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        out = self.encode(chunk)
        if len(chunk) <= LONG:
            if len(self) >= MEMORY:
                self.clear()
            self[chunk] = out
        return out


class Encoder:
    """Backtracking encoder for a byte-level BPE file with word ends (a .json of the tokenizers library)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        spec = json.loads(open(path, encoding="utf-8").read())
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        signs = byte_signs()
        self.sign_bytes = {ord(sign): b for sign, b in signs.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words_pattern = regex.compile(WORDS)
        # A token's inner form: chr(byte), and chr(1024 + byte) for a byte that ends a word.
        inner: dict[str, str] = {}
        for sign, b in signs.items():
            inner[sign] = chr(b)
            inner[sign + self.end] = chr(1024 + b)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        base = [s for s in inner if s in vocab]
        rank = {s: i for i, s in enumerate(base)}
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(len(base))]
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            made = a + b
            inner.setdefault(made, inner[a] + inner[b])
            if made not in rank:
                rank[made] = len(self.halves)
                self.halves.append((rank[a], rank[b]))
            self.merged[rank[a], rank[b]] = rank[made]
        self.id_bytes = [b""] * len(rank)
        for token, r in rank.items():
            self.id_bytes[r] = vocab[token].to_bytes(4, "little")
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        self.ranks: dict[str, int] = {}
        self.lengths = [0] * len(rank)
        for token, r in rank.items():
            form, (a, b) = inner[token], self.halves[r]
            # A token that the merges can't reach from its own bytes never occurs.
            if r < len(base) or self.fits(a, b, r):
                self.automaton.add_word(form, r)
                self.ranks[form], self.lengths[r] = r, len(form)
        #: For each token the longest other one that begins it, or -1.
        self.shorter = [-1] * len(rank)
        for form, r in self.ranks.items():
            self.shorter[r] = self.longest(form, len(form) - 1)
        self.automaton.make_automaton()
        self.reach = max(self.lengths)
        self.known = Words(self.encode_word)
        self.chunks = Words(self.encode_chunk)
        size = max(max(vocab.values()), *self.special.values()) + 1 if self.special else max(vocab.values()) + 1
        strings = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            strings[i] = token
        raw = [s.encode() + b" " for s in strings]
        self.starts = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)

    def fits(self, left: int, right: int, under: int | None = None) -> bool:
        """Whether merging leaves these two tokens side by side; under: merges from this rank on don't count.

        Undo the merges of both tokens from the latest to the earliest; at each state the two signs that touch must
        not have a merge that would have come before the next one undone.
        """
        limit = len(self.halves) if under is None else under
        while True:
            made = self.merged.get((left, right))
            if made is not None and made < limit:
                return False
            left_open, right_open = self.halves[left][1] != left, self.halves[right][0] != right
            if left_open and (left > right or not right_open):
                limit, left = left, self.halves[left][1]
            elif right_open:
                limit, right = right + 1, self.halves[right][0]
            else:
                return True

    def allowed(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= 4_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.fits(left, right)
        return known

    def longest(self, form: str, most: int) -> int:
        """The longest token of at most so many signs that begins form, or -1."""
        get = self.ranks.get
        while most > 0:
            r = get(form[:most])
            if r is not None:
                return r
            most -= 1
        return -1

    def tokens(self, form: str) -> list[int]:
        """Ranks of the tokens of a word's inner form."""
        r = self.ranks.get(form)
        if r is not None:
            return [r]
        n, lengths, shorter, prefix, pairs = len(form), self.lengths, self.shorter, self.automaton.longest_prefix, self.pairs
        out: list[int] = []
        last, pos, dead, reach = -1, 0, None, self.reach
        rest = form[:reach]
        r = self.longest(rest, prefix(rest))
        while True:
            # r: the longest token not yet tried at pos
            while r >= 0:
                if dead is None or not dead[pos + lengths[r]]:
                    if last < 0:
                        break
                    fit = pairs.get((last, r))
                    if fit or fit is None and self.allowed(last, r):
                        break
                r = shorter[r]
            if r >= 0:
                out.append(r)
                last = r
                pos += lengths[r]
                if pos == n:
                    return out
                rest = form[pos : pos + reach]
                r = self.longest(rest, prefix(rest))
            else:
                if dead is None:
                    dead = bytearray(n + 1)
                dead[pos] = 1
                r = out.pop()
                pos -= lengths[r]
                last = out[-1] if out else -1
                r = shorter[r]

    def encode_word(self, word: str) -> bytes:
        """The ids of a word, given as the signs of its bytes."""
        form = word[:-1] + chr((1024 if self.end else 0) + ord(word[-1]))
        return b"".join(map(self.id_bytes.__getitem__, self.tokens(form)))

    def encode_chunk(self, chunk: str) -> bytes:
        if not chunk.isascii():
            return self.encode_foreign(chunk)
        chunk = chunk.lower()
        if chunk.isalpha():
            return self.known[chunk]
        if chunk[:-1].isalpha() and chunk[-1] in ".,:;?!":
            return self.known[chunk[:-1]] + self.known[chunk[-1]]
        return b"".join(map(self.known.__getitem__, self.words_pattern.findall(chunk)))

    def encode_foreign(self, text: str) -> bytes:
        """The ids of any text, with the library's normal form and words."""
        return b"".join(self.known[word.translate(self.sign_bytes)] for word, _ in self.split(self.normal(text)))

    def encode_plain(self, text: str) -> bytes:
        # No normal form, word or match reaches across white space.
        if any(c in text for c in NOT_SPACES):
            return self.encode_foreign(text)
        return b"".join(map(self.chunks.__getitem__, text.split()))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if self.special_pattern is None or not any(s in text for s in self.special):
            return self.encode_plain(text)
        parts = self.special_pattern.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self.encode_plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes, most: int = 1 << 18) -> bytes:
        """The tokens' strings with a space between, from the offset table, as UTF-8."""
        out = []
        for k in range(0, len(ids), 4 * most):
            at = np.frombuffer(ids[k : k + 4 * most], "<u4").astype(np.int64)
            begin = self.starts[at]
            size = self.starts[at + 1] - begin
            total = np.cumsum(size)
            where = np.repeat(begin - (total - size), size)
            where += np.arange(len(where))
            out.append(self.bytes[where].tobytes())
        return b"".join(out)[:-1]


def encoder(path: str) -> Encoder:
    return held(f"bpe:{path}", lambda: Encoder(path))


def digest_batch(path: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, counts, of_ids, of_text = encoder(path), [], [], []
        for part in slices(batch):
            for text in part.column("text").to_pylist():
                ids = coder.encode(text)
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(coder.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_batch(path: str):
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, ids, texts = encoder(path), [], []
        for part in slices(batch):
            for text in part.column("text").to_pylist():
                raw = coder.encode(text)
                ids.append(np.frombuffer(raw, "<u4").astype(np.int64))
                texts.append(coder.decode(raw).decode())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64())), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def bpe_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<long>, decoded string for every row; null texts count as empty and have no ids."""
    return in_arrow(docs_of(docs), encode_batch(tokenizer_path), "doc_id long, ids array<long>, decoded string", f"bpe:{tokenizer_path}")


def bpe_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row of docs, as it stands: no shuffle, one pass.

    Null and empty texts: 0 tokens and the digests of nothing; repeated rows are each encoded; an empty table gives an
    empty result; other columns are ignored. A task's memory is its batch and tables of bounded size.
    """
    return in_arrow(docs_of(docs), digest_batch(tokenizer_path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", f"bpe:{tokenizer_path}")

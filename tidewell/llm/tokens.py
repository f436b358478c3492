"""Exact tokenizer ids at the speed of a rank table.

A tokenizer of the tokenizers library that is byte-level BPE is also a table of ranks: at each step the
adjacent pair whose joined bytes have the lowest rank is merged. ``proven`` shows for a tokenizer file
that this gives its ids: every token, taken alone and with the merges before its own, must come down to
the very two parts that its own merge names. Then no other pair with the same bytes can stand side by side
when that rank's turn comes, because inside the token's bytes nothing else could have been merged. A file
that isn't proven, or a text with characters on which libraries may differ, goes through the tokenizers
library itself.

Two kinds are known: texts cut by the byte-level pattern (whole texts go through the rank table), and lower-
cased words with an end-of-word suffix (each distinct word is encoded once and kept).
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

#: The byte-level pattern, and the end of a word in a rank table, a byte that UTF-8 never has.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
END = b"\xff"
#: Characters whose classes are the same in all Unicode versions in use.
_STABLE = re.compile("[\u0000-׿ -⯿　-鿯가-힣＀-￯]*")
#: Characters of words for which lower-casing and normalisation are one to one.
_PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
#: Words kept by a worker; beyond it the dictionary starts anew, which changes no result.
CACHE = 600_000
#: Ranks of single bytes, above those of all merges.
_SINGLE = 1 << 20


def _byte_of_char() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def rank_table(path: str, check: bool = True) -> tuple[dict[bytes, int], dict[int, int], str] | None:
    """(bytes to rank, rank to id, kind) of a tokenizer file, or None if its ids may differ."""
    spec = json.load(open(path, encoding="utf-8"))
    model, norm, pre = spec["model"], spec.get("normalizer"), spec.get("pre_tokenizer") or {}
    suffix = model.get("end_of_word_suffix") or ""
    if model.get("type") != "BPE" or len(model["merges"]) > _SINGLE - 256 or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "ignore_merges", "byte_fallback")):
        return None
    if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not suffix:
        kind = "text"
    elif norm and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and suffix and [p["type"] for p in pre.get("pretokenizers", [])] == ["Split", "ByteLevel"] and pre["pretokenizers"][0]["pattern"].get("Regex") == WORD_PATTERN:
        kind = "word"
    else:
        return None
    table = _byte_of_char()

    def raw(token: str) -> bytes:
        end = bool(suffix) and token.endswith(suffix)
        return bytes(table[c] for c in (token[: -len(suffix)] if end else token)) + END * end

    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab = model["vocab"]
    ranks, ids = {}, {}
    for b in range(256):
        for tail in (b"", END) if suffix else (b"",):
            one = bytes([b]) + tail
            # a word's last byte and its end are one symbol: these pairs go before all merges
            ranks[one] = b if tail else _SINGLE + b
    for token, i in vocab.items():
        if all(c in table for c in token.removesuffix(suffix)):
            r = raw(token)
            if r in ranks and r != END:
                ids[ranks[r]] = i
    for k, (a, b) in enumerate(merges):
        joined = raw(a + b)
        if joined in ranks or a + b not in vocab:
            return None
        ranks[joined] = 256 + k
        ids[256 + k] = vocab[a + b]
    return (ranks, ids, kind) if not check or _proven(merges, suffix) else None


def _proven(merges: list[tuple[str, str]], suffix: str) -> bool:
    """Whether each merge's token comes down to the merge's own parts by the merges before it."""
    rank = {p: k for k, p in enumerate(merges)}
    joined = {a + b: k for k, (a, b) in enumerate(merges)}
    if len(joined) != len(merges):
        return False
    for k, (a, b) in enumerate(merges):
        token = a + b
        if suffix and token.endswith(suffix):
            body = token[: -len(suffix)]
            parts = [*body[:-1], body[-1] + suffix]
        else:
            parts = list(token)
        while len(parts) > 2:
            best = min(((joined.get(x + y, k), i) for i, (x, y) in enumerate(zip(parts, parts[1:]))), default=(k, 0))
            if best[0] >= k:
                break
            i = best[1]
            if rank.get((parts[i], parts[i + 1])) != best[0]:
                return False
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if parts != [a, b]:
            return False
    return True


class _Words(dict):
    """Ids of words, each encoded when it is first asked for."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> bytes:
        got = self[word] = self.of(word)
        return got


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, table: tuple[dict[bytes, int], dict[int, int], str] | None):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # a special token's string in a text is ordinary text
        self.kind = table[2] if table else "plain"
        if table:
            import regex
            import tiktoken

            ranks, ids, _ = table
            self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.id_of = np.zeros(max(ids) + 1, "<u4")
            self.id_of[list(ids)] = list(ids.values())
            self.cut = regex.compile(WORD_PATTERN).findall
            self.words = _Words(self._word)

    def _slow(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        if not _PLAIN.fullmatch(word):
            return self._slow(word)
        out: list[int] = []
        for piece in self.cut(unicodedata.normalize("NFC", word).lower()):
            out += self.bpe._core_bpe.encode_single_piece(piece.encode() + END)
        return self.id_of[out].tobytes()

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        if self.kind == "word":
            if len(self.words) > CACHE:
                self.words.clear()
            get = self.words.__getitem__
            # no token and no normalisation crosses a space
            return [b"".join(map(get, filter(None, t.replace("\n", " ").split(" ")))) for t in texts]
        if self.kind == "text":
            return [self.id_of[self.bpe.encode_to_numpy(t, disallowed_special=())].tobytes() if _STABLE.fullmatch(t) else self._slow(t) for t in texts]
        return [self._slow(t) for t in texts]


_ENCODERS: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, by_ranks: bool) -> TextEncoder:
    """A worker's encoder for a tokenizer file. by_ranks: the driver has proven the file's rank table."""
    key = (path, by_ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = TextEncoder(path, rank_table(path, check=False) if by_ranks else None)
    return _ENCODERS[key]


def small_batches(batch, text_col: str = "text", most_bytes: int = 4_000_000):
    """An Arrow batch in slices of about ``most_bytes`` of text, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop

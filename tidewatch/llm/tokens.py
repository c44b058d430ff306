"""Token ids of whole texts by the tokenizers library, each distinct pre-token encoded once.

A batch of texts is cut, in numpy, into pre-tokens: first only where the tokenizer's own pre-tokenizer cuts whatever
stands around, then, in parts made up of Latin letters, digits and ASCII punctuation alone, where the kind of character
changes. A part with anything else in it stays whole. Arrow finds the distinct pieces. Those that a worker hasn't met
lately go to the tokenizer's BPE model many at a time, past its normalizer and pre-tokenizer, or, where a part stayed
whole, through the whole tokenizer. Ids are then gathered for all pieces of all texts by one index.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from tidewatch.llm.common import LOWER, cache, claim, text_bytes, word_spans

#: Pieces in each of the two generations that a worker keeps: what isn't met again while one fills up is forgotten.
CACHE_PIECES = 150_000
#: Longer pieces are not kept.
CACHE_CHARS = 60
#: Bytes of text encoded at a time.
STEP = 1 << 20
#: Pieces encoded in one call.
CALL = 4096

# White space for the cut of byte-level texts: bytes, and beginnings of longer characters some of which are white space.
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_MAYBE_BLANK = np.zeros(256, dtype=bool)
_MAYBE_BLANK[[0xC2, 0xE1, 0xE2, 0xE3]] = True

ODD, LETTER, DIGIT, MARK, SPACE, LINE = range(6)


def _kinds() -> np.ndarray:
    """The kind of each byte. 0xC3 leads the letters from A-grave to y-diaeresis, apart from the two signs among them."""
    table = np.full(256, ODD, dtype=np.int8)
    table[33:127] = MARK
    table[ord("'")] = ODD
    table[48:58] = DIGIT
    table[65:91] = table[97:123] = LETTER
    table[0x80:0xC0] = table[0xC3] = LETTER
    table[32], table[10] = SPACE, LINE
    return table


KIND = _kinds()


def _alphabet() -> np.ndarray:
    """The printable character (as a code point) that stands for each byte in byte-level vocabularies; 0 becomes a space."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = np.zeros(256, dtype="<u4")
    table[printable] = printable
    others = [b for b in range(256) if b not in set(printable)]
    table[others] = 256 + np.arange(len(others))
    table[0] = 32
    return table


ALPHABET = _alphabet()


def _odd(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Bytes that keep their part from being cut."""
    odd = kind == ODD
    sign = np.flatnonzero(raw == 0xC3)
    sign = sign[sign < len(raw) - 1]
    odd[sign[(raw[sign + 1] == 0x97) | (raw[sign + 1] == 0xB7)]] = True
    return odd


class Encoder:
    """Ids of texts; `kind` tells where a text may be cut.

    space_led: byte-level pre-tokens, a single space opens the next one. spaced: pre-tokens hold no white space.
    whole: nothing is known, texts are encoded as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        spec = json.loads(self.tokenizer.to_str())
        self.kind = self._kind(spec)
        self.held: int | None = None
        self.young: dict[str, bytes] = cache("tokens")
        self.old: dict[str, bytes] = cache("tokens")
        if self.kind != "whole":
            self.bare = Tokenizer.from_file(path)
            self.bare.encode_special_tokens = True
            self.bare.normalizer = None
            self.bare.pre_tokenizer = CharDelimiterSplit(" ")
            suffix = spec["model"].get("end_of_word_suffix") or ""
            vocab = self.tokenizer.get_vocab(with_added_tokens=True)
            self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)
            self.sizes[list(vocab.values())] = [len(t) - len(suffix) if suffix and t.endswith(suffix) else len(t) for t in vocab]

    @staticmethod
    def _kind(spec: dict) -> str:
        """Cuts are made only for the two layouts that are known to allow them, setting by setting."""
        pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model.get("type") != "BPE" or odd:
            return "whole"
        suffix = model.get("end_of_word_suffix")
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None and not suffix:
            return "space_led"
        if pre.get("type") != "Sequence" or len(pre["pretokenizers"]) != 2 or (norm or {}).get("type") != "Sequence":
            return "whole"
        split, level = pre["pretokenizers"]
        steps = [(x.get("type"), (x.get("pattern") or {}).get("Regex"), x.get("content")) for x in norm["normalizers"]]
        words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        plain = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern") == {"Regex": words}
        byte_level = level.get("type") == "ByteLevel" and not level.get("use_regex") and not level.get("add_prefix_space")
        if plain and byte_level and steps == [("NFC", None, None), ("Replace", r"\s+", " "), ("Lowercase", None, None)]:
            return "spaced"
        return "whole"

    def _direct(self, texts: list[str]) -> list[bytes]:
        """Ids by the tokenizer as it is."""
        out: list[bytes] = []
        for at in range(0, len(texts), CALL):
            found = self.tokenizer.encode_batch_fast(texts[at : at + CALL], add_special_tokens=False)
            out += [np.array(x.ids, dtype="<u4").tobytes() for x in found]
        return out

    def _bpe(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens (without zero bytes) by the BPE model, CALL of them laid end to end.

        Tokens are cut back into pre-tokens by their lengths: both cover the same bytes.
        """
        out: list[bytes] = []
        for at in range(0, len(pieces), CALL):
            some = pieces[at : at + CALL]
            raw = np.frombuffer(("\0".join(some) + "\0").encode(), np.uint8)
            joined = ALPHABET[raw[:-1]].tobytes().decode("utf-32-le")
            ids = np.array(self.bare.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.cumsum(np.diff(np.flatnonzero(raw == 0), prepend=-1) - 1)
            ends = np.cumsum(self.sizes[ids])
            last = np.searchsorted(ends, stops)
            if last[-1] != len(ids) - 1 or (ends[last] != stops).any():
                out += self._direct(some)
                continue
            blob, cuts = ids.tobytes(), (4 * last + 4).tolist()
            out += [blob[a:b] for a, b in zip([0, *cuts[:-1]], cuts, strict=True)]
        return out

    def _cut_led(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Byte-level texts cut before single spaces, then where kinds change: bytes, starts of parts and of pieces, odd parts."""
        space = np.flatnonzero(raw == 32)
        inner = space[(space > 2) & (space < len(raw) - 1)]  # one in the first three bytes of a batch stays uncut
        ahead, one, two, three = raw[inner + 1], raw[inner - 1], raw[inner - 2], raw[inner - 3]
        blank = _BLANK[ahead] | _BLANK[one] | _MAYBE_BLANK[ahead] | (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        blank |= _MAYBE_BLANK[three] & ((two == 0x80) | (two == 0x81) | (two == 0x9A))
        starts = np.zeros(len(raw) + 1, dtype=bool)
        starts[inner[~blank]] = True
        starts[at[:-1]] = True
        starts = starts[:-1]
        kind = KIND[raw]
        odd = _odd(raw, kind)
        follows = np.append(kind[1:], ODD)
        odd[space[~starts[space] | (follows[space] < LETTER) | (follows[space] > MARK)]] = True
        line = np.flatnonzero(kind == LINE)
        odd[line[follows[line] == LINE]] = True
        change = np.ones(len(raw), dtype=bool)
        change[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != SPACE)
        return raw, starts, change, odd

    def _cut_spaced(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words without the white space between them, in lower case if nothing in them is odd; as _cut_led, and words' texts."""
        start, end, owner = word_spans(raw, at)
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[start] += 1
        inside[end] -= 1
        data = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
        starts = np.zeros(len(data), dtype=bool)
        starts[np.cumsum(end - start) - (end - start)] = True
        kind = KIND[data]
        odd = _odd(data, kind)
        change = np.ones(len(data), dtype=bool)
        change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        return data, starts, change, odd, owner

    def _pieces(self, raw: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Texts laid end to end as pieces: all pieces, which of them are whole odd parts, and where each text's begin (n + 1)."""
        if self.kind == "space_led":
            data, starts, change, odd = self._cut_led(raw, at)
        else:
            data, starts, change, odd, owner = self._cut_spaced(raw, at)
        part = np.flatnonzero(starts)
        is_odd = np.logical_or.reduceat(odd, part) if len(part) else np.zeros(0, dtype=bool)
        if is_odd.any():
            change &= ~np.repeat(is_odd, np.diff(part, append=len(data)))
        cuts = np.flatnonzero(starts | change)
        piece_odd = np.zeros(len(cuts), dtype=bool)
        piece_odd[np.searchsorted(cuts, part[is_odd])] = True
        if self.kind == "space_led":
            first = np.searchsorted(cuts, at)
        else:
            plain = ~np.repeat(is_odd, np.diff(part, append=len(data)))
            after = np.zeros(len(data), dtype=bool)
            after[1:] = (data[:-1] == 0xC3) & (data[1:] <= 0x9E)
            data = np.where(plain & after, data + 32, np.where(plain, LOWER[data], data)).astype(np.uint8)
            first = np.searchsorted(cuts, np.append(part, len(data))[np.searchsorted(owner, np.arange(len(at)))])
        stops = np.append(cuts, len(data)).astype(np.int32)  # a batch of text is far below 2 GiB
        made = pa.Array.from_buffers(pa.string(), len(cuts), [None, pa.py_buffer(stops), pa.py_buffer(np.ascontiguousarray(data))])
        return made, piece_odd, first

    def _lookup(self, pieces: list[str], odd: np.ndarray) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.young) > (self.held or CACHE_PIECES):
            self.young, self.old = self.old, self.young
            self.young.clear()
        young, old = self.young, self.old
        got = [young.get(p) for p in pieces]
        unmet = []
        for k in [k for k, v in enumerate(got) if v is None]:
            p = pieces[k]
            if p in old:
                got[k] = young[p] = old[p]
            else:
                unmet.append(k)
        where = np.array(unmet, dtype=np.int64)
        for some, encode in ((where[~odd[where]], self._bpe), (where[odd[where]], self._direct)):
            names = [pieces[k] for k in some]
            for k, p, v in zip(some.tolist(), names, encode(names), strict=True):
                got[k] = v
                if len(p) <= CACHE_CHARS:
                    young[p] = v
        return got

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) laid end to end, each followed by end_id, and their offsets (n + 1)."""
        n = len(texts)
        if self.kind == "whole":
            blobs = self._direct(texts.fill_null("").to_pylist())
            counts = np.array([len(b) // 4 for b in blobs], dtype=np.int64)
            ids = np.frombuffer(b"".join(blobs), dtype="<u4")
        else:
            raw, at = text_bytes(texts)
            pieces, odd, first = self._pieces(raw, at)
            coded = pieces.dictionary_encode()
            which = coded.indices.to_numpy()
            odd_names = np.zeros(len(coded.dictionary), dtype=bool)
            odd_names[which[odd]] = True
            blobs = self._lookup(coded.dictionary.to_numpy(zero_copy_only=False).tolist(), odd_names)
            size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            place = np.cumsum(size) - size
            length = size[which]
            stops = np.concatenate([[0], np.cumsum(length)])
            flat = np.frombuffer(b"".join(blobs), dtype="<u4")
            ids = flat[np.repeat(place[which] - stops[:-1], length) + np.arange(stops[-1])]
            counts = np.diff(stops[first])
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if end_id is None:
            return ids, offsets
        out = np.full(len(ids) + n, end_id, dtype="<u4")
        out[np.arange(len(ids)) + np.repeat(np.arange(n), counts)] = ids
        return out, offsets + np.arange(n + 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str, held: int | None = None) -> Encoder:
    """One Encoder for each worker process and tokenizer file, with room for `held` pieces; claims the worker for token ids."""
    claim("tokens")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].held = held
    return _encoders[path]


def largest_id(path: str) -> int:
    """The largest id that a tokenizer file can give."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())

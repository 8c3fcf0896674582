"""Token ids of many texts through a tokenizers file, a white-space chunk at a time.

`Encoder` gives what `Tokenizer.from_file(path).encode(text, add_special_tokens=False)` gives.
Where the tokenizer's own splitting rule lets it, a text is cut in front of each run of
ASCII white space; no token spans such a cut, so the ids of a text are the ids of its
chunks one after the other.  Arrow makes the cuts, holds the chunks that are remembered and numbers those of
a stretch after them, so that Python meets each new chunk once and gathers ids by number.

Chunks are remembered up to a bound; then those not met for longest are let go.  A new chunk of plain
letters, digits and signs is parted by the tokenizer's own rule and goes straight to its merges; any
other is encoded in full.  A text with other white space, and any text under a tokenizer whose rule
is not known here, is encoded whole.
"""

from __future__ import annotations

import gc
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

#: Chunks remembered at most, and bytes of them.
REMEMBERED, REMEMBERED_BYTES = 400_000, 32 << 20
#: Bytes of text whose chunks are numbered together.
STRETCH = 1 << 23
#: New chunks that are encoded together.
PART = 1 << 15
_SPACED, _BARE = "chunks begin with their white space", "white space is dropped"
_MARK = "\x01"
#: The mark itself and white space other than ASCII's.
_ODD = "[\x01\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Chunks that _plain_runs can take: letters of Latin-1, digits and signs but "<", which may begin a special token.
_PLAIN = re.compile("[ \n]?[!-;=-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")


class Encoder:
    def __init__(self, path: str, offsets: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.offsets = offsets
        self.vocab_size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.cut = self._rule(spec)
        # a special token parts texts that are encoded in one call: what stands on its two sides never meets
        own = [t for t in spec.get("added_tokens", []) if t.get("special") and not t.get("normalized")]
        self.divider = (own[-1]["content"], own[-1]["id"]) if own else None
        self.plain = self.cut is not None and not offsets and all(t["content"][:1] == "<" for t in spec.get("added_tokens", []))
        if self.plain:
            self._spell(spec)
        self._forget()

    @staticmethod
    def _rule(spec: dict):
        """How the tokenizer lets texts be cut, or None."""
        pre, plain = spec.get("pre_tokenizer") or {}, not any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        if not plain or (spec.get("model") or {}).get("dropout"):
            return None
        if not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return _SPACED
        steps = pre.get("pretokenizers") or []
        known = {"NFC", "Lowercase", "Replace"}
        norms = (spec.get("normalizer") or {}).get("normalizers") or []
        if steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and {n["type"] for n in norms} <= known and r"[^\s\p{L}\p{N}]+" in (steps[0].get("pattern") or {}).get("Regex", ""):
            return _BARE
        return None

    def _spell(self, spec: dict) -> None:
        """Byte-level spellings of plain characters, and the tokenizer's splitting rule on spelled text.

        Letters of Latin-1 are spelled as one lead character and one of 64 others; the byte 1 parts chunks.
        """
        char = {b: c for c, b in byte_of_char().items()}
        self.spelled = {chr(k): "".join(char[b] for b in chr(k).encode()) for k in (10, 32, *range(0xC0, 0x100))}
        self.part, self.lead = char[1], char[0xC3]
        letters = "A-Za-z" + re.escape("".join({c for k in range(0xC0, 0x100) for c in self.spelled[chr(k)]}))
        blanks = re.escape(char[10] + char[32] + self.part)
        blank = f"{char[32]}?" if self.cut is _SPACED else ""
        digits = "[0-9]+" if self.cut is _SPACED else "[0-9]"
        self.pieces = re.compile(f"'(?:s|t|re|ve|m|ll|d)|{blank}[{letters}]+|{blank}{digits}|{blank}[^{letters}0-9{blanks}]+|[{blanks}]").findall
        self.lower = any(n["type"] == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers") or [])

    def _forget(self) -> None:
        self.index = pa.array([], pa.string())
        self.n = 0
        self.used = 0
        self.clock = 0
        self.met = np.zeros(1024, np.int32)
        self.starts = np.zeros(1024, np.int64)
        self.lens = np.zeros(1024, np.int32)
        self.flat = np.zeros(4096, np.uint32)
        self.spans = np.zeros((4096, 2), np.int32) if self.offsets else None

    def _thin(self) -> None:
        """Let the half of the chunks go that were not met for longest."""
        met = self.met[: self.n]
        stay = np.flatnonzero(met > np.partition(met, self.n // 2)[self.n // 2])
        names, lens, met, clock = self.index.take(pa.array(stay)), self.lens[stay], met[stay], self.clock
        ends = np.cumsum(lens, dtype=np.int64)
        total = int(lens.sum())
        pos = np.repeat(self.starts[stay] - (ends - lens), lens) + np.arange(total)
        flat, spans = self.flat[pos], self.spans[pos] if self.offsets else None
        self._forget()
        self._room(len(stay), total)
        self.index, self.clock, self.n, self.used = names, clock, len(stay), total
        self.lens[: self.n], self.starts[: self.n], self.met[: self.n] = lens, ends - lens, met
        self.flat[:total] = flat
        if self.offsets:
            self.spans[:total] = spans

    def _room(self, n: int, total: int) -> None:
        """Grow the arrays for n more chunks and total more ids."""
        while self.n + n > len(self.lens):
            self.starts, self.lens, self.met = (np.resize(x, 2 * len(x)) for x in (self.starts, self.lens, self.met))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            if self.offsets:
                self.spans = np.concatenate([self.spans, np.zeros_like(self.spans)])

    def _runs(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, list | None]:
        """(lengths of the chunks' id runs, the ids, their spans if asked for)."""
        if self.offsets or not self.divider or any(self.divider[0][0] in c for c in chunks):
            encode = self.tokenizer.encode_batch if self.offsets else self.tokenizer.encode_batch_fast
            done = encode(chunks, add_special_tokens=False)
            ids = [e.ids for e in done]
            lens = np.fromiter(map(len, ids), np.int64, len(ids))
            return lens, np.fromiter((i for x in ids for i in x), np.uint32, int(lens.sum())), [s for e in done for s in e.offsets] if self.offsets else None
        mark, number = self.divider
        done = self.tokenizer.encode_batch_fast([mark.join(chunks[k : k + 64]) + mark for k in range(0, len(chunks), 64)], add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in done])
        ends = np.flatnonzero(ids == number)
        return np.diff(ends, prepend=-1) - 1, ids[ids != number], None

    def _plain_runs(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, None]:
        """The same for plain chunks: all are spelled and split at once, each piece goes through the model's merges."""
        text = "\0".join(chunks)
        if self.lower:
            text = text.lower()
        for c in sorted(set(text) & self.spelled.keys(), key=self.lead.__ne__):  # the lead character itself first
            text = text.replace(c, self.spelled[c])
        pieces = self.pieces(text.replace("\0", self.part))
        ends = np.array([k for k, p in enumerate(pieces) if p == self.part], np.int64)
        runs = dict.fromkeys(pieces, [])
        runs.pop(self.part, None)
        collects = gc.isenabled()
        gc.disable()  # so many lists, none of them in a cycle, make it look through all objects again and again
        try:
            for p in runs:  # words come with many signs behind them, so pieces recur more than chunks
                runs[p] = [t.id for t in self.tokenizer.model.tokenize(p)]
        finally:
            if collects:
                gc.enable()
        runs[self.part] = []
        found = list(map(runs.__getitem__, pieces))
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(total[-1]))
        return np.diff(total[np.append(ends, len(found))], prepend=0), ids, None

    def _learn(self, chunks: list[str]) -> None:
        """Encode chunks that get the next numbers."""
        kinds = np.zeros(len(chunks), np.int8)
        if self.plain:
            kinds[[_PLAIN.fullmatch(c) is not None for c in chunks]] = 2
        if self.divider:  # chunks that may hold a divider are encoded one by one
            kinds[[self.divider[0][0] in c for c in chunks]] = 1
        runs: list = []
        for kind in (0, 1, 2):
            which = np.flatnonzero(kinds == kind)
            for lo in range(0, len(which), PART):
                part = which[lo : lo + PART]
                runs.append((part, *(self._plain_runs if kind == 2 else self._runs)([chunks[k] for k in part.tolist()])))
        for part, lens, ids, spans in runs:
            self._room(len(chunks), len(ids))
            self.lens[self.n + part] = lens
            self.starts[self.n + part] = self.used + np.cumsum(lens) - lens
            self.flat[self.used : self.used + len(ids)] = ids
            if self.offsets and len(ids):
                self.spans[self.used : self.used + len(ids)] = spans
            self.used += len(ids)
        self.n += len(chunks)

    def _numbers(self, chunks: pa.Array) -> np.ndarray:
        """The numbers of the chunks, after those that are new have been encoded."""
        if not len(chunks):
            return np.zeros(0, np.int64)
        if self.n > REMEMBERED or self.index.nbytes > REMEMBERED_BYTES:
            self._thin()
        # the chunks remembered stand in front, so that they keep their numbers and new ones get the next
        coded = pa.chunked_array([self.index.cast(chunks.type), chunks]).dictionary_encode()
        coded = coded.chunk(coded.num_chunks - 1)
        self.index = coded.dictionary
        at = coded.indices.to_numpy()
        del coded
        pa.default_memory_pool().release_unused()  # what numbering took, of which numpy and Python could use nothing
        if len(self.index) > self.n:
            self._learn(self.index.slice(self.n).to_numpy(zero_copy_only=False).tolist())
        self.clock += 1
        self.met[at] = self.clock
        return at

    def _chunks(self, texts: pa.Array) -> pa.ListArray:
        if self.cut is _BARE:
            return pc.ascii_split_whitespace(texts)
        marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{_MARK} "), "\n", f"{_MARK}\n")
        runs = pc.or_(pc.match_substring_regex(marked, f"{_MARK}[ \n]{_MARK}"), pc.match_substring_regex(texts, "[\t\x0b-\r]"))
        if pc.any(runs).as_py():  # longer runs and other white space
            marked = pc.replace_with_mask(marked, runs, pc.replace_substring_regex(texts.filter(runs), "([\t-\r ]+)", f"{_MARK}\\1"))
        return pc.split_pattern(marked, _MARK)

    def _whole(self, texts: pa.Array) -> np.ndarray:
        """Which texts must be encoded in one piece."""
        if self.cut is None or (self.offsets and self.cut is _BARE):
            return np.ones(len(texts), bool)
        if self.cut is _BARE:
            return np.zeros(len(texts), bool)
        return pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids of all texts, ends of each text among them, character spans if asked for)."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        whole = self._whole(texts)
        counts = np.zeros(len(texts), np.int64)
        parted = texts.filter(pa.array(~whole)) if whole.any() else texts
        done = [np.zeros(0, np.int64)]
        ids, spans = [np.zeros(0, np.uint32)], [np.zeros((0, 2), np.int64)]
        for lo, hi in _stretches(pc.binary_length(parted).to_numpy(zero_copy_only=False)):
            lists = self._chunks(parted.slice(lo, hi - lo))
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            chunks = lists.flatten()
            at = self._numbers(chunks)
            lens = self.lens[at]
            total = int(lens.sum())
            run_ends = np.cumsum(lens)
            pos = np.repeat(self.starts[at] - (run_ends - lens), lens)
            pos += np.arange(total)
            ids.append(self.flat[pos])
            text_ends = np.cumsum(sizes)
            done.append(np.diff(np.concatenate([[0], run_ends])[text_ends], prepend=0))
            if self.offsets:
                widths = pc.utf8_length(chunks).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(widths)])
                spans.append(self.spans[pos] + np.repeat(ends[:-1] - np.repeat(ends[text_ends - sizes], sizes), lens)[:, None])
        counts[~whole] = np.concatenate(done)
        ids_, spans_ = np.concatenate(ids), np.concatenate(spans)
        if whole.any():
            single = [self.tokenizer.encode(t, add_special_tokens=False) for t in texts.filter(pa.array(whole)).to_pylist()]
            counts[whole] = [len(e.ids) for e in single]
            own = np.repeat(whole, counts)
            merged, merged_spans = np.empty(len(own), np.uint32), np.empty((len(own), 2), np.int64)
            merged[~own], merged[own] = ids_, np.fromiter((i for e in single for i in e.ids), np.uint32, int(own.sum()))
            if self.offsets:
                merged_spans[~own], merged_spans[own] = spans_, np.array([s for e in single for s in e.offsets], np.int64).reshape(-1, 2)
            ids_, spans_ = merged, merged_spans
        return ids_, np.cumsum(counts), spans_ if self.offsets else None


def _stretches(sizes: np.ndarray):
    """(lo, hi) of texts of about STRETCH bytes together."""
    ends, lo = np.cumsum(sizes.astype(np.int64)), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRETCH, side="right")))
        yield lo, hi
        lo = hi


_ENCODERS = kept()


def encoder(path: str, offsets: bool = False) -> Encoder:
    """One Encoder a process; Python workers live on between tasks, and keep it until a task that uses none."""
    key = (path, offsets)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, offsets)
    return _ENCODERS[key]


def byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 up."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in own}
    rest = (b for b in range(256) if b not in set(own))
    table |= {chr(256 + k): b for k, b in enumerate(rest)}
    return table


class Decoder:
    """Texts of token ids of a byte-level tokenizer, special tokens included."""

    def __init__(self, tokenizer):
        table = byte_of_char()
        vocab = tokenizer.get_vocab(with_added_tokens=True)
        spelled = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            spelled[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.lens = np.fromiter(map(len, spelled), np.int64, len(spelled))
        self.starts = np.cumsum(self.lens) - self.lens
        self.flat = np.frombuffer(b"".join(spelled), np.uint8)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        lens = self.lens[ids]
        cum = np.concatenate([[0], np.cumsum(lens)])
        out = []
        lo = 0
        while lo < len(ends):  # about a megabyte at a time
            first = int(ends[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(cum[ends], cum[first] + (1 << 20), side="right")))
            last = int(ends[hi - 1])
            part = lens[first:last]
            total = int(cum[last] - cum[first])
            pos = np.repeat(self.starts[ids[first:last]] - (cum[first:last] - cum[first]), part) + np.arange(total)
            data = self.flat[pos].tobytes()
            at = 0
            for e in ends[lo:hi]:
                end = int(cum[e] - cum[first])
                out.append(data[at:end].decode("utf-8", "replace"))
                at = end
            lo = hi
        return out

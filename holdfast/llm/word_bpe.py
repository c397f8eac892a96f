"""Byte-pair encoding of many words at once, for tokenizers whose words are closed by an end mark.

The tokenizers library stays the authority: it encodes every word that is not one run of letters, and a share of the
others each time; if it disagrees with any, a worker leaves the rest of its words to the library too.  The runs of letters,
nearly all new words of a corpus, are merged in arrays: in each round every word takes its leftmost pair of lowest rank, as
the library does one word at a time.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import types
import unicodedata
import warnings

import numpy as np

NONE = np.int64(1) << 40
CHECK_EVERY = 128
#: Words remembered, at about 200 bytes each, and the bytes that they may have together.
CACHE, CACHE_BYTES = 1_000_000, 64 << 20
#: Longer runs of letters go to the library, so that no matrix is wide for one word's sake.
LONGEST = 48


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    own = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = itertools.count(256)
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class BatchBpe:
    """Merges of one vocabulary; usable says whether its file has the form that this class knows."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = [x for x in (spec.get("pre_tokenizer") or {}).get("pretokenizers", []) if x["type"] == "Split"]
        self.usable = (
            model["type"] == "BPE" and not model.get("dropout") and model.get("end_of_word_suffix") == "</w>" and not model.get("continuing_subword_prefix")
            and not model.get("ignore_merges") and steps == ["NFC", "Replace", "Lowercase"] and len(split) == 1
            and "[\\p{L}]+" in split[0]["pattern"].get("Regex", "").split("|")
        )
        if not self.usable:
            return
        vocab = model["vocab"]
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + "</w>"] for c in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (b >= 0), self.ranks[at], NONE)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each word (bytes of its letters)."""
        out: list[bytes] = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        order = np.argsort(lengths, kind="stable")
        for at in range(0, len(order), 1 << 14):  # words of like length share a matrix
            part = order[at : at + (1 << 14)]
            for i, ids in zip(part.tolist(), self._same([words[i] for i in part.tolist()], lengths[part])):
                out[i] = ids
        return out

    def _same(self, words: list[bytes], n: np.ndarray) -> list[bytes]:
        width, rows = int(n.max()), np.arange(len(words))
        inside = np.arange(width) < n[:, None]
        token = np.full((len(words), width + 1), -1, np.int64)
        flat = np.frombuffer(b"".join(words), np.uint8)
        token[:, :-1][inside] = self.inner[flat]
        last = np.cumsum(n) - 1
        token[rows, n - 1] = self.final[flat[last]]
        rank = self._rank(token[:, :-1], token[:, 1:])
        live = rows
        steps = np.arange(width)
        done_token = token
        while len(live):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(live)), best]
            on = low < NONE
            if not on.all():
                done_token[live[~on]] = token[~on]
                live, token, rank, best, low = live[on], token[on], rank[on], best[on], low[on]
                if not len(live):
                    break
            k = np.arange(len(live))
            # Close the gap behind the merged pair.
            after = steps[None, :] > best[:, None]
            token[:, :-1] = np.where(after, token[:, 1:], token[:, :-1])
            token[k, best] = self.merged[low]
            rank[:, :-1] = np.where(after[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            rank[k, best] = self._rank(token[k, best], token[k, best + 1])
            before = np.maximum(best - 1, 0)
            rank[k, before] = np.where(best > 0, self._rank(token[k, before], token[k, best]), rank[k, before])
        kept = done_token >= 0
        data = done_token[kept].astype("<u4").tobytes()
        ends = np.cumsum(kept.sum(axis=1)) * 4
        return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def letters(word: bytes) -> bytes:
    """The word as the tokenizer's normalizer leaves it, if that is one run of letters, else nothing."""
    if word.isalpha():  # of ASCII letters
        return word.lower()
    text = "" if word.isascii() else word.decode("utf-8", "replace")
    if not text or "\u03a3" in text:  # Python lowers a final sigma by its place, the library letter by letter
        return b""
    text = unicodedata.normalize("NFC", text).lower()
    return text.encode() if text.isalpha() else b""


class WordTokenizer:
    """A tokenizer of which white space always ends a token, applied word by word and remembered.

    White space here is space and \\t \\n \\v \\f \\r: the tokenizer's own patterns never join what stands on both
    sides of it, so the ids of a text are its words' ids in order.  It ignores the case of ASCII letters, except in its
    special strings, and cuts ASCII marks off behind what it leaves as a run of letters; so does this class, for fewer words to merge.
    """

    def __init__(self, path: str, remember: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.batch, self.known = Tokenizer.from_file(path), BatchBpe(path), {}
        self.remember, self.size, self.merging = remember, 0, self.batch.usable

    @classmethod
    def shared(cls, path: str, remember: int = CACHE) -> WordTokenizer:
        """One a worker process and path: what it has learnt serves the next task."""
        kept = sys.modules.setdefault("_holdfast_worker_state", types.ModuleType("_holdfast_worker_state"))
        if path not in kept.__dict__:
            kept.__dict__[path] = cls(path)
        kept.__dict__[path].remember = remember
        return kept.__dict__[path]

    def forget(self) -> None:
        self.known.clear()
        self.size = 0

    def _by_library(self, parts: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in got]

    def _learn(self, new) -> None:
        runs, names, rest, ended, known = [], [], [], {}, self.known
        for p in new:
            run = letters(p) if self.merging else b""
            if run and len(run) <= LONGEST:
                runs.append(run)
                names.append(p)
                continue
            stem = p.rstrip(MARKS)
            if self.merging and 0 < len(stem) < len(p) and b"<|" not in p and letters(stem):
                ended[p] = stem, p[len(stem) :]
            else:
                rest.append(p)
        if runs:
            known.update(zip(names, self.batch.encode(runs)))
        if rest:
            known.update(zip(rest, self._by_library(rest)))
        if ended:
            if parts := {x for both in ended.values() for x in both}.difference(known):
                self._learn(parts)
            if not self.merging:  # a part has shown that the library decides
                return self._learn(new)
            for p, (stem, marks) in ended.items():
                known[p] = known[stem] + known[marks]
        sample = [*names[::CHECK_EVERY], *list(ended)[::CHECK_EVERY]]
        if sample and [known[p] for p in sample] != self._by_library(sample):
            warnings.warn("the tokenizers library encodes a word in another way: from here on it encodes all", stacklevel=2)
            self.merging = False
            self.forget()
            self._learn(new)

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        words = []
        for t in texts:
            data = (t or "").encode("utf-8", "surrogatepass")
            words.append(data.split() if b"<|" in data else data.lower().split())
        known = self.known
        if len(known) > self.remember or self.size > CACHE_BYTES:
            self.forget()
        new = set().union(*words).difference(known)
        self.size += sum(map(len, new))
        self._learn(new)
        if not self.merging:  # what was remembered may have been forgotten in between
            self._learn(set().union(*words).difference(known))
        return [np.frombuffer(b"".join(map(known.__getitem__, x)), "<u4") for x in words]

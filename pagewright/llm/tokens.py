"""Whole texts to token ids with the tokenizers library, each distinct word being encoded once in a while."""

from __future__ import annotations

import gc
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Distinct words that an encoder remembers.
KEPT = 600_000


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """The place of a public vocabulary file; the driver and every executor have them installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts exactly as the library does, without special tokens.

    For vocabularies that drop white space, a text's ids are those of its white-space-separated chunks in turn, since no
    step of the library looks across white space. A chunk that is letters and then marks is cut once more, and its
    letters are lowered, as the vocabulary's own splitting and lowering do. Distinct parts are encoded by the library and
    kept in a bounded memory.
    """

    #: Letters that composition leaves alone and that lower one to one; marks after which nothing joins.
    _NOT_LOWERED = r"<\||\p{M}"  # a special token's string may lie in it, or letters that compose
    _PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kept = kept
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, parts: list[str]) -> None:
        """Encodes parts; words of letters go 64 at a time and are told apart by their last ids."""
        words = [p for p in parts if p.isalpha()]
        for at in range(0, len(words), 8192):
            groups = [words[k : k + 64] for k in range(at, min(at + 8192, len(words)), 64)]
            for group, encoded in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
                ids = np.array(encoded.ids, dtype="<u4")
                cuts = np.flatnonzero(self.ends_word[ids]) + 1 if len(ids) else []
                if len(cuts) == len(group) and cuts[-1] == len(ids):
                    raw, begin = ids.tobytes(), 0
                    for word, end in zip(group, (4 * cuts).tolist(), strict=True):
                        self.known[word] = raw[begin:end]
                        begin = end
        rest = [p for p in parts if p not in self.known]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for part, encoded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[part] = np.array(encoded.ids, dtype="<u4").tobytes()

    def _parts(self, chunk: str) -> tuple[str, ...]:
        if m := self._PLAIN.fullmatch(chunk):
            word, marks = m.groups()
            return (word.lower(), marks) if marks else (word.lower(),)
        return (chunk,)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array of uint32, and where each text begins in it (one more entry than texts)."""
        collects = gc.isenabled()
        gc.disable()  # the many words of a slice are free of cycles
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not pc.any(pc.match_substring_regex(texts, self._NOT_LOWERED)).as_py():
            texts = pc.ascii_lower(texts)  # fewer distinct chunks; the vocabulary lowers anyway
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten().dictionary_encode()
        chunks = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self.known
        if len(known) > self.kept:
            known.clear()
        known[""] = b""
        table = [known.get(c) for c in chunks]
        new = [k for k, found in enumerate(table) if found is None]
        parts = [self._parts(chunks[k]) for k in new]
        if missing := {p for some in parts for p in some if p not in known}:
            self._learn(sorted(missing))
        for k, some in zip(new, parts, strict=True):
            table[k] = known[some[0]] if len(some) == 1 else known[some[0]] + known[some[1]]
        sizes = np.fromiter(map(len, table), np.int64, len(table)) >> 2
        pool = np.frombuffer(b"".join(table), dtype="<u4")
        starts = np.concatenate(([0], np.cumsum(sizes)))
        codes = flat.indices.to_numpy(zero_copy_only=False)
        counts = sizes[codes] if len(codes) else np.empty(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = pool[np.repeat(starts[codes] - ends[:-1], counts) + np.arange(ends[-1])] if len(codes) else np.empty(0, np.uint32)
        offsets = np.asarray(lists.offsets, dtype=np.int64) - lists.offsets[0].as_py()
        return ids, ends[offsets]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, kept: int = KEPT) -> Encoder:
    """The encoder of this process for a vocabulary file; Python workers are used again, and so is what it has learned."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].kept = kept
    return _ENCODERS[path]

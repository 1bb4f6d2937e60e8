"""Byte-level BPE encoding and decoding by tree concatenation.

A text is halved until its parts are leaves of LEAF characters or fewer, wherever that cuts it; the leaves are encoded in parallel, and joined level by level. Around
each join a window grows to both sides until its ends are places where both sides surely have a token's edge, and is encoded again: what the sides have outside of it stands.
Such a place is one that no piece of the pre-tokenizer's pattern can span (CLASSES of the characters beside it), so the result is exact. In a long run without such a
place (a million letters), the window grows by tokens of the run instead, until its outer tokens are those of both sides: as a sequence of tokens is BPE's own when every
two neighbours are, that is exact too.

Special tokens found in a text become their ids, as the tokenizers library does unless told otherwise.
"""

from __future__ import annotations

import functools
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .util import in_batches, row_slices, text_buffers

#: The pattern of byte-level pre-tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.json"
#: Characters of a leaf; characters of a run from which its joins go by tokens.
LEAF, RUN = 1024, 4096
#: Characters whose class in the pattern no version of Unicode changes: letters, digits, other marks, white space. Others are no edge.
CLASSES = {"L": r"A-Za-zÀ-ÖØ-öø-ÿа-яА-Яα-ωぁ-ゖァ-ヺ一-龥가-힣", "D": "0-9", "S": r"!-/:-@\[-`{-~。、「」", "W": r"\x20\n\t\r"}
#: Two characters that no piece of the pattern holds next to each other: a change of class, but for what may follow a white space, and letters after an apostrophe.
_EDGE = "(?:[{L}][{D}{S}{W}]|[{D}][{L}{S}{W}]|[{S}][{D}{W}]|[{T}][{L}])".format(**CLASSES, T=CLASSES["S"].replace("!-/", "!-&(-/"))
_NEXT, _BEFORE = regex.compile(_EDGE), regex.compile("(?r)" + _EDGE)
_RUN = regex.compile(" ?[{L}]+| ?[{D}]+| ?[{T}]+".format(**CLASSES, T=CLASSES["S"].replace("!-/", "!-&(-/")))


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable Latin-1, else one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TreeBPE:
    """Encoder and decoder of a byte-level BPE vocabulary in the JSON form of the tokenizers library, whose ids are in the order of its merges."""

    def __init__(self, path: str, leaf: int = LEAF, run: int = RUN, threads: int = 2):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        vocab, merges, at = d["model"]["vocab"], d["model"]["merges"], byte_characters()
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if d["normalizer"] or d["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or [vocab[m] for m in made] != list(range(256, 256 + len(made))):
            raise ValueError(f"{path} is no byte-level BPE vocabulary with ids in the order of its merges")
        ranks = {bytes(at[c] for c in token): i for token, i in vocab.items() if token not in {t["content"] for t in d["added_tokens"]}}
        self.specials = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.bpe = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in self.specials.items()}
        self.sizes = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.sizes[list(self.bytes_of)] = [len(b) for b in self.bytes_of.values()]
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.leaf, self.run, self.threads, self.pool = leaf, run, threads, ThreadPoolExecutor(threads)
        #: How many joins were made, and how many of these went by tokens of a run.
        self.joins = self.run_joins = 0

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Leaves of all texts are encoded together, by all threads."""
        plans = [[self._special(s) if i % 2 else (s, self._cuts(len(s))) for i, s in enumerate(self.special.split(t) if self.special else [t])] for t in texts]
        leaves = [s[a:b] for plan in plans for part in plan if not isinstance(part, np.ndarray) for s, cuts in (part,) for a, b in zip(cuts, cuts[1:], strict=False)]
        step = max(1, -(-len(leaves) // self.threads))
        done = [x for xs in self.pool.map(lambda part: [self._plain(x) for x in part], [leaves[i : i + step] for i in range(0, len(leaves), step)]) for x in xs]
        coded = iter(done)
        out = []
        for plan in plans:
            parts = [part if isinstance(part, np.ndarray) else self._joined(part[0], part[1], [next(coded) for _ in part[1][1:]]) for part in plan]
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.uint32))
        return out

    def _special(self, s: str) -> np.ndarray:
        return np.array([self.specials[s]], np.uint32)

    def _plain(self, s: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(s, disallowed_special=())

    def _cuts(self, n: int) -> list[int]:
        """0, the ends of 2 ** k equal parts, which are leaves; only 0 for nothing."""
        parts = 1
        while n > parts * self.leaf:
            parts *= 2
        return [n * i // parts for i in range(parts + 1)] if n else [0]

    def _joined(self, s: str, cuts: list[int], level: list[np.ndarray]) -> np.ndarray:
        while len(level) > 1:
            level = [self.join(s, *cuts[i : i + 3], *level[i : i + 2]) for i in range(0, len(level), 2)]
            cuts = cuts[::2]
        return level[0] if level else np.zeros(0, np.uint32)

    def join(self, s: str, start: int, at: int, end: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of s[start:end] from those of s[start:at] and s[at:end]."""
        self.joins += 1
        m = _NEXT.search(s, at - 1, end)
        b = m.start() + 1 if m else end
        if b == at:
            return np.concatenate([left, right])
        m = _BEFORE.search(s, start, at + 1)
        a = m.end() - 1 if m else start
        i = len(left) - self._tokens_of(left[::-1], s[a:at])
        j = self._tokens_of(right, s[at:b])
        if b - a > self.run and _RUN.fullmatch(s, a, b):
            self.run_joins += 1
            mid = np.array(self._run(left[i:].tolist(), right[:j].tolist()), np.uint32)
        else:
            mid = self._plain(s[a:b])
        return np.concatenate([left[:i], mid, right[j:]])

    def _tokens_of(self, ids: np.ndarray, s: str) -> int:
        """How many of the first ids have the bytes of s."""
        size = len(s.encode())
        upto = np.cumsum(self.sizes[ids[:size]])
        n = int(np.searchsorted(upto, size)) + 1 if size else 0
        if n and (n > len(upto) or upto[n - 1] != size):
            raise AssertionError("no token ends at an edge")
        return n

    def _run(self, left: list[int], right: list[int]) -> list[int]:
        """BPE of a run from that of its two parts."""
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            mid = self.bpe._encode_single_piece(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == 0 or mid[0] == left[i]) and (j == len(right) or mid[-1] == right[j - 1]):
                return left[:i] + mid + right[j:]
            k *= 2

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def _bpe(path: str | None) -> TreeBPE:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    return TreeBPE(path)


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """decode(encode(docs)), both by one worker, which holds the vocabulary once."""
    return _encoded(docs, path, True)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Adds to doc_id and text: ids, the token ids as little-endian unsigned 32-bit integers (binary), and n_tokens.

    A null text is empty: no tokens. Repeated rows come back as often, and a text of any length is encoded whole, by a tree of its halves. Other columns are left out.
    `path`: the vocabulary file, readable on every executor.
    """
    return _encoded(docs, path, False)


def _encoded(docs: DataFrame, path: str | None, back: bool) -> DataFrame:
    def run(batches):
        bpe = _bpe(path)
        for b in batches:
            offs, raw = text_buffers(b.column("text"))
            for i, j in row_slices(offs):
                ids = bpe.encode_all([raw[offs[k] : offs[k + 1]].tobytes().decode() for k in range(i, j)])
                own = [b.column("doc_id").slice(i, j - i), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())]
                again = [pa.array([bpe.decode(x) for x in ids], pa.string())] if back else []
                yield pa.RecordBatch.from_arrays(own + again, names=["doc_id", "ids", "n_tokens", "decoded"][: 3 + back])

    return in_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, ids binary, n_tokens long" + ", decoded string" * back)


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, n_tokens -> the same and decoded (text). A null ids is empty. Ids outside of the vocabulary are an error."""

    def run(batches):
        bpe = _bpe(path)
        for b in batches:
            done = 0
            while done < len(b):  # few rows at a time: texts are larger than their ids
                part = b.slice(done, 256)
                out = [bpe.decode(np.frombuffer(x or b"", "<u4")) for x in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])
                done += 256

    return in_batches(tokens.select("doc_id", "ids", "n_tokens"), run, "doc_id long, ids binary, n_tokens long, decoded string")

"""BPE encoding and decoding by tree concatenation.

A text is cut into pretokens by the tokenizer file's own rules; each pretoken is
encoded on its own. A long pretoken (text that nothing splits) is encoded as two
halves, each in the same way, independent of each other down to leaves of ``LEAF``
symbols; then a window around the join, first one token to each side, is encoded
again and grown until its first token is the left half's token at that place and
its last token the right half's. A token sequence is the BPE encoding of its text
exactly if every two neighbours are, so agreement on both sides makes the joined
sequence exact; a window that never agrees grows into the whole text.

Supported files: BPE models with Sequence(NFC, Replace white space, Lowercase) as
normalizer and Sequence(Split by pattern, ByteLevel) as pretokenizer; others raise.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

LEAF = 64
#: bytes of pretokens kept with their encoding, for each Python worker
CACHE = 48 << 20
#: bytes of Python objects around each kept pretoken
ENTRY = 300
ROWS = 512


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    keep = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Merger:
    """BPE merges over lists of symbols; (tokens, symbols in each token)."""

    def __init__(self, ranks: dict[tuple[str, str], int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf

    def merge(self, symbols: list[str]) -> tuple[list[str], list[int]]:
        """Merge the lowest-ranked pair, leftmost on ties, until none is left."""
        n = len(symbols)
        tok, size = list(symbols), [1] * n
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.ranks.get
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := rank((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not size[i] or j >= n or tok[i] != a or tok[j] != b:
                continue
            tok[i], size[i], size[j] = a + b, size[i] + size[j], 0
            k = nxt[i] = nxt[j]
            if k < n:
                prv[k] = i
                if (r := rank((tok[i], tok[k]))) is not None:
                    heapq.heappush(heap, (r, i, tok[i], tok[k]))
            if (p := prv[i]) >= 0 and (r := rank((tok[p], tok[i]))) is not None:
                heapq.heappush(heap, (r, p, tok[p], tok[i]))
        live = [i for i in range(n) if size[i]]
        return [tok[i] for i in live], [size[i] for i in live]

    def merge_word(self, symbols: list[str]) -> list[str]:
        """The same for a few symbols: a rescan is cheaper than a heap; tokens only."""
        tok, rank, none = list(symbols), self.ranks.get, len(self.ranks)
        ranks = [rank(p, none) for p in zip(tok, tok[1:])]  # noqa: B905
        while ranks and (low := min(ranks)) < none:
            i = ranks.index(low)
            tok[i:i + 2] = [tok[i] + tok[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank((tok[i], tok[i + 1]), none)
            if i:
                ranks[i - 1] = rank((tok[i - 1], tok[i]), none)
        return tok

    def join(self, symbols: list[str], left: tuple, right: tuple) -> tuple[list[str], list[int]]:
        """Encoding of ``symbols`` from the encodings of its two parts."""
        (lt, ls), (rt, rs) = left, right
        mid, grow = sum(ls), 1
        while True:
            i, j = min(grow, len(lt)), min(grow, len(rt))
            lo, hi = mid - sum(ls[len(ls) - i:]), mid + sum(rs[:j])
            wt, wsz = self.merge(symbols[lo:hi])
            agrees_left = i == len(lt) or (wt[0] == lt[-i] and wsz[0] == ls[-i])
            agrees_right = j == len(rt) or (wt[-1] == rt[j - 1] and wsz[-1] == rs[j - 1])
            if agrees_left and agrees_right:
                return lt[:len(lt) - i] + wt + rt[j:], ls[:len(ls) - i] + wsz + rs[j:]
            grow *= 2

    def encode(self, symbols: list[str]) -> tuple[list[str], list[int]]:
        """Leaves first, then neighbours level by level up the tree."""
        if len(symbols) <= self.leaf:
            return self.merge(symbols)
        cuts = list(range(0, len(symbols), self.leaf)) + [len(symbols)]
        parts = [(a, b, self.merge(symbols[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        while len(parts) > 1:
            up = [(x[0], y[1], self.join(symbols[x[0]:y[1]], x[2], y[2]))
                  for x, y in zip(parts[::2], parts[1::2], strict=False)]
            parts = up + parts[len(up) * 2:]
        return parts[0][2]


class WordBpe(dict):
    """pretoken -> (little-endian ids, tokens joined by a space), filled on demand."""

    def __init__(self, path: str, leaf: int = LEAF, cache: int = CACHE):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, norm, pre = spec["model"], spec["normalizer"], spec["pre_tokenizer"]
        kinds = [x["type"] for x in norm["normalizers"]] + [x["type"] for x in pre["pretokenizers"]]
        if kinds != ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] or model["type"] != "BPE":
            raise ValueError(f"unsupported tokenizer file: {kinds}")
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.merger = Merger({(a, b): i for i, (a, b) in enumerate(pairs)}, leaf)
        self.vocab, self.suffix, self.limit, self.held = model["vocab"], model["end_of_word_suffix"] or "", cache, 0
        self.packed = {t: i.to_bytes(4, "little") for t, i in self.vocab.items()}
        self.symbols = byte_symbols()
        pattern = pre["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.find = regex.compile(pattern).findall
        self.rare = regex.compile("[^\u0000-\u024F]").search
        self.lib_norm = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.lib_cut = pre_tokenizers.Split(Regex(pre["pretokenizers"][0]["pattern"]["Regex"]), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        self.hint = [t[:2] for t in self.special]

    def __missing__(self, word: str) -> tuple[bytes, str]:
        sym = [self.symbols[b] for b in word.encode("utf-8")]
        sym[-1] += self.suffix
        tokens = self.merger.merge_word(sym) if len(sym) <= self.merger.leaf else self.merger.encode(sym)[0]
        tokens = [t for t in tokens if t in self.vocab]  # without an unknown token, others vanish
        out = b"".join([self.packed[t] for t in tokens]), " ".join(tokens)
        if len(sym) <= self.merger.leaf:  # longer ones hardly come back
            size = ENTRY + len(word) + len(out[0]) + len(out[1])
            if self.held + size > self.limit:
                self.clear()
                self.held = 0
            self.held += size
            self[word] = out
        return out

    def pretokens(self, text: str) -> list[str]:
        if self.rare(text):  # Unicode tables differ between versions: the library's own rules
            return [w for w, _ in self.lib_cut.pre_tokenize_str(self.lib_norm.normalize_str(text))]
        text = unicodedata.normalize("NFC", text)
        return self.find(text.lower())

    def encode(self, text: str) -> tuple[bytes, str]:
        """(little-endian ids, decoded text)."""
        if any(h in text for h in self.hint):
            found = []
            for i, part in enumerate(self.cut(text)):
                if i % 2:
                    found.append((np.array([self.special[part]], "<i4").tobytes(), part))
                else:
                    found += [self[w] for w in self.pretokens(part)]
        else:
            found = [self[w] for w in self.pretokens(text)]
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    """The tokenizer of a file, one for each Python worker: Spark reuses workers, and its cache stays warm."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids (array<int>), decoded (the decoded ids).

    A null text counts as empty: no ids and an empty decoded text. Repeated rows are encoded
    alike; an empty table gives an empty result; other columns are not carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                out = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                off = np.concatenate(([0], np.cumsum([len(o[0]) // 4 for o in out]))).astype(np.int32)
                ids = np.frombuffer(b"".join([o[0] for o in out]), "<i4")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(ids, pa.int32())),
                     pa.array([o[1] for o in out], pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id bigint, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the rows of ``encode_decode``."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))

"""Token counts with real piece scores against the tokenizer library itself."""

import hashlib
import itertools
import struct

import pandas as pd
import pytest
import sentencepiece

from rareflag.llm.unigram_count import MARK, Counter, FloatCounter, counter, token_counts, vocabulary
from tests.conftest import SF0001


def field(number, kind, value):
    tag = bytes([*varint(number << 3 | kind)])
    return tag + (bytes(varint(len(value))) + value if kind == 2 else bytes(varint(value)) if kind == 0 else value)


def varint(n):
    while n > 127:
        yield n & 127 | 128
        n >>= 7
    yield n


def model(scores, byte_fallback):
    """A unigram model file with given scores: nothing is trained."""
    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    rows += [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte_fallback else []
    rows += [(p, v, 1) for p, v in scores.items()]
    out = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", v)) + field(3, 0, t)) for p, v, t in rows)
    out += field(2, 2, field(3, 0, 1) + field(35, 0, int(byte_fallback)))
    return out + field(3, 2, field(1, 2, b"identity") + field(3, 0, 1) + field(4, 0, 0) + field(5, 0, 1))


def unit(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:8], 16) / 2 ** 32


def texts():
    return pd.read_parquet(f"{SF0001}/documents.parquet")["text"].dropna().tolist()


def scores(kind):
    """Pieces of the words of some texts; ``ties``: scores that many paths share."""
    words = {MARK + w for t in texts()[:60] for w in t.split()}
    pieces = {w[i:j] for w in sorted(words) for i, j in itertools.combinations(range(len(w) + 1), 2) if j - i <= 6}
    pieces = sorted(p for p in pieces if len(p) > 1 and unit(p) < 0.5) + ["a b".replace(" ", MARK), "a\nb"]
    pieces += [c for c in sorted({c for t in texts()[:60] for c in t} | {MARK}) if c != " " and unit(c + "c") < 0.8]
    if kind == "ties":
        return {p: -0.3 * len(p) if unit(p) < 0.7 else -1.1 for p in dict.fromkeys(pieces)}
    return {p: -1 - 12 * unit(p + "s") for p in dict.fromkeys(pieces)}


ODD = ["", " ", "  a  b ", "\n\n", "a\nb", "日本語 xyz 日本", "😀😀 a", "a" * 5000, "q" * 300 + "語" * 300, "\t\r", "▁▁a"]


@pytest.mark.parametrize("kind", ["real", "ties"])
@pytest.mark.parametrize("byte_fallback", [True, False])
def test_counts_equal_the_library(tmp_path, kind, byte_fallback):
    path = tmp_path / "m.model"
    path.write_bytes(model(scores(kind), byte_fallback))
    sp = sentencepiece.SentencePieceProcessor(model_file=str(path))
    count = counter(str(path))
    assert isinstance(count, FloatCounter)
    for t in texts() + ODD:
        assert count.text(t)[1] == len(sp.encode(t)), t[:80]


def test_whole_numbers_take_the_cached_counter(spark, tmp_path):
    whole = {p: float(-(1 + int(9 * unit(p)))) for p in scores("real")}
    path = tmp_path / "w.model"
    path.write_bytes(model(whole, True))
    cached, plain = counter(str(path)), FloatCounter(vocabulary(str(path)))
    assert isinstance(cached, Counter)
    short = [t for t in texts() + ODD if len(t) < 20000]
    assert [cached.text(t)[1] for t in short] == [plain.text(t)[1] for t in short]
    assert max(map(len, cached)) <= 64
    docs = spark.createDataFrame([(1, "a b"), (2, None), (3, ""), (3, "")], "doc_id long, text string")
    real = tmp_path / "r.model"
    real.write_bytes(model(scores("real"), False))
    want = FloatCounter(vocabulary(str(real)), False).text("a b")
    got = sorted(tuple(r) for r in token_counts(docs, str(real)).collect())
    assert got == [(1, want[1], pytest.approx(want[0])), (2, 0, 0.0), (3, 0, 0.0), (3, 0, 0.0)]

"""Removal of repeated byte spans by suffix arrays in shards.

A byte goes if a ``span``-byte string that covers it also starts in a document of smaller doc_id.

1. Texts are dealt into packs (a bucketed table, so that later passes over a pack's texts need no
   shuffle). The smallest hash among the k-byte strings of a window of ``span`` bytes is the
   window's anchor: equal windows have equal anchors at equal places.
2. Anchors are counted in shards by hash; each pack learns which of its anchors occur again. Whole
   texts are counted alike: of equal texts the one of smallest doc_id stands for all.
3. The bytes around a repeated anchor (all windows of that anchor) go to the anchor's shard. An
   anchor of more than ``HOT`` places is split: each of its windows goes to a shard of its own hash.
   Equal pieces meet as one, with their smallest doc_id.
4. A shard joins the different pieces of its anchors to one text and sorts its suffixes
   (``suffixes.suffix_array``). Neighbours whose permuted common prefix reaches ``span`` share their
   window; the smallest doc_id of such a run of neighbours goes back to each piece. A piece that is
   the only one of its anchor is a run of its own and needs no array.
5. Each pack marks the bytes of windows whose smallest doc_id is below the text's own.

Hashes only bring candidates together; windows are equal if their bytes are. Texts count as equal by
a 128-bit hash, pieces of one anchor by a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rareflag.llm import textbytes as tb
from rareflag.llm.scratch import written
from rareflag.llm.suffixes import common_prefixes, suffix_array
from rareflag.session import scratch_path

#: bytes of text in a pack, on average
PACK = 1 << 23
#: anchors in a shard, on average
SHARD = 1 << 19
#: places from which an anchor is split by window
HOT = 2000
#: windows of a piece, at most; longer runs of one anchor are cut
PIECE = 64
#: bytes of a suffix array's text, up to one anchor's pieces more
ARRAY = 1 << 20
#: bytes of text whose anchors are found at once: their arrays stay in a core's cache
CHUNK = 1 << 17
MAX_BUCKETS = 50_000
U64 = np.uint64


class Anchors(NamedTuple):
    hash: np.ndarray
    start: np.ndarray  # of the first window, in the texts' bytes
    count: np.ndarray  # of windows in a row
    text: np.ndarray


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each position, put together from hashes of 1, 2, 4, ... bytes."""
    n = len(data) - k + 1
    part, out, at, size = tb._BYTE[data], None, 0, 1
    while True:
        if k & size:
            piece = part[at:at + n]
            out = piece.copy() if out is None else tb.mix(out * U64(0xD6E8FEB86659FD93) + piece)
            at += size
        if size * 2 > k:
            return tb.mix(out)
        part = part[:-size] * U64(0xA0761D6478BD642F) + part[size:]
        part ^= part >> U64(29)
        size *= 2


def sliding_min(v: np.ndarray, m: int) -> np.ndarray:
    """Least of every m values in a row."""
    n, size = len(v) - m + 1, 1
    while size * 2 <= m:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    return np.minimum(v[:n], v[m - size:m - size + n]) if size < m else v


def anchors(t: tb.Texts, span: int) -> tuple[Anchors, np.ndarray]:
    """(anchors of all windows inside a text, hashes of the k-byte strings)."""
    k = span // 2 + 1
    none = np.zeros(0, np.int64)
    if len(t.data) < span:
        return Anchors(np.zeros(0, U64), none, none, none), np.zeros(0, U64)
    gram = gram_hashes(t.data, k)
    least = sliding_min(gram, span - k + 1)
    owner = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.offsets))
    at = np.flatnonzero(owner[:len(least)] == owner[span - 1:])
    if not len(at):
        return Anchors(np.zeros(0, U64), none, none, none), gram
    h = least[at]
    fresh = np.append(True, (h[1:] != h[:-1]) | (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
    first = np.flatnonzero(fresh)
    size = np.diff(np.append(first, len(at)))
    rep = -(-size // PIECE)
    step = (np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)) * PIECE
    first, size = np.repeat(first, rep) + step, np.minimum(np.repeat(size, rep) - step, PIECE)
    return Anchors(h[first], at[first], size, owner[at[first]]), gram


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then those of start[1], ..."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Pack(NamedTuple):
    """A pack's rows in one order, whatever order they came in."""

    doc: np.ndarray
    texts: tb.Texts
    digest: list[bytes]  # of each text


def _pack(rows: pa.Table) -> Pack:
    rows = rows.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    t = tb.texts(rows.column("text"))
    raw = t.data.tobytes()
    digest = [hashlib.blake2b(raw[a:b], digest_size=16).digest()
              for a, b in zip(t.offsets[:-1].tolist(), t.offsets[1:].tolist(), strict=True)]
    return Pack(rows.column("doc_id").to_numpy(), t, digest)


def _firsts(pack: Pack) -> dict[bytes, int]:
    """Smallest doc_id of each text of the pack; rows are in order of doc_id."""
    out: dict[bytes, int] = {}
    for d, h in zip(pack.doc.tolist(), pack.digest, strict=True):
        out.setdefault(h, d)
    return out


def _by_shard(shard: np.ndarray) -> list[tuple[int, slice]]:
    """(shard, its rows) of sorted shards."""
    cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[:len(shard)])
    if not len(cut):
        return []
    ends = np.append(cut[1:], len(shard))
    return [(int(shard[a]), slice(a, b)) for a, b in zip(cut, ends, strict=True)]


def _place(h: np.ndarray, shards: int) -> np.ndarray:
    """Sortable (shard, 32 bits of the hash) of a hash."""
    return ((h >> U64(32)) % U64(shards)) << U64(32) | (h & U64(0xFFFFFFFF))


_COUNTS = pa.schema([("shard", pa.int64()), ("pack", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary()),
                     ("digests", pa.binary()), ("ids", pa.binary())])
_FLAGS = pa.schema([("shard", pa.int64()), ("pack", pa.int64()), ("flags", pa.binary()), ("ids", pa.binary())])
_PIECES = pa.schema([("shard", pa.int64()), ("pack", pa.int64()), ("keys", pa.binary()), ("hashes", pa.binary()),
                     ("counts", pa.binary()), ("ids", pa.binary()), ("data", pa.binary())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", _SPANS),
                  ("kept", pa.binary())])
_OUT_SQL = "doc_id bigint, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"


_CODEC = pa.Codec("zstd", 1)


def _packed(raw: bytes | np.ndarray) -> bytes:
    """Length and compressed bytes: what travels between packs and shards is mostly text."""
    raw = raw.tobytes() if isinstance(raw, np.ndarray) else raw
    return len(raw).to_bytes(8, "little") + _CODEC.compress(raw, asbytes=True) if raw else b""


def _opened(raw: bytes) -> bytes:
    return _CODEC.decompress(raw[8:], int.from_bytes(raw[:8], "little"), asbytes=True) if raw else b""


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'bigint'}" for f in schema)


def _count_rows(rows: pa.Table, span: int, shards: int) -> pa.Table:
    """Pass 1 over a pack: its different anchors and texts, for each shard."""
    pack, name = _pack(rows), rows.column("pack")[0].as_py()
    found = [_place(anchors(t, span)[0].hash, shards) for _, _, t in tb.chunks(pack.texts, CHUNK)]
    place, count = np.unique(np.concatenate(found), return_counts=True)
    count = np.minimum(count, 65535).astype("<u2")
    out = {s: [place[r].astype("<u4").tobytes(), _packed(count[r]), b"", b""]
           for s, r in _by_shard((place >> U64(32)).astype(np.int64))}
    texts: dict[int, list] = {}
    for h, d in sorted(_firsts(pack).items()):
        texts.setdefault(int.from_bytes(h[:8], "little") % shards, []).append((h, d))
    for s, found in texts.items():
        row = out.setdefault(s, [b"", b"", b"", b""])
        row[2], row[3] = b"".join(h for h, _ in found), np.array([d for _, d in found], "<i8").tobytes()
    return pa.Table.from_arrays(
        [pa.array(list(out), pa.int64()), pa.array([name] * len(out), pa.int64()),
         *(pa.array([v[i] for v in out.values()], pa.binary()) for i in range(4))], schema=_COUNTS)


def _split(values: np.ndarray, sizes: list[int]) -> list[bytes]:
    cut = np.concatenate(([0], np.cumsum(sizes))).astype(int)
    return [values[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _flag_rows(rows: pa.Table, hot: int = HOT) -> pa.Table:
    """Of each anchor of each pack 1 if it occurs again, 2 if it is hot; of each text its smallest doc_id."""
    raw = [c.to_pylist() for c in rows.select(["hashes", "counts", "digests", "ids"]).columns]
    hashes = np.frombuffer(b"".join(raw[0]), "<u4")
    counts = np.frombuffer(b"".join(map(_opened, raw[1])), "<u2")
    _, back = np.unique(hashes, return_inverse=True)
    total = np.bincount(back, weights=counts)
    flag = ((total > 1) + (total > hot).astype(np.int8)).astype(np.uint8)[back]
    digests = np.frombuffer(b"".join(raw[2]), "V16")
    ids = np.frombuffer(b"".join(raw[3]), "<i8")
    _, back = np.unique(digests, return_inverse=True)
    least = np.full(int(back.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, back, ids)
    return pa.Table.from_arrays(
        [rows.column("shard").combine_chunks(), rows.column("pack").combine_chunks(),
         pa.array(map(_packed, _split(flag, [len(x) // 4 for x in raw[0]])), pa.binary()),
         pa.array(_split(least[back].astype("<i8"), [len(x) // 16 for x in raw[2]]), pa.binary())], schema=_FLAGS)


def _stands(pack: Pack, flags: list[tuple[int, bytes, bytes]], shards: int) -> np.ndarray:
    """For each row of the pack the smallest doc_id of its text."""
    ids = {s: np.frombuffer(x, "<i8") for s, _, x in flags}
    seen: dict[int, int] = {}
    least = {}
    for h in sorted(_firsts(pack)):
        s = int.from_bytes(h[:8], "little") % shards
        least[h] = int(ids[s][seen.get(s, 0)])
        seen[s] = seen.get(s, 0) + 1
    return np.array([least[h] for h in pack.digest], np.int64)


def _piece_rows(rows: pa.Table, flag_rows: pa.Table, span: int, shards: int) -> pa.Table:
    """Pass 2 over a pack: its different pieces, for each shard, and (shard -1) where they occur."""
    pack, name, k = _pack(rows), rows.column("pack")[0].as_py(), span // 2 + 1
    flags = sorted(zip(*(flag_rows.column(c).to_pylist() for c in ("shard", "flags", "ids")), strict=True))
    flag = np.frombuffer(b"".join(_opened(x) for _, x, _ in flags), np.uint8)
    least = _stands(pack, flags, shards)
    own = pack.doc == least
    own[1:] &= np.array([a != b for a, b in zip(pack.digest[1:], pack.digest[:-1], strict=True)], bool) | (
        pack.doc[1:] != pack.doc[:-1])
    parts = [(i, *anchors(t, span)) for i, _, t in tb.chunks(pack.texts, CHUNK)]
    known = np.unique(np.concatenate([_place(a.hash, shards) for _, a, _ in parts]))
    key, chash, text, start, count = [], [], [], [], []
    for i, a, gram in parts:
        f = flag[np.searchsorted(known, _place(a.hash, shards))] * own[i + a.text]
        cold, hot = np.flatnonzero(f == 1), np.flatnonzero(f == 2)
        at = np.concatenate((a.start[cold], _ragged(a.start[hot], a.count[hot])))
        n = np.concatenate((a.count[cold], np.ones(len(at) - len(cold), np.int64)))
        # with the number of windows: the grams of a periodic text are alike in pieces of any length
        h = (gram[at] + n.astype(U64)) * U64(0x9E3779B97F4A7C15)
        for step in range(k, PIECE + span, k):  # covers the piece; its last k bytes end it
            h = tb.mix(h * U64(0xD6E8FEB86659FD93) + gram[at + np.minimum(step, n + span - 1 - k)])
        key += [_place(np.concatenate((a.hash[cold], h[len(cold):])), shards)]
        chash += [h]
        text += [i + np.concatenate((a.text[cold], np.repeat(a.text[hot], a.count[hot])))]
        start += [at + pack.texts.offsets[i]]
        count += [n]
    key, chash, text, start, count = (np.concatenate(x) for x in (key, chash, text, start, count))
    order = np.lexsort((chash, key))
    fresh = np.append(True, (np.diff(key[order]) != 0) | (np.diff(chash[order]) != 0))[:len(order)]
    piece = np.empty(len(order), np.int64)
    piece[order] = np.cumsum(fresh) - 1
    rep = order[fresh]
    least_id = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least_id, piece, pack.doc[text])
    out = []
    for s, r in _by_shard((key[rep] >> U64(32)).astype(np.int64)):
        pick = rep[r]
        out.append((s, key[pick].astype("<u4"), chash[pick].astype("<u8"), count[pick].astype(np.uint8),
                    least_id[r].astype("<i8"), pack.texts.data[_ragged(start[pick], count[pick] + span - 1)]))
    out.append((-1, piece.astype("<i4"), start.astype("<i8"), text.astype("<i4"), least.astype("<i8"), b""))
    out = [(s, *map(_packed, blobs)) for s, *blobs in out]
    cols = list(zip(*out, strict=True))
    return pa.Table.from_arrays([pa.array(cols[0], pa.int64()), pa.array([name] * len(out), pa.int64()),
                                 *(pa.array(c, pa.binary()) for c in cols[1:])], schema=_PIECES)


def first_docs(data: np.ndarray, size: np.ndarray, doc: np.ndarray, span: int) -> np.ndarray:
    """For each window of each piece (in order) the smallest ``doc`` of a piece that has its bytes.

    ``data`` are the pieces' bytes in a row. The joined text gets a symbol below all bytes after each
    piece, so a common prefix of ``span`` bytes never leaves a piece."""
    n = len(size)
    begin = np.cumsum(size) - size + np.arange(n)
    at = _ragged(begin, size)
    s = np.ones(len(data) + n + 1, np.uint16)
    s[at] = data.astype(np.uint16) + 2
    s[-1] = 0
    sa = suffix_array(s, 258)
    window = _ragged(begin, size - span + 1)
    is_window = np.zeros(len(s), bool)
    is_window[window] = True
    raw = np.zeros(len(s), np.uint8)
    raw[at] = data
    shared = common_prefixes(raw, sa, span, is_window)
    ranked = sa[is_window[sa]]
    group = np.cumsum(shared[ranked] < span) - 1
    owner = np.zeros(len(s), np.int64)
    owner[window] = np.repeat(np.arange(n), size - span + 1)
    least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group, doc[owner[ranked]])
    out = np.empty(len(s), np.int64)
    out[ranked] = least[group]
    return out[window]


def _array_rows(rows: pa.Table, span: int, array: int = ARRAY) -> pa.Table:
    """A shard: for each piece of each pack its runs of windows (keys: runs, counts: windows) and
    their smallest doc_id (ids)."""
    raw = [[_opened(x) for x in c.to_pylist()]
           for c in rows.select(["keys", "hashes", "counts", "ids", "data"]).columns]
    key, chash = np.frombuffer(b"".join(raw[0]), "<u4"), np.frombuffer(b"".join(raw[1]), "<u8")
    count, doc = np.frombuffer(b"".join(raw[2]), np.uint8).astype(np.int64), np.frombuffer(b"".join(raw[3]), "<i8")
    data = np.frombuffer(b"".join(raw[4]), np.uint8)
    order = np.lexsort((chash, key))
    fresh = np.append(True, (np.diff(key[order]) != 0) | (np.diff(chash[order]) != 0))[:len(order)]
    piece = np.empty(len(order), np.int64)
    piece[order] = np.cumsum(fresh) - 1
    rep = order[fresh]
    least = np.full(len(rep), np.iinfo(np.int64).max)
    np.minimum.at(least, piece, doc)
    size = count + span - 1
    begin = (np.cumsum(size) - size)[rep]
    size, count = size[rep], count[rep]
    first = np.repeat(least, count)  # of each window of each different piece
    window = np.cumsum(count) - count
    ends = np.flatnonzero(np.append(np.diff(key[rep]) != 0, True)) + 1  # after the pieces of an anchor
    bounds = np.append(0, ends)
    several = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    todo = np.flatnonzero(several)
    anchor = np.repeat(np.arange(len(ends)), np.diff(bounds))
    load = np.cumsum(size[todo])
    lot = load // array
    lot = lot[np.searchsorted(anchor[todo], anchor[todo])]  # the pieces of an anchor stay together
    for _, r in _by_shard(lot):
        p = todo[r]
        first[_ragged(window[p], count[p])] = first_docs(data[_ragged(begin[p], size[p])], size[p], least[p], span)
    owner = np.repeat(np.arange(len(rep)), count)
    new = np.append(True, (np.diff(first) != 0) | (np.diff(owner) != 0))[:len(first)]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(first)))
    runs = np.bincount(owner[at], minlength=len(rep))
    run0 = np.cumsum(runs) - runs
    mine = runs[piece]
    pick = _ragged(run0[piece], mine)
    per_row = [len(x) for x in raw[2]]
    cut = np.concatenate(([0], np.cumsum(per_row))).astype(int)
    sizes = [int(x) for x in np.diff(np.append(0, np.cumsum(mine))[cut])]
    none = pa.array([b""] * rows.num_rows, pa.binary())
    return pa.Table.from_arrays(
        [rows.column("shard").combine_chunks(), rows.column("pack").combine_chunks(),
         pa.array(map(_packed, _split(mine.astype(np.uint8), per_row)), pa.binary()), none,
         pa.array(map(_packed, _split(length[pick].astype(np.uint8), sizes)), pa.binary()),
         pa.array(map(_packed, _split(first[at][pick].astype("<i8"), sizes)), pa.binary()), none], schema=_PIECES)


def _removal_rows(rows: pa.Table, found: pa.Table, span: int) -> pa.Table:
    """Pass 3 over a pack: removed spans and kept bytes of each row."""
    pack = _pack(rows)
    back = sorted(zip(*(found.column(c).to_pylist() for c in ("shard", "keys", "hashes", "counts", "ids")),
                      strict=True))
    back = [(s, *map(_opened, blobs)) for s, *blobs in back]
    _, piece, start, text, least = back[0]
    piece, text = np.frombuffer(piece, "<i4"), np.frombuffer(text, "<i4")
    start, least = np.frombuffer(start, "<i8"), np.frombuffer(least, "<i8")
    runs = np.frombuffer(b"".join(x[1] for x in back[1:]), np.uint8).astype(np.int64)
    length = np.frombuffer(b"".join(x[3] for x in back[1:]), np.uint8).astype(np.int64)
    first = np.frombuffer(b"".join(x[4] for x in back[1:]), "<i8")
    run0 = np.cumsum(runs) - runs
    before = np.cumsum(length) - length  # windows before a run, over all pieces
    mine = runs[piece]
    pick = _ragged(run0[piece], mine)
    base = np.repeat(before[np.minimum(run0[piece], max(len(before) - 1, 0))] if len(before) else run0[piece], mine)
    at = np.repeat(start, mine) + before[pick] - base
    gone = first[pick] < np.repeat(pack.doc[text], mine)
    t = pack.texts
    n = len(t.data)
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, at[gone], 1)
    np.add.at(edge, at[gone] + length[pick][gone] + span - 1, -1)
    off = t.offsets
    whole = pack.doc > least  # a copy of a smaller one's text
    np.add.at(edge, off[:-1][whole], 1)
    np.add.at(edge, off[1:][whole], -1)
    cut = np.cumsum(edge[:-1]) > 0
    own = np.arange(len(pack.doc))
    for i in range(1, len(own)):  # a repeated row is removed like the first of its kind
        if pack.doc[i] == pack.doc[i - 1] and pack.digest[i] == pack.digest[i - 1]:
            own[i] = own[i - 1]
            cut[off[i]:off[i + 1]] = cut[off[i - 1]:off[i]]
    removed = np.diff(np.concatenate(([0], np.cumsum(cut)))[off])
    begin, end = cut.copy(), cut.copy()
    begin[1:] &= ~cut[:-1]
    end[:-1] &= ~cut[1:]
    inner = off[1:-1]
    begin[inner], end[inner - 1] = cut[inner], cut[inner - 1]
    begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
    bounds = np.searchsorted(begin, off)
    shift = np.repeat(off[:-1], np.diff(bounds))
    spans = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array(begin - shift), pa.array(end - shift)], names=["start", "end"]))
    kept_off = np.concatenate(([0], np.cumsum(np.diff(off) - removed)))
    kept = pa.Array.from_buffers(pa.large_binary(), len(pack.doc), [
        None, pa.py_buffer(kept_off.astype(np.int64)), pa.py_buffer(t.data[~cut])]).cast(pa.binary())
    return pa.Table.from_arrays([pa.array(pack.doc), pa.array(np.diff(off)), pa.array(removed.astype(np.int64)),
                                 spans.cast(_SPANS), kept], schema=_OUT)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` written as a table in buckets of ``pack``; groups by pack over it need no shuffle."""
    spark, name = df.sparkSession, f"packs_{uuid.uuid4().hex}"
    df.repartition(buckets, "pack").write.format("parquet").option("compression", "zstd").option(
        "path", scratch_path(spark, f"llm/{name}")).bucketBy(buckets, "pack").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")  # the name only: an external table's files stay
    return out


def remove_repeats(docs: DataFrame, span: int = 50, text: str = "text", *, pack: int = PACK, shard: int = SHARD,
                   hot: int = HOT, array: int = ARRAY) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of removed [start, end) byte ranges), kept (binary) of every row.

    A null text counts as empty. A row without a doc_id is before and after no other: nothing is removed
    from it, and nothing because of it. Rows that repeat a doc_id don't remove each other's bytes; equal
    rows get equal results. Long texts are read whole, whatever their length; an empty table gives an
    empty result; other columns are not read. The last four parameters deal the work out and change
    no result.
    """
    if span < 8:
        raise ValueError("span must be at least 8 bytes")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    indexed = F.col("doc_id").isNotNull() & (F.octet_length("text") >= span)
    rest = rows.where(~indexed).select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"))
    total = rows.where(indexed).agg(F.sum(F.octet_length("text").cast("long"))).first()[0]
    if not total:
        return rest
    packs = math.ceil(total / pack)
    shards = max(1, math.ceil(total / (shard * (span // 4 + 1))))
    dealt = rows.where(indexed).withColumn("pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs)))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _bucketed(dealt, min(max(packs, least), MAX_BUCKETS))
    pack_of = dealt.groupBy("pack")
    counted = pack_of.applyInArrow(lambda x: _count_rows(x, span, shards), _sql(_COUNTS))
    flags = counted.groupBy("shard").applyInArrow(lambda x: _flag_rows(x, hot), _sql(_FLAGS))
    pieces = written(pack_of.cogroup(flags.groupBy("pack")).applyInArrow(
        lambda x, y: _piece_rows(x, y, span, shards), _sql(_PIECES)), "pieces")
    runs = pieces.where("shard >= 0").groupBy("shard").applyInArrow(lambda x: _array_rows(x, span, array), _sql(_PIECES))
    found = pieces.where("shard < 0").unionByName(runs)
    return pack_of.cogroup(found.groupBy("pack")).applyInArrow(
        lambda x, y: _removal_rows(x, y, span), _OUT_SQL).unionByName(rest)

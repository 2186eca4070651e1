"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

A text is parted before each run of spaces that follows other characters; no
piece reaches across such a border.  Every part is segmented from an agenda of
candidate merges, best score first; a candidate is skipped when a keyed hash of
seed, text, part, place and pieces falls under the dropout rate, so that each
occurrence of a part draws for itself.  Where none of the merges that a part
takes without dropout is skipped, it is segmented as without dropout; only that
segmentation is remembered.  The same seed gives the same segmentation anywhere;
any segmentation decodes to the text itself.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm import batches
from palimpsest.llm.batches import annotate, fresh, mix, once, span_hashes, table, utf8

DEFAULT_VOCABULARY = "piece_bpe_32k.model"
#: Chance that a candidate merge is skipped, and the seed of the draws.
DROPOUT, SEED = 0.1, 20240607
#: Parts of up to so many characters are merged in step; longer ones one by one, from a heap.
IN_STEP = 48
WIDTHS = (0, 4, 6, 8, 10, 12, 16, 24, 32, IN_STEP)
#: Parts segmented without dropout that a worker keeps before it starts anew, and text bytes segmented at a time.
REMEMBERED, STEP_BYTES = 200_000, 1 << 19
_NONE = np.int32(2**31 - 1)
_META = 0x2581


@dataclass
class Vocabulary:
    """Piece ids by character, candidate merges as a hash table, and the bytes that each id stands for."""

    first: np.ndarray  # id of each code point as a piece of one character, or -1
    keys: np.ndarray  # left << 20 | right, or -1
    merged: np.ndarray
    rank: np.ndarray  # the lower, the sooner
    byte_ids: np.ndarray
    content: np.ndarray  # bytes of all ids
    bounds: np.ndarray

    def candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged id and rank of pairs; rank _NONE where there is no piece."""
        key = np.where((left < 0) | (right < 0), np.int64(-2), left.astype(np.int64) << 20 | right)
        mask = np.uint64(len(self.keys) - 1)
        slot = mix(key.astype(np.uint64)) & mask
        at = self.keys[slot]
        todo = np.flatnonzero((at != key) & (at != -1) & (key >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & mask
            at[todo] = self.keys[slot[todo]]
            todo = todo[(at[todo] != key[todo]) & (at[todo] != -1)]
        hit = at == key
        return np.where(hit, self.merged[slot], -1), np.where(hit, self.rank[slot], _NONE)


def read_vocabulary(content: bytes) -> Vocabulary:
    """From the bytes of a BPE model with byte fallback, without normalisation, with the dummy prefix."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    plain = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in range(n)]
    ids = {names[i]: i for i in range(n) if plain[i]}
    if any("▁" in p.lstrip("▁") for p in ids) or len(model.encode("")) or model.encode("  ") == model.encode(" "):
        raise ValueError("only models whose pieces begin with their spaces, and that keep all spaces, are read")
    first = np.full(0x110000, -1, np.int32)
    for p, i in ids.items():
        if len(p) == 1:
            first[ord(p)] = i
    scores = np.array([model.get_score(i) for i in range(n)])
    rank_of = np.searchsorted(np.unique(-scores), -scores).astype(np.int32)  # equal scores, equal ranks
    pairs = {ids[p[:k]] << 20 | ids[p[k:]]: i for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids}
    size = 1 << (8 * len(pairs)).bit_length()
    keys, merged, rank = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.full(size, _NONE, np.int32)
    slots = (mix(np.array(list(pairs), np.uint64)) & np.uint64(size - 1)).tolist()
    for slot, (key, i) in zip(slots, pairs.items(), strict=True):
        while keys[slot] != -1:
            slot = (slot + 1) % size
        keys[slot], merged[slot], rank[slot] = key, i, rank_of[i]
    byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
    value = {int(i): bytes([b]) for b, i in enumerate(byte_ids)} | {i: p.replace("▁", " ").encode() for p, i in ids.items()}
    contents = [value.get(i, b"") for i in range(n)]
    first[0x20], first[_META] = first[_META], -1  # a real U+2581 is spelled in bytes, else it would decode to a space
    return Vocabulary(first, keys, merged, rank, byte_ids, np.frombuffer(b"".join(contents), np.uint8), np.concatenate(([0], np.cumsum([len(c) for c in contents]))))


def named(place: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a candidate within its part."""
    return mix(place.astype(np.uint64) << np.uint64(40) | left.astype(np.uint64) << np.uint64(20) | right.astype(np.uint64))


def skipped(draw: np.ndarray, name: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the keyed hash drops a named candidate; `draw` is the hash of seed, text, place in it and part."""
    if dropout <= 0:
        return np.zeros(len(draw), bool)
    return (mix(draw + name) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < dropout


def agenda(points: np.ndarray, draw: int, vocab: Vocabulary, dropout: float, taken: list[tuple[int, int, int]] | None = None) -> list[tuple[int, int]]:
    """(id or -1, place) of each symbol of one part, merged from a heap; `taken` gets the merges (place, left, right)."""
    symbol = vocab.first[points].tolist()
    n = len(symbol)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap: list[tuple[int, int, int, int, int, int]] = []
    d = np.array([draw], np.uint64)

    def propose(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and after[i] >= 0 and symbol[i] >= 0 and symbol[after[i]] >= 0]
        if not lefts:
            return
        a, b = np.array([symbol[i] for i in lefts], np.int64), np.array([symbol[after[i]] for i in lefts], np.int64)
        merged, rank = vocab.candidates(a, b)
        good = (rank != _NONE) & ~skipped(np.repeat(d, len(lefts)), named(np.array(lefts), a, b), dropout)
        for k in np.flatnonzero(good).tolist():
            heapq.heappush(heap, (int(rank[k]), lefts[k], after[lefts[k]], int(a[k]), int(b[k]), int(merged[k])))

    propose(list(range(n)))
    while heap:
        _, i, j, a, b, new = heapq.heappop(heap)
        if symbol[i] != a or after[i] != j or symbol[j] != b:
            continue
        if taken is not None:
            taken.append((i, a, b))
        symbol[i], symbol[j], after[i] = new, -2, after[j]
        if after[i] >= 0:
            before[after[i]] = i
        propose([before[i], i])
    return [(s, i) for i, s in enumerate(symbol) if s != -2]


def in_step(points: np.ndarray, bounds: np.ndarray, draws: np.ndarray, vocab: Vocabulary, dropout: float, taken: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, places and parts of many short parts, all merged one candidate at a time in step; `taken` gets the merges (part, name)."""
    sizes = np.diff(bounds)
    width = int(sizes.max())
    column = np.arange(width)
    inside = column < sizes[:, None]
    symbol = np.full((len(sizes), width + 1), -1, np.int32)
    symbol[:, :-1][inside] = vocab.first[points]
    symbol[:, :-1][~inside] = -2
    symbol[:, -1] = -2
    place = np.broadcast_to(np.arange(width + 1, dtype=np.int32), symbol.shape).copy()
    merged, rank = np.full((len(sizes), width + 1), -1, np.int32), np.full((len(sizes), width + 1), _NONE, np.int32)

    def propose(rows: np.ndarray, at: np.ndarray, owner: np.ndarray) -> None:
        a, b = symbol[rows, at], symbol[rows, at + 1]
        m, r = vocab.candidates(a, b)
        some = np.flatnonzero(r != _NONE)
        if len(some):
            r[some[skipped(draws[owner[some]], named(place[rows[some], at[some]], a[some], b[some]), dropout)]] = _NONE
        merged[rows, at], rank[rows, at] = m, r

    live = np.arange(len(sizes))
    rows, at = np.nonzero(inside[:, : width - 1] & inside[:, 1:]) if width > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    propose(rows, at, live[rows])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        j = rank.argmin(axis=1)
        rows = np.arange(len(live))
        more = rank[rows, j] != _NONE
        if not more.all():
            done = ~more
            keep = symbol[done] != -2
            r, _ = np.nonzero(keep)
            out.append((symbol[done][keep], place[done][keep], live[done][r]))
            symbol, place, merged, rank, live, j = symbol[more], place[more], merged[more], rank[more], live[more], j[more]
            if not len(live):
                break
            rows = np.arange(len(live))
        if taken is not None:
            taken.append((live, named(place[rows, j], symbol[rows, j], symbol[rows, j + 1])))
        symbol[rows, j] = merged[rows, j]
        shift = np.arange(symbol.shape[1])
        shift = shift + (shift > j[:, None])
        shift[:, -1] -= 1
        shift += rows[:, None] * symbol.shape[1]
        symbol, place, merged, rank = (x.ravel()[shift] for x in (symbol, place, merged, rank))
        symbol[:, -1], rank[:, -1] = -2, _NONE
        propose(rows, j, live)
        left = np.flatnonzero(j > 0)
        propose(left, j[left] - 1, live[left])
    symbols, places, parts = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(parts, kind="stable")
    return symbols[order], places[order], parts[order]


class Encoder:
    """Segments parts of texts, and remembers their segmentation without dropout and the merges it takes."""

    def __init__(self, vocab: Vocabulary, seed: int, dropout: float):
        self.vocab, self.dropout = vocab, dropout
        self.seed = mix(np.array([seed % 2**64], np.uint64))[0]
        self.forget()

    def forget(self) -> None:
        self.keys, self.starts, self.sizes, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.first, self.merges, self.names = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def segment(self, parts: list[bytes], keys: np.ndarray, dropout: float | None = None, taken: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, one after the other, and how many each has; `taken` gets the merges (part, name)."""
        dropout = self.dropout if dropout is None else dropout
        text = b"".join(parts).decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        data = np.frombuffer(b"".join(parts), np.uint8)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        bounds = lead[np.concatenate(([0], np.cumsum([len(p) for p in parts])))]
        sizes, draws = np.diff(bounds), mix(keys + self.seed)
        symbols, places, owner = [], [], []
        for low, high in zip(WIDTHS, WIDTHS[1:]):
            own = np.flatnonzero((sizes > low) & (sizes <= high))
            for k in range(0, len(own), 16_384):
                some = own[k : k + 16_384]
                cut = np.concatenate(([0], np.cumsum(sizes[some])))
                take = np.repeat(bounds[some] - cut[:-1], sizes[some]) + np.arange(cut[-1])
                own_taken: list[tuple[np.ndarray, np.ndarray]] | None = None if taken is None else []
                s, p, o = in_step(points[take], cut, draws[some], self.vocab, dropout, own_taken)
                if taken is not None:
                    taken += [(some[part], name) for part, name in own_taken]
                symbols.append(s), places.append(p), owner.append(some[o])
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            merges: list[tuple[int, int, int]] = []
            found = agenda(points[bounds[i] : bounds[i + 1]], int(draws[i]), self.vocab, dropout, merges)
            if taken is not None and merges:
                taken.append((np.full(len(merges), i), named(*np.array(merges, np.int64).T)))
            symbols.append(np.array([s for s, _ in found], np.int32)), places.append(np.array([p for _, p in found], np.int32)), owner.append(np.full(len(found), i))
        symbol, place, part = np.concatenate(symbols), np.concatenate(places), np.concatenate(owner)
        order = np.argsort(part, kind="stable")
        symbol, place, part = symbol[order], place[order], part[order]
        # Characters without a piece are spelled in bytes.
        unknown = symbol == -1
        point = points[bounds[part] + place]
        width = np.where(unknown, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), 1)
        ids = np.repeat(symbol, width)
        spelled = np.frombuffer(point[unknown].astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8", "replace"), np.uint8)
        ids[np.repeat(unknown, width)] = self.vocab.byte_ids[spelled]
        return ids, np.bincount(part, weights=width, minlength=len(parts)).astype(np.int64)

    def learn(self, parts: list[bytes], keys: np.ndarray, at: np.ndarray) -> None:
        """Remember new parts as they are without dropout, where their keys belong."""
        taken: list[tuple[np.ndarray, np.ndarray]] = []
        ids, sizes = self.segment(parts, keys, 0.0, taken)
        part = np.concatenate([np.zeros(0, np.int64), *(p for p, _ in taken)])
        names = np.concatenate([np.zeros(0, np.uint64), *(n for _, n in taken)])
        merges = np.bincount(part, minlength=len(parts))
        begins = lambda n, held: len(held) + np.concatenate(([0], np.cumsum(n)[:-1]))
        self.starts, self.sizes = np.insert(self.starts, at, begins(sizes, self.ids)), np.insert(self.sizes, at, sizes)
        self.first, self.merges = np.insert(self.first, at, begins(merges, self.names)), np.insert(self.merges, at, merges)
        self.keys, self.ids, self.names = np.insert(self.keys, at, keys), np.concatenate((self.ids, ids)), np.concatenate((self.names, names[np.argsort(part, kind="stable")]))

    def diverging(self, at: np.ndarray, draws: np.ndarray) -> np.ndarray:
        """Occurrences whose draw skips a merge of their remembered part; all others are segmented as it is."""
        out, first, left, live = [], self.first[at], self.merges[at], np.arange(len(at))
        k = 0
        while len(live):
            live = live[left[live] > k]
            drop = skipped(draws[live], self.names[first[live] + k], self.dropout)
            out.append(live[drop])
            live, k = live[~drop], k + 1
        return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def exact(self, text: bytes) -> np.ndarray:
        """Ids of one text, each part segmented for itself, without what is remembered by hash."""
        own = np.frombuffer(b" " + text, np.uint8)
        space = own == 0x20
        starts = np.flatnonzero(np.concatenate(([True], space[1:] & ~space[:-1])))
        ends = np.append(starts[1:], len(own))
        whole = span_hashes(own, np.zeros(1, np.int64), np.array([len(own)]))
        draws = mix(span_hashes(own, starts, ends) + mix(whole + np.arange(len(starts)).astype(np.uint64)))
        raw = own.tobytes()
        return self.segment([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], draws)[0]

    def encode(self, offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text's."""
        texts = len(offsets) - 1
        full = np.flatnonzero(np.diff(offsets) > 0)
        # The dummy prefix: one space before each text that isn't empty.
        own = np.empty(len(data) + len(full), np.uint8)
        begin = offsets[:-1][full] + np.arange(len(full))
        rest = np.ones(len(own), bool)
        rest[begin] = False
        own[begin], own[rest] = 0x20, data
        space = own == 0x20
        first = np.zeros(len(own), bool)
        first[begin] = True
        first[1:] |= space[1:] & ~space[:-1]
        starts = np.flatnonzero(first)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(texts + 1, np.int64)
        ends = np.append(starts[1:], len(own))
        text = np.searchsorted(begin, starts, side="right") - 1
        hashes = span_hashes(own, starts, ends)
        whole = span_hashes(own, begin, np.append(begin[1:], len(own)))
        keys, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        raw = own.tobytes()
        if len(new):
            self.learn([raw[a:b] for a, b in zip(starts[index[new]].tolist(), ends[index[new]].tolist(), strict=True)], keys[new], at[new])
            at = np.searchsorted(self.keys, keys)
        at = at[inverse]
        start, size, pool = self.starts[at], self.sizes[at], self.ids
        if self.dropout > 0:
            draws = mix(hashes + mix(whole[text] + (np.arange(len(starts)) - np.searchsorted(starts, begin)[text]).astype(np.uint64)))
            other = self.diverging(at, mix(draws + self.seed))
            if len(other):
                drawn, which, back = np.unique(draws[other], return_index=True, return_inverse=True)
                some = other[which]
                ids, sizes = self.segment([raw[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)], drawn)
                begins = len(pool) + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                start[other], size[other], pool = begins[back], sizes[back], np.concatenate((pool, ids))
        total = np.concatenate(([0], np.cumsum(size)))
        ids = pool[np.repeat(start - total[:-1], size) + np.arange(total[-1])]
        bounds = np.zeros(texts + 1, np.int64)
        bounds[1:][full] = np.bincount(text, weights=size, minlength=len(full)).astype(np.int64)
        return ids, np.cumsum(bounds)


def decoded(ids: np.ndarray, bounds: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, without the dummy prefix, and the bounds of each."""
    size = (vocab.bounds[1:] - vocab.bounds[:-1])[ids]
    total = np.concatenate(([0], np.cumsum(size)))
    out = vocab.content[np.repeat(vocab.bounds[ids] - total[:-1], size) + np.arange(total[-1])]
    cut = total[bounds]
    drop = cut[:-1][np.diff(cut) > 0]
    drop = drop[out[drop] == 0x20]
    gone = np.zeros(len(out) + 1, np.int64)
    gone[drop + 1] = 1
    return np.delete(out, drop), cut - np.cumsum(gone)[cut]


def lossless(ids: np.ndarray, bounds: np.ndarray, offsets: np.ndarray, data: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Whether each text's ids decode to its bytes."""
    back, cut = decoded(ids, bounds, vocab)
    equal = np.diff(cut) == np.diff(offsets)
    if equal.all() and len(back) == len(data):
        wrong = np.flatnonzero(back != data)
        equal[np.searchsorted(offsets, wrong, side="right") - 1] = False
        return equal
    return np.array([back[a:b].tobytes() == data[c:d].tobytes() for a, b, c, d in zip(cut, cut[1:], offsets, offsets[1:])], bool)


def _sent(spark: SparkSession, vocabulary: str, kind: str):
    """A vocabulary sent to the executors, and the name of what is made from it."""
    with open(vocabulary, "rb") as f:
        content = f.read()
    return spark.sparkContext.broadcast(content), batches.named(kind, content)


def encode(docs: DataFrame, vocabulary: str, *, text: str = "text", seed: int = SEED, dropout: float = DROPOUT, keep: list[str] | None = None) -> DataFrame:
    """Add ids, n_pieces and lossless (the ids decode to the text) of every whole text.

    `vocabulary` is the path of the model on the driver.  A null or empty text
    has no ids.  With dropout 0 the ids are those of the library, but for a real
    U+2581, which is spelled in bytes.  Equal texts, so repeated rows too, are
    segmented alike; within a text and between texts, each occurrence of a word
    draws for itself.  An empty table gives an empty table; columns named ids,
    n_pieces or lossless, in any case, give way.
    """
    sent, key = _sent(docs.sparkSession, vocabulary, f"encoder {seed} {dropout}")

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        encoder = once(key, lambda: Encoder(read_vocabulary(sent.value), seed, dropout))
        offsets, data = utf8(piece.column(at))
        ids, bounds = encoder.encode(offsets, data)
        equal = lossless(ids, bounds, offsets, data, encoder.vocab)
        if not equal.all():
            # Two parts of one hash: they are remembered as one, so what decodes to another text is encoded anew.
            encoder.forget()
            lists = np.split(ids, bounds[1:-1])
            for i in np.flatnonzero(~equal).tolist():
                lists[i] = encoder.exact(data[offsets[i] : offsets[i + 1]].tobytes())
            ids, bounds = np.concatenate(lists).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            equal = lossless(ids, bounds, offsets, data, encoder.vocab)
        return [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())), pa.array(np.diff(bounds), pa.int64()), pa.array(equal, pa.bool_())]

    return annotate(docs, text, [("ids", T.ArrayType(T.IntegerType())), ("n_pieces", T.LongType()), ("lossless", T.BooleanType())], compute, keep, STEP_BYTES, key)


def decode(encoded: DataFrame, vocabulary: str, *, ids: str = "ids", into: str = "text") -> DataFrame:
    """Add the texts that ids stand for; null or empty ids give the empty text, bytes that are no UTF-8 replacement characters."""
    sent, key = _sent(encoded.sparkSession, vocabulary, "decoder")
    kept = [c for c in encoded.columns if c.lower() != into.lower()]

    def run(parts):
        vocab = once(key, lambda: read_vocabulary(sent.value))
        for batch in parts:
            lists = batch.column(len(kept)).fill_null([])
            own = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            out, cut = decoded(own, bounds, vocab)
            raw = out.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])], pa.string())], names=[*kept, into])

    source = encoded.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids}`").cast("array<int>").alias(fresh(encoded, "__ids")))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:-1], T.StructField(into, T.StringType())]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def op9_pieces(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids, n_pieces and lossless of every document."""
    return encode(table(spark, sf_dir, "documents"), vocabulary or default_vocabulary(), keep=["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training form of each document: its columns without the text, which the ids decode to."""
    return encode(docs, default_vocabulary(), keep=[c for c in docs.columns if c != "text"])

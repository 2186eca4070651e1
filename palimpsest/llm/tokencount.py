"""Token counts by finite-state transducers.

The pre-tokenizer is a deterministic transducer over character classes whose
transitions say where pre-tokens begin.  A text is cut into chunks; each chunk
gives a map from every state to the state after it, the maps are composed by a
parallel prefix scan, and with every chunk's first state known all chunks emit
at once.  Within a pre-token a second transducer, whose states are the tokens
themselves, emits one token a transition: token b may follow token a only if
the merges keep the pair apart, and the one path through the pre-token that
these transitions allow is the library's segmentation.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.llm.batches import annotate, named, once, same_spans, span_hashes, table, utf8

#: Characters of a chunk, and of its end whose map is tried first.
CHUNK, TAIL = 256, 32
#: Pre-tokens and token pairs that a worker remembers before it starts anew.
REMEMBERED = 600_000
DEFAULT_VOCABULARY = "byte_bpe_50k.json"

# Classes of characters.
CLASSES = ("other_letter", "stmd", "rv", "l", "e", "number", "space", "white", "apostrophe", "sign", "end")
LETTER, STMD, RV, ELL, EE, NUMBER, SPACE, WHITE, QUOTE, SIGN, END = range(11)
# States: what the text so far ends with.
STATES = ("start", "letters", "numbers", "signs", "quote", "quote_rv", "quote_l", "contraction", "space", "white", "spaces", "whites")
START, LETTERS, NUMBERS, SIGNS, OPEN, OPEN_RV, OPEN_L, CLOSED, ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE = range(12)
#: Emissions: a pre-token begins at this character; at the one before it.
HERE, BEFORE = 1, 2


def pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """The transducer's next states and emissions, by class and state."""
    to, emit = np.zeros((len(CLASSES), len(STATES)), np.uint8), np.zeros((len(CLASSES), len(STATES)), np.uint8)
    fresh = {LETTER: LETTERS, STMD: LETTERS, RV: LETTERS, ELL: LETTERS, EE: LETTERS, NUMBER: NUMBERS, SPACE: ONE_SPACE, WHITE: ONE_WHITE, QUOTE: OPEN, SIGN: SIGNS, END: START}
    letters = (LETTER, STMD, RV, ELL, EE)
    for c in range(len(CLASSES)):
        for s in range(len(STATES)):
            state, out = fresh[c], HERE
            if s == LETTERS and c in letters or s == NUMBERS and c == NUMBER:
                out = 0
            elif s == SIGNS and c in (QUOTE, SIGN):
                state, out = SIGNS, 0
            elif s == OPEN:
                if c in (QUOTE, SIGN):
                    state, out = SIGNS, 0
                elif c in (STMD, RV, ELL):
                    state, out = {STMD: CLOSED, RV: OPEN_RV, ELL: OPEN_L}[c], 0
            elif s in (OPEN_RV, OPEN_L):
                if (s, c) in ((OPEN_RV, EE), (OPEN_L, ELL)):
                    state, out = CLOSED, 0
                else:  # no contraction: the quote stands alone and letters began after it
                    out = BEFORE if c in letters else BEFORE | HERE
            elif s in (ONE_SPACE, ONE_WHITE, MORE_SPACE, MORE_WHITE):
                if c in (SPACE, WHITE):
                    state, out = MORE_SPACE if c == SPACE else MORE_WHITE, 0
                elif c != END:
                    joined = s in (ONE_SPACE, MORE_SPACE)
                    state = SIGNS if joined and c == QUOTE else state
                    out = (0 if joined else HERE) | (BEFORE if s in (MORE_SPACE, MORE_WHITE) else 0)
            to[c, s], emit[c, s] = state, out
    return to, emit


def classes() -> np.ndarray:
    """The class of every code point; letters and numbers are Unicode's categories L and N."""
    kind = np.full(0x110000, SIGN, np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kind[c] = LETTER
        elif first == "N":
            kind[c] = NUMBER
    kind[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    kind[0x20], kind[0x27] = SPACE, QUOTE
    for letters, c in (("stmd", STMD), ("rv", RV), ("l", ELL), ("e", EE)):
        kind[[ord(x) for x in letters]] = c
    return kind


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan: row i becomes the map through chunks 0 to i."""
    step = 1
    while step < len(maps):
        maps = np.concatenate((maps[:step], np.take_along_axis(maps[step:], maps[:-step], axis=1)))
        step *= 2
    return maps


def begins(kind: np.ndarray, to: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Whether a pre-token begins at each character of a sequence of classes that ends each text with END."""
    n, states = len(kind), to.shape[1]
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, END, np.uint8)
    grid[:n] = kind
    grid = grid.reshape(chunks, CHUNK)
    flat_to, flat_emit = to.ravel(), emit.ravel()
    row = grid.astype(np.intp) * states

    def through(rows: np.ndarray, first: int) -> np.ndarray:
        maps = np.broadcast_to(np.arange(states, dtype=np.uint8), (len(rows), states))
        for j in range(first, CHUNK):
            maps = flat_to[rows[:, j, None] + maps]
        return maps

    # What follows a chunk's last characters often no longer depends on what came before them.
    maps = through(row, CHUNK - TAIL)
    open_rows = np.flatnonzero((maps != maps[:, :1]).any(axis=1))
    if len(open_rows):
        maps[open_rows] = through(row[open_rows], 0)
    state = np.concatenate(([START], compose(maps)[:-1, START])).astype(np.intp)
    out = np.empty((CHUNK, chunks), np.uint8)
    columns = np.ascontiguousarray(row.T)
    for j in range(CHUNK):
        at = columns[j] + state
        out[j] = flat_emit[at]
        state = flat_to[at]
    out = out.T.ravel()[:n]
    begun = out & HERE > 0
    begun[:-1] |= out[1:] & BEFORE > 0
    return begun


class TokenTransducer:
    """States are tokens; the transition to token b emits one token and is there if no merge crosses the pair."""

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        # States are numbered as the merges make them: single bytes, then one a merge.
        order = {t: k for k, t in enumerate(sorted(t for t in vocab if len(t) == 1))}
        singles = len(order)
        self.parts: list[tuple[int, int] | None] = [None] * singles
        self.joined: dict[tuple[int, int], int] = {}
        self.size = [1] * singles
        for a, b in merges:
            if a + b not in order:
                order[a + b] = len(order)
                self.parts.append((order[a], order[b]))
                self.size.append(len(a) + len(b))
            self.joined.setdefault((order[a], order[b]), order[a + b])
        # The longest token that begins each beginning of a token, and the next shorter one within a token.
        self.longest: dict[bytes, int] = {}
        self.shorter = [-1] * len(order)
        for token in order:
            for n in range(1, len(token) + 1):
                if token[:n] not in self.longest:
                    self.longest[token[:n]] = next(order[token[:m]] for m in range(n, 0, -1) if token[:m] in order)
        for token, k in order.items():
            self.shorter[k] = self.longest[token[:-1]] if len(token) > 1 else -1
        self.order = order
        self.made = [p is None or self.follows(*p, k) for k, p in enumerate(self.parts)]
        self.allowed: dict[int, bool] = {}
        self.known: dict[bytes, int] = {}

    def follows(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """The transition a to b: no merge made before `below` joins the two or parts of them across their border.

        Takes back, one at a time, the later of the merges that made the tokens
        at the border; a merge across it that comes first would have won.
        """
        joined, parts = self.joined, self.parts
        while True:
            if joined.get((a, b), below) < below:
                return False
            pa_, pb_ = parts[a], parts[b]
            if pa_ is None and pb_ is None:
                return True
            if pb_ is None or pa_ is not None and a > b:
                below, a = a, pa_[1]
            else:
                # On the right a merge of the same number wins further left, so across the border.
                below, b = b + 1, pb_[0]

    def count(self, text: bytes) -> int:
        """Tokens of a pre-token: the transitions of the one path; longest tokens are tried first."""
        longest, shorter, size, allowed = self.longest, self.shorter, self.size, self.allowed
        n, start, last = len(text), 0, -1
        path: list[int] = []
        dead: set[int] = set()  # ends that lead nowhere, whatever comes before: only one path reaches an end
        token = self.begin(text, 0)
        while True:
            while token >= 0:
                end = start + size[token]
                if end not in dead:
                    if last < 0:
                        if self.made[token]:
                            break
                    else:
                        pair = last << 20 | token
                        if (ok := allowed.get(pair)) is None:
                            if len(allowed) > REMEMBERED:
                                allowed.clear()
                            ok = allowed[pair] = self.follows(last, token)
                        if ok:
                            break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                start = end
                if start == n:
                    return len(path)
                last = token
                token = longest[text[start : start + 1]]
                stop = start + 2
                while stop <= n and (more := longest.get(text[start:stop])) is not None:
                    token, stop = more, stop + 1
            else:
                dead.add(start)
                token = path.pop()
                start -= size[token]
                last = path[-1] if path else -1
                token = shorter[token]

    def begin(self, text: bytes, start: int) -> int:
        """The longest token at a place."""
        token, stop = -1, start + 1
        while stop <= len(text) and (more := self.longest.get(text[start:stop])) is not None:
            token, stop = more, stop + 1
        return token

    def counts(self, spans: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        found = list(map(known.get, spans))
        for i, c in enumerate(found):
            if c is None:
                found[i] = known[spans[i]] = self.count(spans[i])
        return np.array(found, np.int64)


def compiled(content: str) -> tuple[TokenTransducer, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Compile a tokenizer file: byte-level BPE with the usual pattern and no normaliser."""
    spec = json.loads(content)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if spec.get("normalizer") or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("ignore_merges"):
        raise ValueError("only byte-level BPE without normaliser or prefix space is compiled")
    # The printable stand-in of each byte, as byte-level vocabularies write them.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    raw = lambda s: bytes(stand_in[c] for c in s)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    vocab = {raw(t): i for t, i in model["vocab"].items() if t not in special}
    merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    return TokenTransducer(vocab, merges), *pretokenizer(), classes(), special


def token_counts(texts: list[str], tools: tuple) -> np.ndarray:
    """Tokens of each text; a special token's string counts as that one token and parts the text."""
    transducer, to, emit, kinds, special = tools
    owner, parts, extra = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        pieces = [text]
        for s in special:
            if s and s in text:
                split = [p.split(s) for p in pieces]
                extra[i] += sum(len(p) - 1 for p in split)
                pieces = [q for p in split for q in p]
        owner += [i] * len(pieces)
        parts += pieces
    # One character closes each part; it belongs to no pre-token.
    joined = "\0".join(parts) + "\0"
    data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    points = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    kind = kinds[points]
    ends = np.cumsum(np.array([len(p) for p in parts], np.int64) + 1) - 1
    kind[ends] = END
    begun = begins(kind, to, emit)
    begun[ends] = True
    at = np.flatnonzero(begun)
    byte_of = np.flatnonzero((data & 0xC0) != 0x80)
    starts, stops = byte_of[at[:-1]], byte_of[at[1:]]
    real = kind[at[:-1]] != END
    starts, stops, first = starts[real], stops[real], at[:-1][real]
    if not len(starts):
        return extra
    _, index, inverse = np.unique(span_hashes(data, starts, stops), return_index=True, return_inverse=True)
    if not (np.array_equal(stops - starts, (stops - starts)[index][inverse]) and same_spans(data, starts, stops, data, starts[index][inverse])):
        index = inverse = np.arange(len(starts))  # unlike pre-tokens of one hash: each is counted for itself
    raw = data.tobytes()
    counts = transducer.counts([raw[a:b] for a, b in zip(starts[index].tolist(), stops[index].tolist(), strict=True)])
    part = np.searchsorted(ends, first)
    return extra + np.bincount(np.array(owner)[part], weights=counts[inverse], minlength=len(texts)).astype(np.int64)


def count(docs: DataFrame, vocabulary: str, *, text: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit of every whole text.

    `vocabulary` is the path of the tokenizer file on the driver; its content
    (some MB) is sent to the executors.  A null text counts as empty: 0 bytes, 0
    tokens.  Repeated rows count alike; a very long pre-token takes time in
    proportion to its length.
    """
    with open(vocabulary, encoding="utf-8") as f:
        content = f.read()
    sent, key = docs.sparkSession.sparkContext.broadcast(content), named("transducer", content.encode())

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        tools = once(key, lambda: compiled(sent.value))
        offsets, _ = utf8(piece.column(at))
        n = token_counts([v or "" for v in piece.column(at).to_pylist()], tools)
        return [pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())]

    return annotate(docs, text, [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())], compute, keep, key=key)


def op4_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(DEFAULT_VOCABULARY)
    return count(table(spark, sf_dir, "documents"), vocabulary, keep=["doc_id"])

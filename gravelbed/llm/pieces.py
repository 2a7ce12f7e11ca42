"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words (a run of U+2581 and what follows up to the next one) are searched once for each part
of a batch and kept in a bounded cache. Words of equal length advance together: at each end
position, substring hashes of all lengths probe a hash table of the piece keys (a hit counts only if the
characters are equal too), the best of the candidates is taken for all words at once, and a backpointer is
stored. Ties go to the longer last piece. Characters without a piece are spelt in byte pieces.

Path scores follow the model's type:

* unigram: the sum of the pieces' scores; a character without a piece costs the lowest score less 10.
* BPE, where scores are the ranks of merges: a step from one piece to the next has the score 0 if the two,
  merged in rank order, would stay two pieces, and minus infinity if not. A segmentation all of whose steps
  are of the first kind is what the merges reach, and there is just one, so the ids are those of
  the library. Whether a pair stays apart is read off the two pieces' last merges, undone one by one
  (stays_apart), and the answers for pairs met before come from a bounded table; pieces that the merges
  cannot reach are no candidates. Every beginning of a word has such a segmentation, so no position is out of reach.

Null and empty texts have no tokens. U+2581 in a text is read as a space, as the library does.
Extra columns pass through unless they are named tokens or n_tokens. Rows are encoded alone,
so ties and repeated rows cannot matter. A word of any length is searched in blocks of positions: what grows with it
are its characters, their hashes and backpointers (about 30 bytes for each character).
"""

from __future__ import annotations

import itertools
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import mapped

#: The model file; spark.gravelbed.pieces.model names another one.
MODEL, MODEL_CONF = "/opt/tokenizers/piece_bpe_32k.model", "spark.gravelbed.pieces.model"
#: Words in a worker's cache beyond which it starts afresh, positions searched and texts encoded at once. They bound
#: what a worker holds besides the model: over sf0.1 in a process of its own, 85 MB (130 MB at twice these numbers).
CACHE, POSITIONS, TEXTS = 100_000, 50_000, 512
SPACE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
NONE = -1


#: Bits of the places in the hash tables of keys, and in the table of the pairs of pieces met before.
PLACES, SEAMS = 20, 19


class Sieve(NamedTuple):
    """A hash table of keys; keys of one place are chained."""

    first: np.ndarray  # of each place, the row of a key, NONE where there is none
    after: np.ndarray  # of each key, the row of another one of its place, or NONE


def _place(keys: np.ndarray, bits: int = PLACES) -> np.ndarray:
    return (keys.view(np.uint64) * BASE >> np.uint64(64 - bits)).view(np.int64)


def _sieve(keys: np.ndarray) -> Sieve:
    place, first, after = _place(keys), np.full(1 << PLACES, NONE, np.int32), np.full(len(keys), NONE, np.int32)
    order = np.argsort(place, kind="stable")
    same = place[order[1:]] == place[order[:-1]]
    after[order[:-1][same]] = order[1:][same]
    heads = order[np.concatenate([[True], ~same])[: len(order)]]
    first[place[heads]] = heads
    return Sieve(first, after)


def _found(keys: np.ndarray, sieve: Sieve, probe: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the probes (flat) are keys, and their rows among the keys."""
    row = sieve.first[_place(probe)]
    which = np.flatnonzero(row >= 0)
    row, sought = row[which], probe[which]
    while len(other := np.flatnonzero((row >= 0) & (keys[row] != sought))):
        row[other] = sieve.after[row[other]]
    hit = row >= 0
    return which[hit], row[hit]


class Merges(NamedTuple):
    """Merges of a BPE model over its pieces."""

    rank: np.ndarray  # of the merge that makes a piece; pieces of one score share a rank, and there the leftmost merge comes first
    left: np.ndarray  # what the last merge of a piece joined; itself for a character
    right: np.ndarray
    pairs: np.ndarray  # sorted left * 2^32 + right of all pairs that join to a piece
    joined: np.ndarray  # the rank of each of them
    sieve: Sieve


class Pieces(NamedTuple):
    """A model as arrays; bounded by its vocabulary, so it travels with the tasks."""

    keys: np.ndarray  # sorted hashes of the candidates
    sieve: Sieve
    at: np.ndarray  # their places in the arrays below
    codes: np.ndarray  # code points of each piece, zeros behind them
    ids: np.ndarray
    scores: np.ndarray
    longest: int
    unknown: float
    spelt: list[int]  # id of each byte's piece
    raw: list[bytes]  # what each id decodes to
    prefix: bool
    cut: bool  # no piece has a line feed, so texts may be cut there
    merges: Merges | None  # of a BPE model


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial prefix hashes of rows of code points, one column more than codes."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = out[:, i] * BASE + codes[:, i].astype(np.uint64) + np.uint64(1)
    return out


def merged(piece: str, rank: dict[str, int]) -> tuple[list[str], tuple[str, str] | None]:
    """What is left of a string's characters after all merges, lowest rank and leftmost first, and the last merge."""
    parts, last = list(piece), None
    while True:
        best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank), default=None)
        if best is None:
            return parts, last
        i = best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def _merges(pieces: list[str], scores: np.ndarray) -> tuple[Merges, np.ndarray]:
    """The merges of a model's pieces, and which pieces they reach."""
    place = {p: i for i, p in enumerate(pieces)}
    ranks = np.unique(-scores, return_inverse=True)[1]
    rank = {p: int(r) for p, r in zip(pieces, ranks, strict=True) if len(p) > 1}
    left, right, reached = np.arange(len(pieces)), np.arange(len(pieces)), np.ones(len(pieces), bool)
    for i, p in enumerate(pieces):
        if len(p) > 1:
            parts, last = merged(p, rank)
            reached[i] = len(parts) == 1
            if reached[i]:
                left[i], right[i] = place[last[0]], place[last[1]]
    cuts = sorted((place[p[:k]] << 32 | place[p[k:]], rank[p]) for p in rank for k in range(1, len(p)) if p[:k] in place and p[k:] in place)
    pairs = np.array([c for c, _ in cuts], np.int64)
    return Merges(ranks, left, right, pairs, np.array([r for _, r in cuts], np.int64), _sieve(pairs)), reached


def stays_apart(m: Merges, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For pairs of neighbouring pieces (NONE: a character without one), whether the merges leave them two.

    Merges are undone at the seam, latest first. If what then stands on both sides of it could have joined
    before the merge last undone, the pair would not have come about."""
    out = np.ones(len(one), bool)
    row = np.flatnonzero((one >= 0) & (two >= 0))
    a, b = one[row].astype(np.int64), two[row].astype(np.int64)
    limit = np.full(len(row), np.iinfo(np.int64).max)  # twice the rank of the merge undone, plus 1 if on the right
    while len(row):
        which, at = _found(m.pairs, m.sieve, a << 32 | b)
        bad = np.zeros(len(row), bool)
        # on equal ranks the left one of two merges comes first
        bad[which] = 2 * m.joined[at] < limit[which]
        out[row[bad]] = False
        inner_a, inner_b = m.left[a] != a, m.left[b] != b
        on_left = inner_a & ((m.rank[a] > m.rank[b]) | ~inner_b)
        go = ~bad & (inner_a | inner_b)
        limit = np.where(on_left, 2 * m.rank[a], 2 * m.rank[b] + 1)[go]
        a, b, row = np.where(on_left, m.right[a], a)[go], np.where(on_left, b, m.left[b])[go], row[go]
    return out


class Seams:
    """stays_apart with a bounded memory: pairs of pieces repeat far more often than words do."""

    def __init__(self, m: Merges):
        self.m, self.met = m, np.full(1 << SEAMS, NONE, np.int64)  # twice the pair, plus its answer

    def apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        pair = one.astype(np.int64) << 32 | two
        at = _place(pair, SEAMS)
        met = self.met[at]
        out, new = (met & 1).astype(bool), np.flatnonzero(met >> 1 != pair)
        if len(new):
            out[new] = stays_apart(self.m, one[new], two[new])
            self.met[at[new]] = pair[new] << 1 | out[new]
        return out


def load(path: str = MODEL) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    raw, spelt, plain = [b""] * size, [-1] * 256, []
    for i in range(size):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            spelt[int(piece[3:-1], 16)] = i
            raw[i] = bytes([int(piece[3:-1], 16)])
        elif model.is_unknown(i):
            raw[i] = " ⁇ ".encode()
        elif not model.is_control(i):
            raw[i] = piece.replace(SPACE, " ").encode()
            plain.append((piece, i, model.get_score(i)))
    if min(spelt) < 0:
        raise ValueError("the model has no byte pieces")
    if any(SPACE in p.lstrip(SPACE) for p, *_ in plain):
        raise ValueError("the model has pieces that span words")
    scores = np.array([s for *_, s in plain])
    ranked = bool((scores <= 0).all() and (scores == np.floor(scores)).all())
    merges, reached = _merges([p for p, *_ in plain], scores) if ranked else (None, np.ones(len(plain), bool))
    longest = max(len(p) for p, *_ in plain)
    codes = np.zeros((len(plain), longest), np.uint32)
    for row, (p, *_) in zip(codes, plain, strict=True):
        row[: len(p)] = [*map(ord, p)]
    keys = np.array([_prefix_hashes(np.array([[*map(ord, p)]], np.uint32))[0, -1] for p, *_ in plain], np.uint64)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two pieces have the same key")
    order = np.argsort(keys)
    order = order[reached[order]]
    prefix = bool(model.encode("a")[:1] != [model.piece_to_id("a")])
    return Pieces(keys[order], _sieve(keys[order]), order, codes, np.array([i for _, i, _ in plain], np.int32), scores, longest, float(scores.min()) - 10.0, spelt, raw, prefix, not any("\n" in p for p, *_ in plain), merges)


def named(spark) -> Pieces:
    """The model that the session names."""
    return load(spark.conf.get(MODEL_CONF, MODEL))


def _candidates(p: Pieces, codes: np.ndarray, hashes: np.ndarray, powers: np.ndarray, first: int, stop: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each end from first to stop, the pieces that end there: rows, sizes and pieces, short ones first."""
    rows, ends, sizes, pieces = [], [], [], []
    text, spelling, width = codes.ravel(), p.codes.ravel(), p.codes.shape[1]
    for size in range(1, len(powers)):
        low = max(first, size)
        if low >= stop:
            break
        probe = hashes[:, low:stop] - hashes[:, low - size : stop - size] * powers[size]
        which, at = _found(p.keys, p.sieve, probe.ravel())
        row = which // (stop - low)
        end, piece = which - row * (stop - low) + low, p.at[at]
        begin, spelt = row * codes.shape[1] + end - size, piece * width
        same = np.ones(len(row), bool)
        for k in range(size):
            same &= text[begin + k] == spelling[spelt + k]
        if size < width:
            same &= spelling[spelt + size] == 0
        for column, x in ((rows, row), (ends, end), (pieces, piece)):
            column.append(x[same] if not same.all() else x)
        sizes.append(np.full(len(rows[-1]), size))
    row, end, size, piece = map(np.concatenate, (rows, ends, sizes, pieces))
    order = np.argsort((end - first).astype(np.uint16) if stop - first < 1 << 16 else end, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(end - first, minlength=stop - first))])
    row, size, piece = row[order], size[order], piece[order]
    return [(row[i:j], size[i:j], piece[i:j]) for i, j in itertools.pairwise(cuts.tolist())]


def viterbi(p: Pieces, codes: np.ndarray, seams: Seams | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Best pieces of words of equal length (rows of code points): piece ids row by row, -1 - code
    point for a character without a piece, and the number of them in each row."""
    n, length = codes.shape
    longest = min(p.longest, length)
    hashes, powers = _prefix_hashes(codes), _powers(longest)
    back, last = np.ones((n, length + 1), np.int16), np.full((n, length + 1), NONE, np.int32)
    best = np.full((n, longest), -np.inf)  # scores of the positions from end - longest on
    best[:, -1] = 0.0
    seams = seams or (p.merges and Seams(p.merges))
    rows, block = np.arange(n), max(1, POSITIONS // n)
    for first in range(1, length + 1, block):
        stop = min(first + block, length + 1)
        for end, (row, size, piece) in enumerate(_candidates(p, codes, hashes, powers, first, stop), first):
            if p.merges:
                apart = seams.apart(last[row, end - size], piece)
                row, size, piece = row[apart], size[apart], piece[apart]
                back[row, end], last[row, end] = size, piece
                continue
            here = np.full((n, longest), NONE, np.int32)
            here[row, longest - size] = piece
            sums = best + np.where(here >= 0, p.scores[here], -np.inf)
            alone = here[:, -1] == NONE
            sums[alone, -1] = best[alone, -1] + p.unknown
            way = sums.argmax(axis=1)
            back[:, end], last[:, end] = longest - way, here[rows, way]
            best = np.concatenate([best[:, 1:], sums[rows, way][:, None]], axis=1)
    steps, at, live = [], np.full(n, length), rows
    while len(live):
        piece = last[live, at[live]]
        steps.append((live, np.where(piece == NONE, -1 - codes[live, at[live] - 1].astype(np.int64), p.ids[piece])))
        at[live] -= back[live, at[live]]
        live = live[at[live] > 0]
    row = np.concatenate([r for r, _ in reversed(steps)])
    ids = np.concatenate([i for _, i in reversed(steps)]).astype(np.int32)
    order = np.argsort(row, kind="stable")
    return ids[order], np.bincount(row, minlength=n)


class Encoder:
    """Encodes lists of texts; words met before come from the cache."""

    def __init__(self, pieces: Pieces):
        self.p, self.seams = pieces, pieces.merges and Seams(pieces.merges)
        ends = "\n" if pieces.cut else ""
        self.words = re.compile(f"{ends and chr(10) + '|'}{SPACE}*[^{SPACE}{ends}]+|{SPACE}+").findall
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}
        self.ids, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _add(self, words: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        ids, sizes = [], []
        for length, same in by_length.items():
            rows = max(1, POSITIONS // length)
            for at in range(0, len(same), rows):
                part = same[at : at + rows]
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), length)
                got, n = viterbi(self.p, codes, self.seams)
                if (got < 0).any():
                    spelt = [[self.p.spelt[b] for b in chr(-1 - i).encode("utf-8", "replace")] if i < 0 else [i] for i in got.tolist()]
                    row = np.repeat(np.repeat(np.arange(len(part)), n), [len(x) for x in spelt])
                    got, n = np.array([i for x in spelt for i in x], np.int32), np.bincount(row, minlength=len(part))
                ids.append(got)
                sizes.append(n)
                self.index.update(zip(part, itertools.count(len(self.index))))
        new = np.concatenate(sizes)
        base = len(self.ids) + np.concatenate([[0], np.cumsum(new)[:-1]])
        self.ids, self.starts, self.sizes = np.concatenate([self.ids, *ids]), np.concatenate([self.starts, base]), np.concatenate([self.sizes, new])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the number of each."""
        prefix = SPACE if self.p.prefix else ""
        found = [self.words(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        flat = [w for words in found for w in words]
        if len(self.index) > CACHE:
            self._reset()
        word = np.fromiter(map(self.index.get, flat, itertools.repeat(NONE)), np.int64, len(flat))
        new = np.flatnonzero(word == NONE)
        if len(new):
            unmet = [flat[i] for i in new.tolist()]
            self._add(list(dict.fromkeys(unmet)))
            word[new] = np.fromiter(map(self.index.__getitem__, unmet), np.int64, len(unmet))
        size = self.sizes[word]
        ends = np.cumsum(size)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.starts[word] - (ends - size), size)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in found])
        return self.ids[take], np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64)


def decode(p: Pieces, ids) -> str:
    """The text of a list of ids; an incomplete character decodes to U+FFFD."""
    raw = b"".join(map(p.raw.__getitem__, ids))
    return (raw[1:] if p.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int32()))


def encoded(docs: DataFrame, pieces: Pieces | None = None, text: str = "text") -> DataFrame:
    """docs with tokens (array of int) and n_tokens (long)."""
    p, keep = pieces or named(docs.sparkSession), [c for c in docs.columns if c not in ("tokens", "n_tokens")]
    own = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = StructType([*own.schema, StructField("tokens", ArrayType(IntegerType())), StructField("n_tokens", LongType())])

    def run(batches):
        encoder = Encoder(p)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                ids, sizes = encoder.encode([x or "" for x in part.column(text).to_pylist()])
                yield pa.record_batch([*part.columns, _lists(ids, sizes), pa.array(sizes)], names=[*keep, "tokens", "n_tokens"])

    return mapped(own, run, schema)


def decoded(rows: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """rows (with tokens) with a column decoded; null tokens decode to an empty text."""
    p, keep = pieces or named(rows.sparkSession), [c for c in rows.columns if c != "decoded"]
    own = rows.select(*(F.col(f"`{c}`") for c in keep))
    schema = StructType([*own.schema, StructField("decoded", StringType())])

    def run(batches):
        every = np.frombuffer(b"".join(p.raw), np.uint8)
        sizes = np.array([len(x) for x in p.raw], np.int64)
        starts = np.cumsum(sizes) - sizes
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                ids = part.column("tokens").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                counts = pc.fill_null(pc.list_value_length(part.column("tokens")), 0).to_numpy(zero_copy_only=False)
                size = sizes[ids]
                ends = np.concatenate([[0], np.cumsum(size)])
                raw = every[np.arange(ends[-1]) + np.repeat(starts[ids] - ends[:-1], size)].tobytes()
                cuts = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
                texts = [raw[i + (p.prefix and raw[i : i + 1] == b" " and i < j) : j].decode("utf-8", "replace") for i, j in zip(cuts, cuts[1:])]
                yield pa.record_batch([*part.columns, pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return mapped(own, run, schema)


def op9_pieces(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    p = named(spark)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    return decoded(encoded(docs, p), p).select("doc_id", "n_tokens", "tokens", same.alias("round_trip"))

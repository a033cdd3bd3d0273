"""SentencePiece encoding and decoding by vectorised merge rounds.

``encode`` gives the ids that the library gives for a BPE model with byte fallback, ``decode``
the text that the library gives for ids.  Both work on flat numpy arrays:

1. Texts are cut where no piece of the model can reach across: before a run of blanks.  Equal
   words of a chunk are encoded once.
2. The characters of all words lie in one symbol array, cut once more between neighbours that
   no piece holds side by side (segments).  A round looks up the rank of every pair of
   neighbours, takes the least rank of each segment, and merges its places at once, the
   leftmost first where they overlap.  Segments without a pair left are written out and
   the arrays are compacted.
3. The library merges one pair at a time.  That makes a difference only after a merge whose
   piece belongs to a pair of better rank, or whose rank other pieces share: of such pieces
   a round merges the leftmost place of a segment alone (``alone``).
4. Segments of more than ``LONG`` symbols would take too many rounds; they go through a queue
   of pairs, which gives the same symbols in linear memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neo.llm.common import arrow_schema, chunks, utf8

MODEL = "piece_bpe_32k.model"

#: Segments of more symbols are merged with a queue instead of rounds.
LONG = 512

#: Ids that are turned into text at a time, and words that are merged at a time.
IDS = 1 << 20

_BLANK = "▁"
_NONE = np.int32(2**31 - 1)
_REPLACEMENT = "�".encode()


class Pieces:
    """The tables of a SentencePiece BPE model.

    Symbols are the ids of the model followed by the characters that occur in pieces without
    being pieces themselves.  A model that the rounds cannot follow (another algorithm, a
    character map, user-defined or unused pieces) raises ``ValueError``."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if (model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces
                or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix
                or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces)):
            raise ValueError(f"{path}: not a plain BPE model without normalisation")
        self.prefix = spec.add_dummy_prefix
        self.n = len(model.pieces)
        known = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
        self.fallback = model.trainer_spec.byte_fallback

        symbols = {p: i for p, (i, _) in known.items()}
        for c in sorted({c for p in known for c in p} - set(symbols)):
            symbols[c] = self.n + len(symbols) - len(known)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.of_char[0x20] = self.of_char[ord(_BLANK)]
        self.width = self.n + len(symbols)

        # equal scores are one rank: the leftmost pair goes first
        best = {s: r for r, s in enumerate(sorted({s for _, s in known.values()}, reverse=True))}
        rank = {p: best[s] for p, (_, s) in known.items()}
        shared = np.bincount(list(rank.values()), minlength=len(best)) > 1
        pairs, beside, alone = {}, set(), {p for p, r in rank.items() if shared[r]}
        for p, r in rank.items():
            for a, b in zip(p, p[1:]):
                beside.add((symbols[a], symbols[b]))
            for k in range(1, len(p)):
                left, right = p[:k], p[k:]
                if left in symbols and right in symbols:
                    pairs[symbols[left] * self.width + symbols[right]] = (r, symbols[p])
                    alone.update(x for x in (left, right) if rank.get(x, -1) > r)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(2**62))
        self.ranks = np.append(np.array([pairs[k][0] for k in keys.tolist()], np.int32), _NONE)
        self.merged = np.append(np.array([pairs[k][1] for k in keys.tolist()], np.int32), np.int32(-1))
        self.beside = np.array(sorted(a * self.width + b for a, b in beside) + [2**62], np.int64)
        self.alone = np.zeros(len(best) + 1, bool)
        for p in alone:
            self.alone[rank[p]] = True
        #: Pieces hold blanks at their beginning only, so that words can be encoded one by one.
        self.by_word = not any(_BLANK in p.lstrip(_BLANK) for p in known)

        surface = []
        for p in model.pieces:
            if p.type == kinds.CONTROL:
                surface.append(b"")
            elif p.type == kinds.BYTE:
                surface.append(bytes([int(p.piece[3:5], 16)]))
            elif p.type == kinds.UNKNOWN:
                surface.append((model.trainer_spec.unk_surface or " ⁇ ").encode())
            else:
                surface.append(p.piece.replace(_BLANK, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(s) for s in surface])])
        types = np.array([p.type for p in model.pieces])
        self.is_byte, self.is_control = types == kinds.BYTE, types == kinds.CONTROL
        self.is_word = np.array([p.type == kinds.NORMAL and p.piece.startswith(_BLANK) for p in model.pieces])

    @classmethod
    def named(cls, model: str = MODEL) -> Pieces:
        """A model of the public tokenizers, or any other by its path."""
        return _load(model if "/" in model else public_tokenizers.path(model))

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; ``_NONE`` and -1 where no piece is formed."""
        key = left.astype(np.int64) * self.width + right
        at = np.searchsorted(self.keys, key)
        found = self.keys[at] == key
        return np.where(found, self.ranks[at], _NONE), np.where(found, self.merged[at], np.int32(-1))


@cache
def _load(path: str) -> Pieces:
    return Pieces(path)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``start, start + 1, ...`` of each run, one run after the other."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _merge_queue(symbols: np.ndarray, model: Pieces) -> np.ndarray:
    """Merge one long segment, the best and then leftmost pair first."""
    n = len(symbols)
    sym, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    keys = {}

    def look(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in keys:
            rank, merged = model.find(np.array([a]), np.array([b]))
            keys[a, b] = int(rank[0]), int(merged[0])
        return keys[a, b]

    rank, merged = model.find(symbols[:-1], symbols[1:])
    some = np.flatnonzero(merged >= 0)
    queue = list(zip(rank[some].tolist(), some.tolist(), symbols[some].tolist(), symbols[some + 1].tolist()))
    heapq.heapify(queue)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i]
        if sym[i] != a or j >= n or sym[j] != b:
            continue
        sym[i], sym[j] = look(a, b)[1], -1
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n:
                r, m = look(sym[x], sym[y])
                if m >= 0:
                    heapq.heappush(queue, (r, x, sym[x], sym[y]))
    found = np.array(sym, np.int32)
    return found[found >= 0]


def merge(symbols: np.ndarray, starts: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Final symbols of segments that begin at ``starts``, and how many each segment has."""
    sizes = np.diff(np.append(starts, len(symbols)))
    out_sizes = np.zeros(len(starts), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []  # segments, their symbols
    for s in np.flatnonzero(sizes > LONG):
        found = _merge_queue(symbols[starts[s]:starts[s] + sizes[s]], model)
        out_sizes[s] = len(found)
        done.append((np.array([s]), found))

    live = np.flatnonzero(sizes <= LONG)
    sym = symbols[_runs(starts[live], sizes[live])]
    sizes = sizes[live]

    def ranks() -> tuple[np.ndarray, np.ndarray]:
        rank, merged = np.full(len(sym), _NONE), np.full(len(sym), np.int32(-1))
        inner = np.ones(len(sym), bool)
        inner[np.cumsum(sizes) - 1] = False
        inner = np.flatnonzero(inner)
        rank[inner], merged[inner] = model.find(sym[inner], sym[inner + 1])
        return rank, merged

    rank, merged = ranks() if len(sym) else (np.empty(0, np.int32), np.empty(0, np.int32))
    while len(live):
        first = np.cumsum(sizes) - sizes
        least = np.minimum.reduceat(rank, first)
        over = least == _NONE
        if over.any():  # write out the finished segments and compact the others
            done.append((live[over], sym[_runs(first[over], sizes[over])]))
            out_sizes[live[over]] = sizes[over]
            rest = _runs(first[~over], sizes[~over])
            sym, rank, merged = sym[rest], rank[rest], merged[rest]
            live, sizes, least = live[~over], sizes[~over], least[~over]
            if not len(live):
                break
            first = np.cumsum(sizes) - sizes
        hits = np.flatnonzero(rank == np.repeat(least, sizes))
        segment = np.searchsorted(first, hits, "right") - 1
        head = np.ones(len(hits), bool)
        head[1:] = segment[1:] != segment[:-1]
        fresh = head.copy()
        fresh[1:] |= hits[1:] != hits[:-1] + 1
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
        use = (np.arange(len(hits)) - run) % 2 == 0  # the leftmost of overlapping places
        use &= head | ~model.alone[least[segment]]
        at, segment = hits[use], segment[use]
        sym[at] = merged[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sizes = sizes - np.bincount(segment, minlength=len(sizes))
        moved = (np.cumsum(keep) - 1)[at]
        sym, rank, merged = sym[keep], rank[keep], merged[keep]
        first = np.cumsum(sizes) - sizes
        last = first + sizes - 1
        left = moved[moved > first[segment]] - 1
        change = np.concatenate([left, moved])
        inner = np.ones(len(change), bool)
        inner[len(left):] = moved < last[segment]
        rank[change], merged[change] = _NONE, -1
        change = change[inner]
        rank[change], merged[change] = model.find(sym[change], sym[change + 1])

    order_sizes = np.cumsum(out_sizes) - out_sizes
    out = np.empty(int(out_sizes.sum()), np.int32)
    for segments, found in done:
        out[_runs(order_sizes[segments], out_sizes[segments])] = found
    return out, out_sizes


def encode_words(words: list[bytes], model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words (UTF-8, blanks as they are), and how many each word has; none is empty."""
    joined = b"".join(words).decode()
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(b"".join(words), np.uint8)
    first_byte = np.flatnonzero((data & 0xC0) != 0x80)
    begins = np.searchsorted(first_byte, np.cumsum([0] + [len(w) for w in words[:-1]]))
    symbols = model.of_char[chars]
    cut = np.ones(len(symbols), bool)
    key = symbols[:-1].astype(np.int64) * model.width + symbols[1:]
    cut[1:] = ((model.beside[np.searchsorted(model.beside, key)] != key)
               | (symbols[:-1] < 0) | (symbols[1:] < 0))
    cut[begins] = True
    starts = np.flatnonzero(cut)
    found, sizes = merge(symbols, starts, model)
    # characters that are no piece become the ids of their bytes
    odd = (found < 0) | (found >= model.n)
    counts = np.ones(len(found), np.int64)
    if odd.any():
        owner = np.repeat(np.arange(len(starts)), sizes)
        # such a character is a segment of its own or stands in one at its old place
        place = np.repeat(starts, sizes)[odd] + _inner(found, owner, odd, model)
        begin = first_byte[place]
        end = np.append(first_byte, len(data))[place + 1]
        if model.fallback:
            counts[odd] = end - begin
        ids = np.repeat(found, counts)
        spot = np.repeat(odd, counts)
        ids[spot] = (model.byte_ids[data[_runs(begin, end - begin)]] if model.fallback else model.unknown)
    else:
        ids = found
    per_segment = np.add.reduceat(counts, np.cumsum(sizes) - sizes)
    word = np.searchsorted(begins, starts, "right") - 1
    return ids, np.bincount(word, per_segment, minlength=len(words)).astype(np.int64)


def _inner(found: np.ndarray, owner: np.ndarray, odd: np.ndarray, model: Pieces) -> np.ndarray:
    """Characters of the same segment before each symbol that is no piece."""
    chars = np.ones(len(found), np.int64)
    whole = ~odd
    at = model.surface_at
    ids = found[whole]
    byte = (model.surface & 0xC0) != 0x80
    total = np.concatenate([[0], np.cumsum(byte)])
    chars[whole] = total[at[ids + 1]] - total[at[ids]]
    before = np.cumsum(chars) - chars
    head = np.searchsorted(owner, owner, "left")
    return (before - before[head])[odd]


def encode(data: np.ndarray, offsets: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts ``data[offsets[i]:offsets[i + 1]]`` and their offsets in the ids."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    lead = (lengths > 0).astype(np.int64) if model.prefix else np.zeros(n, np.int64)
    begins = offsets[:-1] + np.cumsum(lead) - lead
    padded = np.full(len(data) + int(lead.sum()), 32, np.uint8)
    text = np.ones(len(padded), bool)
    text[begins[lead > 0]] = False
    padded[text] = data
    if not len(padded):
        return np.empty(0, np.int32), np.zeros(n + 1, np.int64)
    cut = np.zeros(len(padded), bool)
    if model.by_word:
        blank = padded == 32
        cut[1:] = blank[1:] & ~blank[:-1]
    cut[begins[lengths > 0]] = True
    starts = np.flatnonzero(cut)
    bounds = np.append(starts, len(padded)).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(padded)])
    coded = words.dictionary_encode()
    distinct, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    ids, sizes = encode_words(distinct, model)
    first = np.cumsum(sizes) - sizes
    flat = ids[_runs(first[at], sizes[at])]
    upto = np.concatenate([[0], np.cumsum(sizes[at])])
    return flat, upto[np.searchsorted(starts, np.append(begins, len(padded)), "left")]


def _utf8_or_replaced(piece: bytes) -> bytes:
    """A run of byte pieces: each byte that is no part of a character becomes U+FFFD."""
    out, i = [], 0
    while i < len(piece):
        for size in (1, 2, 3, 4):
            try:
                piece[i:i + size].decode()
            except UnicodeDecodeError:
                continue
            if i + size <= len(piece):
                break
        else:
            out.append(_REPLACEMENT)
            i += 1
            continue
        out.append(piece[i:i + size])
        i += size
    return b"".join(out)


def _decode_one(ids: np.ndarray, model: Pieces) -> bytes:
    """Text of one list of ids whose bytes do not all form characters."""
    out, byte = [], model.is_byte[ids]
    edges = np.flatnonzero(np.diff(byte)) + 1
    for part in np.split(np.arange(len(ids)), edges):
        piece = model.surface[_runs(model.surface_at[ids[part]], np.diff(model.surface_at)[ids[part]])].tobytes()
        out.append(_utf8_or_replaced(piece) if byte[part[0]] else piece)
    return b"".join(out)


def decode(ids: np.ndarray, offsets: np.ndarray, model: Pieces) -> list[bytes]:
    """Text (UTF-8) of each list ``ids[offsets[i]:offsets[i + 1]]``."""
    if len(ids) and not (0 <= ids.min() and ids.max() < model.n):
        raise ValueError("an id is not in the vocabulary")
    lengths = np.diff(model.surface_at)[ids]
    data = model.surface[_runs(model.surface_at[ids], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])[offsets]
    begins = ends[:-1].copy()
    if model.prefix:  # the blank that encoding puts before a text
        shown = np.flatnonzero(~model.is_control[ids])
        at = np.searchsorted(shown, offsets[:-1])
        some = np.flatnonzero(at < np.searchsorted(shown, offsets[1:]))
        begins[some] += model.is_word[ids[shown[at[some]]]]
    raw = data.tobytes()
    out = [raw[a:b] for a, b in zip(begins.tolist(), ends[1:].tolist())]
    try:
        raw.decode()
    except UnicodeDecodeError:
        pass
    else:
        return out
    for i, text in enumerate(out):
        try:
            text.decode()
        except UnicodeDecodeError:
            skip = int(begins[i] - ends[i])
            out[i] = _decode_one(ids[offsets[i]:offsets[i + 1]], model)[skip:]
    return out


def _encoded(batches: Iterator[pa.RecordBatch], name: str, schema: pa.Schema):
    model = Pieces.named(name)
    for batch in batches:
        texts = pc.replace_substring(batch.column(batch.num_columns - 1), _BLANK, " ")
        data, offsets = utf8(texts)
        for a, b in chunks(offsets):
            ids, at = encode(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], model)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)), lists], schema=schema)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row per input row: ``doc_id, ids``, without begin or end ids.

    Defined results: a null or empty text has no ids; rows that repeat, null ids and further
    columns change nothing; an empty table gives an empty result.  Nothing is shuffled."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ddl = f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>"
    schema = arrow_schema(ddl)
    return texts.mapInArrow(lambda it: _encoded(it, model, schema), ddl)


def _decoded(batches: Iterator[pa.RecordBatch], name: str, schema: pa.Schema):
    model = Pieces.named(name)
    for batch in batches:
        lists = batch.column(1)
        absent = pc.is_null(lists).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())])
        ids = lists.flatten().to_numpy().astype(np.int64)
        for a, b in chunks(offsets, IDS):
            texts = decode(ids[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], model)
            text = pa.array(texts, pa.binary(), mask=absent[a:b]).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists.slice(a, b - a), text],
                                             schema=schema)


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """One row per input row: ``doc_id, ids, text``.

    Defined results: no ids give an empty text, null ids null; begin and end ids give nothing,
    bytes that form no character U+FFFD each; an id outside the vocabulary raises."""
    lists = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    ddl = f"doc_id {lists.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string"
    schema = arrow_schema(ddl)
    return lists.mapInArrow(lambda it: _decoded(it, model, schema), ddl)

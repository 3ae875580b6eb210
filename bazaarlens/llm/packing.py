"""Packing of tokenised examples into fixed-length training sequences by vector bin packing.

Each example has a demand in three dimensions: tokens, segments (1 per piece) and loss-bearing tokens. Bins are filled one
at a time: among the examples that fit, the one with the largest dot product of its demand with the bin's residual (each
dimension weighted by its share of total demand) goes in. If none fits any more, the longest waiting example is cut to fill
the rest. Every task packs its own rows, in windows of bounded size; what does not fill a bin moves to the next window.
The last bin of a task is cut into pieces whose lengths are powers of two, so it needs no padding.

A null text is empty and still has its end id; repeated rows are packed once each; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaarlens.llm.common import Memory, load_tokenizer, slices, text_or_empty

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
# Punctuation that may follow a word, the letters below U+0100, and about how many bytes of words a task remembers in each generation.
TAIL, LETTERS, MEMORY = ".,;:!?", "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$", 72_000_000


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold."""

    tokens: int = 4096
    segments: int = 128
    loss_tokens: int = 4096


@dataclass
class Example:
    """A waiting piece: ids not yet placed, where they start in the document, how many leading ids bear no loss."""

    doc: object
    ids: np.ndarray
    start: int
    doc_tokens: int
    prompt: int

    def loss(self, length: int) -> int:
        return max(0, min(length, len(self.ids)) - self.prompt)


def make_encoder(path: str, end_id: int):
    """A function from an Arrow array of texts to arrays of ids (end id last), equal to the library's on whole texts.

    The tokenizer drops white space and never joins words across it, so the distinct chunks between blanks and line feeds
    are encoded alone, and their ids are laid out by number. A text with a chunk that holds any other white space or unprintable
    character is encoded whole.
    Letters and a tail of punctuation are separate words for it too, and it folds case, so chunks share their stems;
    stems and tails are remembered in bounded memory. Stems of letters only are encoded many at a time and told apart by the
    mark that ends a word.
    """
    tokenizer = load_tokenizer(path)
    ends_word = np.zeros(tokenizer.get_vocab_size(), dtype=bool)
    ends_word[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    known = Memory(MEMORY)

    def encode(texts):
        return [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(pieces):
        stems, alone = [], []
        for piece in pieces:
            (stems if piece.isalpha() and (piece.isascii() or max(piece) < "\u0100") else alone).append(piece)
        known.put(alone, [ids.tobytes() for ids in encode(alone)])
        for start in range(0, len(stems), 4096):
            some = stems[start : start + 4096]
            ids = np.concatenate(encode([" ".join(some[i : i + 64]) for i in range(0, len(some), 64)]))
            stops = (np.flatnonzero(ends_word[ids]) + 1) * 4
            if len(stops) == len(some) and stops[-1] == ids.nbytes:
                raw = ids.tobytes()
                stops = stops.tolist()
                known.put(some, [raw[begin:stop] for begin, stop in zip([0, *stops], stops)])
            else:
                known.put(some, [ids.tobytes() for ids in encode(some)])

    def ids_of_chunks(distinct):
        """Raw ids of each distinct chunk, and the places of those that only a whole text can tell."""
        letters = pc.utf8_rtrim(distinct, TAIL)
        plain = pc.match_substring_regex(letters, LETTERS).to_numpy(zero_copy_only=False)
        cut = (pc.binary_length(distinct).to_numpy() - pc.binary_length(letters).to_numpy()).astype(np.int64)
        stems = pc.utf8_lower(pc.if_else(pa.array(plain), letters, "")).to_numpy(zero_copy_only=False)
        rest = np.flatnonzero(~plain)
        alone = distinct.take(pa.array(rest)).to_numpy(zero_copy_only=False)
        seen = np.fromiter(map(str.isprintable, alone), bool, len(alone))
        stems[rest] = np.where(seen, alone, "")
        tailed = np.flatnonzero(plain & (cut > 0))
        ends = distinct.take(pa.array(tailed)).to_numpy(zero_copy_only=False).tolist()
        tails = [chunk[-k:] for chunk, k in zip(ends, cut[tailed].tolist(), strict=True)]
        stems = stems.tolist()
        learn(known.missing({*stems, *tails}))
        ids = known.young
        raw = list(map(ids.__getitem__, stems))
        for i, tail in zip(tailed.tolist(), tails, strict=True):
            raw[i] += ids[tail]
        return raw, rest[~seen]

    def ids_of(texts):
        # a copy whose offsets begin at 0, as for `split_words`
        texts = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([], pa.large_string())])
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        chunks = cut.flatten().dictionary_encode()
        raw, whole = ids_of_chunks(chunks.dictionary)
        # the end is one more chunk after each text
        last = np.asarray(cut.offsets)[1:] - cut.offsets[0].as_py()
        place = np.insert(chunks.indices.to_numpy(), last, len(raw))
        stop = last + np.arange(1, len(last) + 1)
        pool = np.frombuffer(b"".join(raw) + np.array([end_id], "<u4").tobytes(), "<u4")
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        size = np.append(size, 1)
        begin = np.cumsum(size) - size
        length = size[place]
        after = np.cumsum(length)
        ids = pool[np.repeat(begin[place] - (after - length), length) + np.arange(after[-1] if len(after) else 0)]
        ends = after[stop - 1].tolist()
        # copies, so that a waiting example holds no more than its own ids
        out = [ids[start:end].copy() for start, end in zip([0, *ends], ends)]
        if len(whole):
            odd = np.unique(np.searchsorted(stop, np.flatnonzero(np.isin(place, whole)), side="right"))
            for i, found in zip(odd.tolist(), encode(texts.take(pa.array(odd)).to_pylist()), strict=True):
                out[i] = np.append(found, np.array(end_id, "<u4"))
        return out

    return ids_of


class VectorPacker:
    """Streaming packer of one task; `add` and `finish` give pieces (example, length, sequence number, offset)."""

    def __init__(self, limits: Limits, window: int = 1024, least_cut: int = 16):
        self.limits, self.window, self.least_cut = limits, window, least_cut
        self.waiting: list[Example] = []
        self.sequences = 0

    def add(self, example: Example):
        full = min(self.limits.tokens, self.limits.loss_tokens)
        while len(example.ids) >= full:
            yield self.take(example, full, self.sequences, 0)
            self.sequences += 1
        if len(example.ids):
            self.waiting.append(example)
        if len(self.waiting) >= self.window:
            yield from self.pack(last=False)

    def finish(self):
        yield from self.pack(last=True)

    def take(self, example: Example, length: int, sequence: int, offset: int):
        """Place the first `length` ids; the example keeps the rest."""
        piece = (Example(example.doc, example.ids[:length], example.start, example.doc_tokens, example.prompt), sequence, offset)
        example.ids = example.ids[length:]
        example.start += length
        example.prompt = max(0, example.prompt - length)
        return piece

    def pack(self, last: bool):
        pool = self.waiting
        demand = np.array([[len(e.ids), 1, e.loss(len(e.ids))] for e in pool], dtype=np.float64).reshape(-1, 3)
        capacity = np.array([self.limits.tokens, self.limits.segments, self.limits.loss_tokens], dtype=np.float64)
        alive = np.ones(len(pool), dtype=bool)
        total = demand.sum(axis=0)
        while alive.any() and (last or (total >= capacity)[[0, 2]].any() or total[1] >= max(capacity[1], self.window // 2)):
            weight = total / max(total.sum(), 1) / capacity**2
            bin_of, residual = [], capacity.copy()
            while alive.any() and (residual > 0).all():
                fits = alive & (demand <= residual).all(axis=1)
                if fits.any():
                    chosen = int(np.argmax(np.where(fits, demand @ (weight * residual), -1.0)))
                    length = int(demand[chosen, 0])
                else:
                    chosen = int(np.argmax(np.where(alive, demand[:, 0], -1.0)))
                    length = int(min(residual[0], residual[2] + pool[chosen].prompt))
                    if length < self.least_cut:
                        break
                used = np.array([length, 1, pool[chosen].loss(length)], dtype=np.float64)
                bin_of.append((chosen, length))
                residual -= used
                left = demand[chosen] - used + [0, 1, 0]
                if left[0] <= 0:
                    alive[chosen] = False
                    total -= demand[chosen]
                else:
                    total -= demand[chosen] - left
                demand[chosen] = left
                if left[0] > 0:
                    break  # the cut has filled the bin
            if not bin_of:
                break
            yield from self.lay_out(pool, bin_of, powers=last and not alive.any())
        self.waiting = [e for e, live in zip(pool, alive, strict=True) if live]

    def lay_out(self, pool, bin_of, powers: bool):
        """Offsets inside one bin; with `powers` the bin is cut into sequences of 2^k ids."""
        rest = sum(length for _, length in bin_of)
        room = 1 << (rest.bit_length() - 1) if powers else rest
        offset = 0
        for chosen, length in bin_of:
            while length:
                part = min(length, room - offset)
                yield self.take(pool[chosen], part, self.sequences, offset)
                length, offset, rest = length - part, offset + part, rest - part
                if offset == room:
                    self.sequences += 1
                    offset, room = 0, 1 << (rest.bit_length() - 1) if rest else 0


def pack_sequences(
    docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int = 2, prompt: str | None = None
) -> DataFrame:
    """Pieces of all rows of `docs` (doc_id, text): where each lies in its document and in its sequence.

    `prompt` names a text column that goes before the text and bears no loss; without it all ids bear loss. Needs no
    shuffle: each task packs what it reads. Sequence ids are unique over all tasks.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("all limits must be at least 1")

    def pack(batches):
        packer = VectorPacker(limits)
        ids_of = make_encoder(tokenizer, end_id)
        base = TaskContext.get().partitionId() << 36

        def rows(pieces):
            pieces = list(pieces)
            columns = [
                [p.doc for p, _, _ in pieces], [p.start for p, _, _ in pieces], [len(p.ids) for p, _, _ in pieces],
                [zlib.crc32(p.ids.tobytes()) for p, _, _ in pieces], [p.doc_tokens for p, _, _ in pieces],
                [base + s for _, s, _ in pieces], [o for _, _, o in pieces], [p.loss(len(p.ids)) for p, _, _ in pieces],
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [f.split()[0] for f in PIECES.split(", ")])

        for part in slices(batches, 2048, 2_000_000):
            keys = part.column("doc_id").to_pylist()
            texts, heads = ids_of(part.column("content")), [0] * len(keys)
            if prompt:
                before = [h[:-1] for h in ids_of(part.column("head"))]
                texts, heads = [np.concatenate(pair) for pair in zip(before, texts, strict=True)], [len(h) for h in before]
            made = (packer.add(Example(k, t, 0, len(t), h)) for k, t, h in zip(keys, texts, heads, strict=True))
            yield rows(chain.from_iterable(made))
        yield rows(packer.finish())

    columns = [F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("content")]
    if prompt:
        columns.append(text_or_empty(prompt).alias("head"))
    return docs.select(*columns).mapInArrow(pack, PIECES)

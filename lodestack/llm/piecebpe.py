"""SentencePiece BPE encoding and decoding with numpy merge rounds."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestack.llm import flat
from lodestack.llm.spantable import SpanTable, kept, lists

NONE = np.iinfo(np.int32).max
#: The mark that stands for a space in pieces.
MARK = "▁"
#: Characters of a block of a long span: a word has no more rounds of merges than characters.
BLOCK = 40


def _fields(raw: bytes) -> dict[int, object]:
    """Numbers and bytes of one protobuf message by field; the last of a field counts."""
    out, at = {}, 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            out[key >> 3] = number()
        else:
            size = number() if kind == 2 else 8 if kind == 1 else 4
            out[key >> 3], at = raw[at : at + size], at + size
    return out


def check_model(proto: bytes) -> None:
    """Raises unless the model is a BPE one that leaves texts as they are but for a space in front of them."""
    model = _fields(proto)
    trainer, normal = _fields(model.get(2, b"")), _fields(model.get(3, b""))
    # fixed values: the format's field numbers and its defaults
    kind, table, prefix, squeeze, marks = trainer.get(3, 1), normal.get(2, b""), normal.get(3, 1), normal.get(4, 1), normal.get(5, 1)
    if kind != 2:
        raise ValueError("The model is no BPE model")
    if table or squeeze or not prefix or not marks or trainer.get(24, 0):
        raise ValueError("The model's normaliser changes texts in ways that are not implemented")


class Model:
    """Tables of a BPE model with byte fallback, an identity normaliser and a space put before the text."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(sp.serialized_model_proto())
        self.n, self.end = sp.get_piece_size(), sp.eos_id()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(self.n)]
        pieces = {sp.id_to_piece(i): i for i in range(self.n) if not special[i]}
        if any(sp.is_unused(i) for i in pieces.values()) or self.end < 0:
            raise ValueError("Models with unused pieces or without an end id are not implemented")
        chars = sorted({c for p in pieces for c in p})
        beyond = {c: self.n + k for k, c in enumerate(x for x in chars if x not in pieces)}  # stand in pieces, but are none
        self.of_char = np.full(0x110000, -1, np.int32)
        for c in chars:
            self.of_char[ord(c)] = pieces.get(c, beyond.get(c))
        self.size = self.n + len(beyond) + 1
        order = sorted(pieces.values(), key=lambda i: -sp.get_score(i))
        rank = np.full(self.size, NONE, np.int32)
        rank[order] = np.arange(len(order))
        known = pieces | beyond
        merges = sorted((known[p[:k]] * self.size + known[p[k:]], i) for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in known and p[k:] in known)
        self.pair = np.array([m[0] for m in merges], np.int64)
        self.made = np.array([m[1] for m in merges], np.int32)
        self.rank = rank
        # A piece from which a better-ranked one can be made must not be merged everywhere at once.
        best = np.full(self.size, NONE, np.int32)
        np.minimum.at(best, self.pair // self.size, rank[self.made])
        np.minimum.at(best, self.pair % self.size, rank[self.made])
        self.by_rank = np.array(order, np.int32)
        self.alone = best[self.by_rank] < np.arange(len(order))
        self.byte = np.array([next((i for i in range(self.n) if sp.id_to_piece(i) == f"<0x{b:02X}>"), sp.unk_id()) for b in range(256)], np.int32)
        # ASCII characters that stand side by side in no piece: the text can be cut between them.
        self.apart = np.zeros((256, 256), bool)
        self.apart[:128, :128] = True
        for p in pieces:
            q = p.replace(MARK, " ")
            for a, b in zip(q, q[1:]):
                if max(a, b) < "\x80":
                    self.apart[ord(a), ord(b)] = False
        self.apart[128:, 32] = not any(MARK in p.lstrip(MARK) for p in pieces)
        # For decoding: bytes of every id, flat.
        said = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(MARK, " ").encode() for i in range(self.n)]
        self.plain = np.array([not sp.is_unknown(i) for i in range(self.n)])
        self.text = np.frombuffer(b"".join(said), np.uint8)
        self.text_at = np.concatenate(([0], np.cumsum([len(x) for x in said])))
        self.table = SpanTable(self.merge)

    def _ranks(self, sym: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of the piece that each symbol makes with the next one of its word."""
        out = np.full(len(sym), NONE, np.int32)
        near = np.flatnonzero((word[:-1] == word[1:]) & (sym[:-1] >= 0) & (sym[1:] >= 0))
        key = sym[near].astype(np.int64) * self.size + sym[near + 1]
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        out[near[hit]] = self.rank[self.made[at[hit]]]
        return out

    def _rounds(self, sym: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and symbols of the tokens of words, flat: sym has a symbol per character, starts where each word starts.

        Each round finds every word's best-ranked pair, merges its places from the left where they
        don't overlap, and closes the gaps; words without a pair are put aside.
        """
        sym = sym.copy()
        word = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(sym))))
        at, rank = np.arange(len(sym)), self._ranks(sym, word)
        done_at, done_sym = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            count = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            best = np.repeat(least, count)
            over = best == NONE
            if over.any():
                done_at.append(at[over])
                done_sym.append(sym[over])
                sym, word, at, rank, best = (x[~over] for x in (sym, word, at, rank, best))
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == best)
            new_run = np.concatenate(([True], np.diff(hits) != 1))
            start = np.maximum.accumulate(np.where(new_run, np.arange(len(hits)), 0))
            take = (np.arange(len(hits)) - start) % 2 == 0
            new_word = np.concatenate(([True], word[hits][1:] != word[hits][:-1]))
            take &= new_word | ~self.alone[best[hits]]
            hits = hits[take]
            sym[hits] = self.by_rank[best[hits]]
            keep = np.ones(len(sym), bool)
            keep[hits + 1] = False
            moved = np.cumsum(keep) - 1
            sym, word, at, rank = (x[keep] for x in (sym, word, at, rank))
            spot = moved[hits]
            for side in (np.maximum(spot - 1, 0), spot):  # only pairs with a new symbol have changed
                right = np.minimum(side + 1, len(sym) - 1)
                ok = (word[side] == word[right]) & (side != right) & (sym[side] >= 0) & (sym[right] >= 0)
                key = sym[side].astype(np.int64) * self.size + sym[right]
                found = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
                ok &= self.pair[found] == key
                rank[side] = np.where(ok, self.rank[self.made[found]], NONE)
        at, sym = np.concatenate(done_at), np.concatenate(done_sym)
        order = np.argsort(at, kind="stable")
        return at[order], sym[order]

    def _holds(self, at: np.ndarray, sym: np.ndarray, right: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Whether the token before each token of right and that token stay two when their characters are merged alone."""
        key = sym[right - 1].astype(np.int64) * self.size + sym[right]
        _, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        low, mid = at[right[one] - 1], at[right[one]]
        size = np.append(at, len(chars))[right[one] + 1] - low
        starts = np.cumsum(size) - size
        tokens, _ = self._rounds(chars[flat.ranges(low, size)], starts)
        first = np.searchsorted(tokens, starts)
        two = np.diff(np.append(first, len(tokens))) == 2
        two[two] = tokens[first[two] + 1] == (starts + mid - low)[two]
        none = (sym[right - 1] < 0) | (sym[right] < 0)  # characters in no piece
        return none | two[inverse]

    def _joined(self, at: np.ndarray, sym: np.ndarray, chars: np.ndarray, seams: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of whole spans from those of their blocks.

        Two neighbouring strings whose tokens are known have those tokens, too, when they are one string,
        just if the last token of one and the first of the other stay apart when merged alone: until a
        first merge over the seam either side goes its own way, and that merge would be made between those
        two tokens as well. Where they don't stay apart, a few tokens around the seam are merged anew as
        one string, twice as many each time, and the seams to the left and right of them are looked at.
        """
        reach = 2
        while len(seams):
            right = np.searchsorted(at, seams)
            right = right[~self._holds(at, sym, right, chars)]
            if not len(right):
                break
            span = np.searchsorted(bounds, at[right], "right") - 1
            low = np.maximum(right - reach, np.searchsorted(at, bounds[span]))
            high = np.minimum(right + reach, np.searchsorted(at, bounds[span + 1]))
            group = np.flatnonzero(np.concatenate(([True], low[1:] > np.maximum.accumulate(high)[:-1])))
            low, high = low[group], np.maximum.reduceat(high, group)
            a, b = at[low], np.append(at, len(chars))[high]
            starts = np.cumsum(b - a) - (b - a)
            new_at, new_sym = self._rounds(chars[flat.ranges(a, b - a)], starts)
            new_at = new_at + (a - starts)[np.searchsorted(starts, new_at, "right") - 1]
            keep = np.ones(len(at), bool)
            keep[flat.ranges(low, high - low)] = False
            at, sym = np.concatenate((at[keep], new_at)), np.concatenate((sym[keep], new_sym))
            order = np.argsort(at, kind="stable")
            at, sym = at[order], sym[order]
            seams = np.setdiff1d(np.concatenate((a, b)), bounds)
            reach *= 2
        return at, sym

    def merge(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every span, flat, and how many each has. Long spans are merged in blocks, so that rounds stay few."""
        said = [s.decode() for s in spans]
        sizes = np.fromiter(map(len, said), np.int64, len(said))
        codes = np.frombuffer("".join(said).replace(" ", MARK).encode("utf-32-le"), np.uint32)
        chars = self.of_char[codes]
        bounds = np.concatenate(([0], np.cumsum(sizes)))
        blocks = np.maximum(sizes // BLOCK, 1)
        starts = np.repeat(bounds[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        at, sym = self._rounds(chars, starts[np.repeat(sizes, blocks) > 0])
        at, sym = self._joined(at, sym, chars, np.setdiff1d(starts, bounds), np.unique(bounds))
        of = np.searchsorted(bounds, at, "right") - 1
        width = np.ones(len(sym), np.int64)
        odd = np.flatnonzero((sym < 0) | (sym >= self.n))
        if len(odd):  # characters that are no piece: their bytes
            raw = [chr(c).encode() for c in codes[at[odd]].tolist()]
            width[odd] = [len(x) for x in raw]
            ids = np.repeat(sym, width)
            spot = flat.ranges((np.cumsum(width) - width)[odd], width[odd])
            ids[spot] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
            sym = ids
        return sym, np.bincount(of, width, len(said)).astype(np.int64)

    def encode(self, texts: pa.Array, end: bool) -> pa.Array:
        out = [pa.array([], pa.list_(pa.int32()))]
        for _, _, data, offsets in flat.pieces(texts):
            full = np.flatnonzero(np.diff(offsets))
            data = np.insert(data, offsets[full], 32)  # a space before every text that is not empty
            more = np.zeros(len(offsets), np.int64)
            more[full + 1] = 1
            offsets = offsets + np.cumsum(more)
            start = np.zeros(len(data) + 1, bool)
            start[1:-1] = self.apart[data[:-1], data[1:]]
            wide = np.flatnonzero(start[:-1] & np.concatenate(([False], data[:-1] >= 128)))
            mark = (wide >= 3) & (data[wide - 3] == 0xE2) & (data[wide - 2] == 0x96) & (data[wide - 1] == 0x81)
            start[wide[mark]] = False
            start[offsets] = True
            start[-1] = False
            starts = np.flatnonzero(start)
            numbers, counts = self.table.values(data, starts, np.append(starts[1:], len(data)))
            ids, cuts = lists(numbers, counts, np.searchsorted(starts, offsets), self.end if end else None)
            out.append(flat.list_array(ids, cuts))
        return pa.concat_arrays(out)

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of lists of ids, as the library's decode() gives them."""
        if isinstance(ids, pa.ChunkedArray):
            ids = ids.combine_chunks()
        ids = ids.fill_null([]) if ids.null_count else ids
        cuts = ids.offsets.to_numpy().astype(np.int64)
        out: list[str] = []
        low = 0
        values = ids.values.to_numpy(zero_copy_only=False)
        while low < len(ids):
            high = min(len(ids), max(low + 1, int(np.searchsorted(cuts, cuts[low] + flat.PIECE_BYTES, "right")) - 1))
            own, upto = values[cuts[low] : cuts[high]], cuts[low : high + 1] - cuts[low]
            odd = (own < 0) | (own >= self.n)
            known = np.where(odd, 0, own)
            odd |= ~self.plain[known]
            sizes = np.diff(self.text_at)[known]
            raw = self.text[flat.ranges(self.text_at[known], sizes)].tobytes()
            ends = np.concatenate(([0], np.cumsum(sizes)))[upto].tolist()
            bad = np.concatenate(([0], np.cumsum(odd)))[upto]
            bad = np.diff(bad) > 0
            for i, (a, b) in enumerate(zip(ends, ends[1:])):
                text = raw[a:b]
                try:
                    if bad[i]:
                        raise ValueError
                    out.append((text[1:] if text[:1] == b" " else text).decode())
                except ValueError:  # unknown ids and bytes that make no character: the library's own reading
                    out.append(self.library.decode(own[upto[i] : upto[i + 1]].tolist()))
            low = high
        return pa.array(out, pa.string())


def model(path: str) -> Model:
    return kept(("piecebpe", path), lambda: Model(path))


def encode(text: Column, path: str, end: bool = True) -> Column:
    """Ids of each whole text (null: empty) by the model in path, with its end id if asked for.

    An empty text has no ids but the end id. Rows that repeat a text have equal ids, an empty table gives no
    rows, other columns are not looked at. Texts of any length are encoded whole, in time that grows with
    their length also where they have no spaces or repeat a few characters. See check_model for models.
    """
    return F.arrow_udf(lambda x: model(path).encode(x, end), "array<int>")(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """Texts of arrays of ids of any length; null and empty arrays give an empty text, ids that the model has not are read as the library reads them."""
    return F.arrow_udf(lambda x: model(path).decode(x), "string")(ids)

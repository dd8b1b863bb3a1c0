"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges never run over a text. Instead:

* A sequence of tokens is what the merges give exactly if every two neighbours are (a merge that
  crossed a boundary would have shown up between those two tokens alone). :meth:`Merges.joins` decides
  this for two tokens from the parts they were merged from, and remembers the answer.
* So every prefix of a text has one last token. The non-deterministic machine guesses where tokens
  begin and reads them in the vocabulary's trie. A state of the determinised machine is the set of
  trie nodes that it may stand in; its step on a byte is computed when first needed and remembered
  (:class:`Transducer`). Of the tokens that may end at a byte, the one that joins the token before it
  is the last token of the prefix.
* A token is emitted once all boundaries from which another token may still grow agree on it. None
  grows longer than the longest token, which bounds the lookahead.

Outputs of words are remembered. All memories are bounded and change no result.

Decoding joins token bytes and hands out complete characters; an incremental UTF-8 machine
(:class:`Utf8`) carries the open ones, at most three bytes, to the next block.

Null and empty texts have no tokens. Texts of any length are read once, left to right. Repeated rows
and ids give repeated rows. Other columns are not looked at.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from driftloom.llm.common import _slices, held, list_column, map_batches

_NEVER = 1 << 60
#: Keys remembered in a generation; two are kept.
MEMORY = 400_000


class Merges:
    """The vocabulary: tokens by bytes, and which two may stand side by side."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.bytes_of = {r: b for b, r in self.ranks.items()}
        if missing := [i for i in range(256) if bytes([i]) not in self.ranks]:
            raise ValueError(f"the vocabulary has no token for {len(missing)} single bytes")
        self.children: list[dict[int, int]] = [{}]
        self.token_at = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][byte]
            self.token_at[node] = rank
        self._last_merge: dict[int, tuple[int, int] | None] = {}
        self._spines: tuple[dict[int, list[int]], dict[int, list[int]]] = ({}, {})
        self._joins: dict[tuple[int, int], bool] = {}

    def last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; itself twice for a single byte, None if merging its bytes never gives it."""
        if token not in self._last_merge:
            parts = [self.ranks[bytes([b])] for b in self.bytes_of[token]]
            found = (token, token) if len(parts) == 1 else None
            while len(parts) > 1:
                at, rank = min(((i, self._merged(parts[i], parts[i + 1])) for i in range(len(parts) - 1)), key=lambda x: (x[1], x[0]))
                if rank == _NEVER:
                    break
                if len(parts) == 2 and rank == token:
                    found = parts[0], parts[1]
                parts[at : at + 2] = [rank]
            self._last_merge[token] = found
        return self._last_merge[token]

    def _merged(self, left: int, right: int) -> int:
        return self.ranks.get(self.bytes_of[left] + self.bytes_of[right], _NEVER)

    def _spine(self, token: int, side: int) -> list[int]:
        """What stands at one end of the token while it is being merged, from a byte to the whole."""
        if token not in self._spines[side]:
            part = self.last_merge(token)[side]
            below = [] if part == token else self._spine(part, side)
            if below and below[-1] > token:
                raise ValueError("ranks must grow along merges, as in a trained vocabulary")
            self._spines[side][token] = [*below, token]
        return self._spines[side][token]

    def joins(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens."""
        key = (left, right)
        if key not in self._joins:
            if len(self._joins) > 4 * MEMORY:
                self._joins.clear()
            self._joins[key] = self._boundary_holds(self._spine(left, 1), self._spine(right, 0))
        return self._joins[key]

    def _boundary_holds(self, ends: list[int], starts: list[int]) -> bool:
        i = j = 0
        while True:
            grows_left = ends[i + 1] if i + 1 < len(ends) else _NEVER
            grows_right = starts[j + 1] if j + 1 < len(starts) else _NEVER
            across = self._merged(ends[i], starts[j])
            # of equal merges the leftmost goes first
            if across < grows_left and across <= grows_right and across < _NEVER:
                return False
            if grows_left == grows_right == _NEVER:
                return True
            if grows_left <= grows_right:
                i += 1
            else:
                j += 1


class Transducer:
    """Bytes in, tokens out; states are numbers, their steps are made when first asked for."""

    #: Bytes after which settled tokens are handed out; a boundary never waits longer than that and the longest token.
    BLOCK = 4096

    def __init__(self, merges: Merges):
        self.merges = merges
        self.length = {rank: len(token) for token, rank in merges.ranks.items()}
        self.longest = max(self.length.values())
        self.numbers: dict[tuple[int, ...], int] = {}
        self.subsets: list[tuple[int, ...]] = []
        self.steps: list[dict[int, int]] = []
        self.ended: list[tuple[tuple[int, int], ...]] = []
        self.holds: dict[int, bool] = {}
        self._number((0,))

    def _number(self, subset: tuple[int, ...]) -> int:
        if subset not in self.numbers:
            self.numbers[subset] = len(self.subsets)
            self.subsets.append(subset)
            self.steps.append({})
            ended = [self.merges.token_at[node] for node in subset]
            self.ended.append(tuple((self.length[t], t) for t in ended if t >= 0 and self.merges.last_merge(t)))
        return self.numbers[subset]

    def _step(self, state: int, byte: int) -> int:
        children = self.merges.children
        nodes = tuple(children[node][byte] for node in self.subsets[state] if byte in children[node])
        self.steps[state][byte] = found = self._number((*nodes, 0))
        return found

    def _joins(self, left: int, right: int) -> bool:
        if len(self.holds) >= 4 * MEMORY:
            self.holds.clear()
        self.holds[left << 32 | right] = found = self.merges.joins(left, right)
        return found

    def blocks(self, data: bytes) -> Iterator[list[int]]:
        """Tokens as they are settled, a block at a time."""
        steps, ended, holds = self.steps, self.ended, self.holds
        state, last, started = 0, [0], False
        for byte in data:
            nxt = steps[state].get(byte)
            state = self._step(state, byte) if nxt is None else nxt
            at = len(last)
            for length, token in ended[state]:
                if length == at and not started:
                    break
                if length < at or started and length == at:
                    left = last[at - length]
                    joined = holds.get(left << 32 | token)
                    if self._joins(left, token) if joined is None else joined:
                        break
            last.append(token)
            if at >= self.BLOCK:
                settled = self._agreed(last)
                if settled:
                    yield self._path(last, settled)
                    last, started = last[settled:], True
        yield self._path(last, len(last) - 1)

    def _agreed(self, last: list[int]) -> int:
        """The last boundary that lies on the way to every boundary from which a token may still grow."""
        depth = len(last) - 1
        open_ends = set(range(max(0, depth - self.longest), depth + 1))
        while len(open_ends) > 1:
            top = max(open_ends)
            open_ends.remove(top)
            open_ends.add(max(0, top - self.length[last[top]]))
        return open_ends.pop()

    def _path(self, last: list[int], end: int) -> list[int]:
        tokens = []
        while end > 0:
            tokens.append(last[end])
            end -= self.length[last[end]]
        tokens.reverse()
        return tokens

    def encode(self, data: bytes) -> list[int]:
        """All tokens at once; the same machine as :meth:`blocks`, without its bookkeeping for long inputs."""
        if len(data) >= self.BLOCK:
            return [token for block in self.blocks(data) for token in block]
        steps, ended, holds = self.steps, self.ended, self.holds
        state, last = 0, [0]
        for at, byte in enumerate(data, 1):
            row = steps[state]
            state = row[byte] if byte in row else self._step(state, byte)
            for length, token in ended[state]:
                if length == at:
                    break
                left = last[at - length]
                pair = left << 32 | token
                if holds[pair] if pair in holds else self._joins(left, token):
                    break
            last.append(token)
        return self._path(last, len(data))


class Lockstep:
    """The machine of a :class:`Transducer` on many pieces at once, one byte of each at a time.

    Its steps, the tokens that end in a state and which tokens join are copied into arrays as they become known.
    Pieces beyond :data:`LONGEST` bytes, and those that come to a state beyond :data:`STATES`, go one by one.
    """

    #: Pieces taken together, longest piece, states with a row in the table of steps, places for joins.
    TOGETHER, LONGEST, STATES, PLACES = 16_384, 64, 32_768, 1 << 20

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.length = np.zeros(max(machine.length) + 1, np.int64)
        self.length[list(machine.length)] = list(machine.length.values())
        self.table = np.full((64, 256), -1, np.int32)
        # tokens that end in a state lie from first[state] up to first[state + 1], longest first
        self.first, self.ended = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.pairs, self.joined = np.full(self.PLACES, -1, np.int64), np.zeros(self.PLACES, bool)

    def _learn(self, states: np.ndarray, octets: np.ndarray) -> None:
        """Makes the steps that are not in the table yet."""
        steps = self.machine.steps
        for key in np.unique(states.astype(np.int64) << 8 | octets).tolist():
            state, byte = key >> 8, key & 0xFF
            found = steps[state].get(byte)
            found = self.machine._step(state, byte) if found is None else found
            if state >= len(self.table):
                self.table = np.concatenate([self.table, np.full((max(len(self.table), state), 256), -1, np.int32)])[: self.STATES]
            self.table[state, byte] = found
        more = self.machine.ended[len(self.first) - 1 : self.STATES]
        if more:
            self.ended = np.concatenate([self.ended, np.array([token for tokens in more for _, token in tokens], np.int32)])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum([len(tokens) for tokens in more])])

    def _joins(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        place = (keys * -0x61C8864680B583EB >> 40) & (self.PLACES - 1)
        out = self.joined.take(place)
        unknown = np.flatnonzero(self.pairs.take(place) != keys)
        if len(unknown):
            new, back = np.unique(keys[unknown], return_inverse=True)
            held = np.fromiter((self.machine.merges.joins(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()), bool, len(new))
            out[unknown] = held[back]
            at = place[unknown]
            self.pairs[at], self.joined[at] = keys[unknown], held[back]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as the bytes of 32-bit numbers."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-sizes, kind="stable")
        rest = order[: np.searchsorted(-sizes[order], -self.LONGEST)].tolist()
        for start in range(len(rest), len(order), self.TOGETHER):
            rest += self._together(pieces, order[start : start + self.TOGETHER], sizes, out)
        for k in rest:
            out[k] = array("i", self.machine.encode(pieces[k])).tobytes()
        return out

    def _together(self, pieces: list[bytes], some: np.ndarray, sizes: np.ndarray, out: list[bytes]) -> list[int]:
        """Fills ``out`` for the pieces ``some``, longest first; gives those that have to go one by one."""
        lengths, n = sizes[some], len(some)
        longest = int(lengths[0])
        data = np.frombuffer(b"".join([pieces[k].ljust(longest, b"\0") for k in some.tolist()]), np.uint8).reshape(n, longest).T.copy()
        last = np.zeros((longest + 1, n), np.int32)
        state, alone, flat = np.zeros(n, np.int64), np.zeros(n, bool), last.ravel()
        for at in range(1, longest + 1):
            live = int(np.searchsorted(-lengths, -at, "right"))
            before, octets = state[:live], data[at - 1, :live]
            if before.max() >= len(self.table):
                self._learn(before[before >= len(self.table)], octets[before >= len(self.table)])
            step = before << 8 | octets
            after = self.table.ravel().take(step)
            missing = after < 0
            if missing.any():
                self._learn(before[missing], octets[missing])
                after = self.table.ravel().take(step)
            beyond = after >= self.STATES
            if beyond.any():
                alone[:live] |= beyond
                after[beyond] = 0
            state[:live] = after
            left = np.flatnonzero(~alone[:live])
            after = after.take(left)
            here, final = self.first.take(after), self.first.take(after + 1) - 1
            while len(left):
                token = self.ended.take(here)
                back = at - self.length.take(token)
                # a token that is the whole prefix, or the last that is possible, needs no look at the one before
                good = (back == 0) | (here == final)
                ask = np.flatnonzero(~good)
                good[ask] = self._joins(flat.take(back.take(ask) * n + left.take(ask)), token.take(ask))
                won, lost = np.flatnonzero(good), np.flatnonzero(~good)
                last[at, left.take(won)] = token.take(won)
                left, here, final = left.take(lost), here.take(lost) + 1, final.take(lost)
        # back along the tokens of each piece
        end, live, found = lengths.copy(), np.flatnonzero(lengths > 0), []
        end[alone] = 0
        live = live[end[live] > 0]
        while len(live):
            token = flat.take(end.take(live) * n + live)
            found.append((live, token))
            end[live] -= self.length[token]
            live = live[end[live] > 0]
        counts = np.zeros(n, np.int64)
        for who, _ in found:
            counts[who] += 1
        ends = np.cumsum(counts)
        ids = np.zeros(int(ends[-1]), np.int32)
        for k, (who, token) in enumerate(found, 1):
            ids[ends[who] - k] = token
        raw, borders = ids.tobytes(), [0, *(4 * ends).tolist()]
        for k, a, z in zip(some.tolist(), borders[:-1], borders[1:], strict=True):
            out[k] = raw[a:z]
        return some[alone].tolist()


class Memory(dict):
    """A bounded memory of what :meth:`make` gives. A key is kept from its second coming on.

    Holds at most :data:`MEMORY` keys and as many that were kept before those.
    """

    def __init__(self) -> None:
        super().__init__()
        self.older: dict = {}
        self.seen = np.zeros(1 << 22, bool)

    def make(self, keys: list[str]) -> list[bytes | None]:
        raise NotImplementedError

    def look_up(self, keys: list[str]) -> list[bytes | None]:
        """The values of different keys; those that are not remembered are made together."""
        out = list(map(self.get, keys))
        missing = [k for k, value in enumerate(out) if value is None]
        if self.older:
            kept = list(map(self.older.get, map(keys.__getitem__, missing)))
            for k, value in zip(missing, kept, strict=True):
                if value is not None:
                    out[k] = value
                    self._keep(keys[k], value)
            missing = [k for k in missing if out[k] is None]
        new = [keys[k] for k in missing]
        made = self.make(new)
        for k, value in zip(missing, made, strict=True):
            out[k] = value
        slots = np.fromiter(map(hash, new), np.int64, len(new)) & (len(self.seen) - 1)
        again = np.flatnonzero(self.seen.take(slots))
        self.seen[slots] = True
        for k in again.tolist():
            if made[k] is not None:
                self._keep(new[k], made[k])
        return out

    def _keep(self, key: str, value: bytes) -> None:
        if len(key) <= 64:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
                self.seen[:] = False
            self[key] = value


def _laid_out(groups: list[list[str]]) -> tuple[list[str], list[int]]:
    """Groups end to end, and where each begins."""
    ends = list(accumulate(map(len, groups), initial=0))
    return list(chain.from_iterable(groups)), ends[:-1]


def _strings(words: pa.Array) -> list[str]:
    """Words without a space in them, taken out of Arrow as one string."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")
    return joined[0].as_py().split(" ") if len(words) else []


class Pieces:
    """Token ids of pieces, as the bytes of 32-bit numbers, by the transducer."""

    def __init__(self, merges: Merges):
        self.merges, self.machine = merges, Lockstep(Transducer(merges))

    def make(self, keys: list[str]) -> list[bytes]:
        data = [key.encode("utf-8", "replace") for key in keys]
        out = [b"" if whole is None else whole.to_bytes(4, "little") for whole in map(self.merges.ranks.get, data)]
        several = [k for k, ids in enumerate(out) if not ids]
        for k, ids in zip(several, self.machine.encode([data[k] for k in several]), strict=True):
            out[k] = ids
        return out

    def join(self, pieces: list[str], starts: list[int]) -> list[bytes]:
        """The ids of several pieces laid end to end, for each group of them; each different piece is encoded once."""
        different = list(dict.fromkeys(pieces))
        ids = dict(zip(different, self.make(different), strict=True))
        each = list(map(ids.__getitem__, pieces))
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, each), np.int64, len(each)))])
        raw, borders = b"".join(each), ends[[*starts, len(each)]].tolist()
        return [raw[a:z] for a, z in zip(borders[:-1], borders[1:], strict=True)]


class Words(Memory):
    """Token ids of a space and what stands up to the next space, from the pieces in it.

    None where the white space around the cut may belong to one piece.
    """

    def __init__(self, pieces: Pieces, split):
        super().__init__()
        self.pieces, self.split = pieces, split

    def make(self, keys: list[str]) -> list[bytes | None]:
        good = [k for k, key in enumerate(keys) if key and not key[-1].isspace()]
        out: list[bytes | None] = [None] * len(keys)
        for k, ids in zip(good, self.pieces.join(*self._pieces_of([keys[k] for k in good])), strict=True):
            out[k] = ids
        return out

    def _pieces_of(self, words: list[str]) -> tuple[list[str], list[int]]:
        """The pieces of all words, each with a space before it, and where those of each begin.

        They are split together, since no piece goes on beyond its word.
        """
        pieces = self.split(" " + " ".join(words)) if words else []
        starts = [k for k, piece in enumerate(pieces) if piece[0] == " "]
        if len(starts) == len(words) and (not words or starts[0] == 0):
            return pieces, starts
        return _laid_out([self.split(" " + word) for word in words])  # a pattern that leaves spaces out

    def encode(self, text: str) -> bytes:
        """Ids of one text."""
        return self.encode_all(pa.array([text]))[0].tobytes()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, number of ids of each).

        Texts are cut at spaces that follow and precede other characters, the others are split as a whole. Each
        different word of the batch is looked up once, and its ids are copied to where it stands.
        """
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64)
        offsets, values = offsets - offsets[0], parts.flatten()
        words = values.dictionary_encode()
        place = words.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(values), bool)
        first[offsets[:-1]] = True
        # a word is looked up as one that follows a space; those that begin a text have no space before them
        wanted = np.zeros(len(words.dictionary), bool)
        wanted[place[~first]] = True
        pool: list[bytes] = [b""] * len(words.dictionary)
        fits = np.ones(len(words.dictionary), bool)
        asked = np.flatnonzero(wanted)
        for k, ids in zip(asked.tolist(), self.look_up(_strings(words.dictionary.take(pa.array(asked)))), strict=True):
            if ids is None:
                fits[k] = False
            else:
                pool[k] = ids
        whole = np.zeros(len(texts), bool)
        whole[np.repeat(np.arange(len(texts)), np.diff(offsets))[~first][~fits[place[~first]]]] = True
        at = np.where(first, 0, place)
        begins = values.take(pa.array(offsets[:-1])).to_pylist()
        whole |= np.fromiter((begin != "" and begin[-1].isspace() for begin in begins), bool, len(begins))
        alone = [self.split(texts[k].as_py() if whole[k] else begin) for k, begin in enumerate(begins)]
        at[offsets[:-1]] = len(pool) + np.arange(len(texts))
        pool += self.pieces.join(*_laid_out(alone))
        sizes = np.fromiter(map(len, pool), np.int64, len(pool)) // 4
        starts = np.cumsum(sizes) - sizes
        lengths = sizes[at]
        lengths[np.repeat(whole, np.diff(offsets)) & ~first] = 0
        shift = np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths)
        ids = np.frombuffer(b"".join(pool), np.int32)[shift + np.arange(len(shift))]
        return ids, np.add.reduceat(lengths, offsets[:-1]) if len(texts) else np.zeros(0, np.int64)


class Utf8:
    """Incremental UTF-8: bytes in, complete characters out; the open tail stays inside.

    A byte that cannot belong to a character becomes U+FFFD, as ``bytes.decode(errors="replace")`` has it.
    """

    #: Continuation bytes wanted after a lead byte.
    WANTED = {b: 1 if b < 0xE0 else 2 if b < 0xF0 else 3 for b in range(0xC2, 0xF5)}

    def __init__(self) -> None:
        self.open = b""

    def feed(self, data: bytes) -> str:
        data = self.open + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                if self.WANTED.get(byte, 0) >= back and self._possible(data[-back:]):
                    cut -= back
                break
        self.open = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _possible(start: bytes) -> bool:
        """The second byte rules out overlong forms, surrogates and what lies beyond U+10FFFF."""
        if len(start) < 2:
            return True
        low, high = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(start[0], (0x80, 0xBF))
        return low <= start[1] <= high

    def close(self) -> str:
        rest, self.open = self.open, b""
        return rest.decode("utf-8", "replace")


class Joiner:
    """Bytes of tokens laid end to end, without a loop over tokens."""

    def __init__(self, bytes_of: dict[int, bytes]):
        lengths = np.zeros(max(bytes_of) + 1, np.int64)
        lengths[list(bytes_of)] = [len(b) for b in bytes_of.values()]
        self.lengths, self.starts = lengths, np.cumsum(lengths) - lengths
        self.pool = np.frombuffer(b"".join(bytes_of[i] for i in sorted(bytes_of)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        before = np.cumsum(lengths) - lengths
        return self.pool[np.repeat(self.starts[ids] - before, lengths) + np.arange(lengths.sum())].tobytes()


def decode_stream(blocks: Iterable[np.ndarray], joiner: Joiner) -> Iterator[str]:
    """Text for blocks of ids as they come; a character that a block leaves open comes with the next."""
    machine = Utf8()
    for block in blocks:
        yield machine.feed(joiner.join(block))
    yield machine.close()


def _merges(rank_file: bytes) -> Merges:
    """One vocabulary a worker process, kept between tasks."""
    memory, key = held(__name__), hash(rank_file)
    if memory.get("file") != key:
        memory.clear()
        memory |= {"file": key, "merges": Merges(rank_file)}
    return memory["merges"]


def _words(merges: Merges, pattern: str) -> Words:
    """One encoder a worker process, kept between tasks."""
    memory = held(__name__)
    if memory.get("pattern") != pattern or memory["words"].pieces.merges is not merges:
        memory |= {"pattern": pattern, "words": Words(Pieces(merges), regex.compile(pattern).findall)}
    return memory["words"]


#: Text that is cut into words at once: some twenty times as many bytes are held for it.
ENCODE_BYTES = 2_000_000


def encode(
    spark: SparkSession, docs: DataFrame, rank_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",),
    into: tuple[str, str, Callable[[pa.ListArray], pa.Array]] = ("token_ids", "array<int>", lambda ids: ids), at_once: int = ENCODE_BYTES,
) -> DataFrame:
    """Columns ``keep`` and ``token_ids`` (array of int) of every row's whole ``text``.

    ``into`` names another column for the ids, its type, and what makes it from them in the same task. ``at_once`` bytes of
    text are cut into words at a time; more look up a repeated word less often, in more memory.

    ``rank_path`` is a file of base64 tokens and ranks, read by the driver and broadcast: its size is
    that of the vocabulary. ``pattern`` splits a text into pieces, each encoded separately. It must be
    one (as those of public byte-level vocabularies) whose matches begin anew at a space after another
    character, do not look behind, and look ahead within white space only.
    """
    file = spark.sparkContext.broadcast(Path(rank_path).read_bytes())
    name, kind, made = into

    def work():
        words = _words(_merges(file.value), pattern)

        def step(batch: pa.RecordBatch) -> dict:
            parts = [words.encode_all(part.column("text").fill_null("")) for part in _slices(batch, at_once)]
            ids, lengths = (np.concatenate(found) for found in zip(*parts, strict=True))
            return {c: batch.column(c) for c in keep} | {name: made(list_column(ids, lengths.tolist(), pa.int32()))}

        return step

    kinds = dict(docs.dtypes)
    return map_batches(docs, [*keep, "text"], ", ".join(f"{c} {kinds[c]}" for c in keep) + f", {name} {kind}", work)


BLOCK = 65_536


def decode(spark: SparkSession, encoded: DataFrame, rank_path: str) -> DataFrame:
    """The columns of ``encoded`` and ``decoded``, the text of ``token_ids``; empty for null ids."""
    file = spark.sparkContext.broadcast(Path(rank_path).read_bytes())
    keep = [c for c in encoded.columns if c != "decoded"]

    def work():
        joiner = Joiner(_merges(file.value).bytes_of)

        def step(batch: pa.RecordBatch) -> dict:
            column = batch.column("token_ids")
            ends, ids = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            rows = (ids[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True))
            texts = ["".join(decode_stream((r[k : k + BLOCK] for k in range(0, len(r), BLOCK)), joiner)) for r in rows]
            return {c: batch.column(c) for c in keep} | {"decoded": pa.array(texts, pa.string())}

        return step

    kinds = dict(encoded.dtypes)
    return map_batches(encoded, keep, ", ".join(f"{c} {kinds[c]}" for c in keep) + ", decoded string", work)

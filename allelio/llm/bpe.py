"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

A merge list applied to a prefix of a word gives tokens that later bytes may still change, but only near the end.
``sufficient_lookahead`` computes from the merge list how near. The argument: compare the tokens of a prefix with those of
any longer text while rules are applied in order of rank. The first place where the two differ moves left only when a rule
joins the last common token Z with the differing token X to its right; from then on both texts have, at that place, a token
that begins with Z. The next move needs a rule of a larger rank whose right side begins with Z. So moves form a chain of rules
of increasing rank, in which each right side begins with the left side before it, and the differing place moves left by the
length of the left sides. The longest chain bounds the lookahead. It holds for lists in which the parts of a rule are made by
earlier rules, which is checked.

``WordStream`` takes the bytes of one word as they come and emits a token once that many bytes follow it. What is
emitted ends at a token border of the final result, and no rule crosses such a border, so the rest is encoded on its own.
``Encoder`` splits text into words, also as it comes; ``Decoder`` turns ids into text and holds back an unfinished character.
All three keep a bounded buffer, however long a text or a word is.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allelio.llm.common import per_texts, raw

#: Words of a byte-level vocabulary: contractions, then letters, numbers or signs with one space before them, then spaces.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
RUNS = {"letter": regex.compile(r"\p{L}*"), "number": regex.compile(r"\p{N}*"), "sign": regex.compile(r"[^\s\p{L}\p{N}]*"), "space": regex.compile(r"\s*")}
#: A space before a non-space starts a word; any other space needs the full pattern.
CUT, UNSURE = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")
#: Characters that a contraction or the end of a run of spaces may need beyond a word.
BEYOND = 3
CACHED = 1 << 19
#: Chunks whose ids stand side by side.
TABLE = 1 << 18
UNMERGED = 1 << 40
#: Longer chunks and words are not remembered.
LONG = 64
#: Longer texts are encoded piece by piece.
STREAMED = 1 << 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token's end that fix it, for a merge list in order of rank."""
    longest: dict[bytes, int] = {}
    best = 0
    for left, right in reversed(merges):
        moved = len(left) + longest.get(left, 0)
        best = max(best, moved)
        for n in range(1, len(right) + 1):
            head = right[:n]
            if longest.get(head, 0) < moved:
                longest[head] = moved
    return best


class Vocabulary:
    """Ids, merge ranks and added tokens of a byte-level BPE file (JSON text)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        alphabet, model = byte_alphabet(), spec["model"]
        to_bytes = lambda s: bytes(alphabet[c] for c in s)
        ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rules = [(to_bytes(a), to_bytes(b)) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.first = [ids[bytes([b])] for b in range(256)]
        self.merges = {}
        self.made = [ids[a + b] for a, b in self.rules]
        since = {bytes([b]): -1 for b in range(256)}
        for rank, (a, b) in enumerate(self.rules):
            if since.get(a, rank) >= rank or since.get(b, rank) >= rank:
                raise ValueError(f"rule {rank} joins a part that no earlier rule makes")
            since.setdefault(a + b, rank)
            self.merges.setdefault(ids[a] << 32 | ids[b], rank)
        size = 1 + max([*ids.values(), *self.special.values()])
        self.pieces = [b""] * size
        for piece, i in ids.items():
            self.pieces[i] = piece
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.lookahead = sufficient_lookahead(self.rules)
        self.first_ids, self.made_ids = np.array(self.first, np.int64), np.array(self.made, np.int64)
        self._pair_table()
        self.words: dict[str, bytes] = {}
        self.chunks = Chunks(self)
        self.table = ChunkTable(self)

    def encode_word(self, data: bytes) -> list[int]:
        """Ids of one whole word: the rule of least rank first, the leftmost of equals."""
        first, merges, made = self.first, self.merges, self.made
        ids = [first[b] for b in data]
        if len(ids) > 48:
            return self._encode_long(ids)
        # Ranks of neighbouring pairs, kept in step with the ids.
        ranks = [merges.get(a << 32 | b, UNMERGED) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks and (rank := min(ranks)) != UNMERGED:
            i = ranks.index(rank)
            new = made[rank]
            ids[i] = new
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = merges.get(ids[i - 1] << 32 | new, UNMERGED)
            if i < len(ranks):
                ranks[i] = merges.get(new << 32 | ids[i + 1], UNMERGED)
        return ids

    def _encode_long(self, ids: list[int]) -> list[int]:
        merges, made, n = self.merges, self.made, len(ids)
        after, before, queue = [*range(1, n), -1], [*range(-1, n - 1)], []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (rank := merges.get(ids[i] << 32 | ids[j])) is not None:
                heapq.heappush(queue, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            rank, i, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def _pair_table(self) -> None:
        """Ranks of pairs by open addressing, for looking up many pairs at once."""
        size = 1 << max(8, (8 * len(self.merges)).bit_length())
        self.slots, self.slot_ranks, self.slot_mask = np.full(size, -1, np.int64), np.full(size, UNMERGED, np.int64), size - 1
        for key, rank in self.merges.items():
            at = self._slot(np.array([key]))[0]
            while self.slots[at] >= 0:
                at = at + 1 & self.slot_mask
            self.slots[at], self.slot_ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(30)).astype(np.int64) & self.slot_mask

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.slot_ranks[at], UNMERGED)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] = at[open_] + 1 & self.slot_mask
            found = self.slots[at[open_]]
            out[open_] = np.where(found == keys[open_], self.slot_ranks[at[open_]], UNMERGED)
            open_ = open_[(found != keys[open_]) & (found >= 0)]
        return out

    def merge(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many short words, one after another, and how many each has: in each turn every word applies its rule of least rank, from the left."""
        ids = self.first_ids[data]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ranks = np.full(len(ids), UNMERGED)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside] = self.ranks_of(ids[inside], ids[inside + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            least = np.repeat(np.minimum.reduceat(ranks, starts), sizes)
            ready = least == UNMERGED
            if ready.any():
                done.append((owner[ready], ids[ready]))
                ids, owner, ranks, least = ids[~ready], owner[~ready], ranks[~ready], least[~ready]
                if not len(ids):
                    break
            hit = ranks == least
            at = np.flatnonzero(hit)
            near = np.r_[False, at[1:] == at[:-1] + 1]
            if near.any():  # a run of one rule on equal parts: every other place
                first = np.maximum.accumulate(np.where(near, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            ids[at] = self.made_ids[ranks[at]]
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            place = np.cumsum(stays)[at] - 1
            last = np.r_[owner[1:] != owner[:-1], True][at + 1]  # the joined part ends its word
            ids, owner, ranks = ids[stays], owner[stays], ranks[stays]
            ranks[place[last]] = UNMERGED
            right = place[~last]
            ranks[right] = self.ranks_of(ids[right], ids[right + 1])
            left = place[place > 0]
            left = left[owner[left - 1] == owner[left]] - 1
            ranks[left] = self.ranks_of(ids[left], ids[left + 1])
        whose, every = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return every[np.argsort(whose, kind="stable")].astype("<u4"), np.bincount(whose, minlength=len(lengths))

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of many short words."""
        ids, sizes = self.merge(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        packed, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many chunks, each with a space before it, one after another, and how many each has."""
        words: list[str] = []
        counts = []
        for chunk in chunks:
            some = chunk_words(chunk)
            words += some
            counts.append(len(some))
        long = {i: np.frombuffer(pack_words(self, [w]), "<u4") for i, w in enumerate(words) if len(w) >= LONG}
        column = pa.array(["" if i in long else w for i, w in enumerate(words)] if long else words, pa.string())
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(words) + 1)
        ids, sizes = self.merge(np.frombuffer(column.buffers()[2] or b"", np.uint8, offsets[-1]), np.diff(offsets))
        if long:
            ends, parts, at = np.cumsum(sizes), [], 0
            for i, own in long.items():
                parts += [ids[at : ends[i]], own]
                at, sizes[i] = ends[i], len(own)
            ids = np.concatenate([*parts, ids[at:]])
        return ids, np.add.reduceat(sizes, np.cumsum(counts) - counts)

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of some texts: each distinct chunk is looked up once. Long or unusual texts are streamed one by one."""
        special = Encoder(self).special
        usual = [i for i, t in enumerate(texts) if t and len(t) <= STREAMED and not UNSURE.search(t) and not (special and special.search(t))]
        out: list[np.ndarray] = [None] * len(texts)
        chosen = set(usual)
        for i, text in enumerate(texts):
            if i not in chosen:
                out[i] = encode(self, text)
        if not usual:
            return out
        split = pc.split_pattern(pa.array([texts[i] for i in usual], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        places = self.table.places_of(names)
        index, offsets = coded.indices.to_numpy(), split.offsets.to_numpy()
        firsts, chunks = offsets[:-1], places[index]
        n = self.table.sizes[chunks]
        n[firsts] = 0  # no space stands before the first chunk
        total = np.cumsum(n)
        flat = self.table.ids[np.repeat(self.table.begins[chunks] - total + n, n) + np.arange(total[-1])]
        ends = total[offsets[1:] - 1].tolist()
        for i, chunk, a, b in zip(usual, index[firsts].tolist(), [0, *ends], ends):  # noqa: B905
            head = pack_words(self, WORDS.findall(names[chunk])) if names[chunk] else b""
            out[i] = np.concatenate([np.frombuffer(head, "<u4"), flat[a:b]])
        return out


class ChunkTable:
    """Ids of the chunks seen, side by side in one array. Once it is full, those met in one batch of texts only go."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.places = vocabulary, {}
        self._hold(np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, bool))

    def _hold(self, ids: np.ndarray, sizes: np.ndarray, again: np.ndarray) -> None:
        self.ids, self.sizes, self.again, self.begins = ids, sizes, again, np.cumsum(sizes) - sizes

    def places_of(self, chunks: list[str]) -> np.ndarray:
        """Where distinct chunks stand in ``sizes`` and ``begins``, until the next call; new ones are encoded together."""
        if len(self.sizes) > TABLE or len(self.ids) > 16 * TABLE:
            self._shrink()
        places = np.fromiter(map(self.places.get, chunks, repeat(-1)), np.int64, len(chunks))
        self.again[places[places >= 0]] = True
        new = np.flatnonzero(places < 0)
        if len(new):
            first, names = len(self.sizes), [chunks[i] for i in new.tolist()]
            ids, sizes = self.vocabulary.encode_chunks(names)
            self._hold(np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes]), np.concatenate([self.again, np.zeros(len(names), bool)]))
            self.places.update((c, at) for at, c in enumerate(names, first) if len(c) < LONG)
            places[new] = np.arange(first, first + len(names))
        return places

    def _shrink(self) -> None:
        stays = self.again
        if 2 * stays.sum() > TABLE:
            stays = np.zeros_like(stays)
        moved = np.where(stays, np.cumsum(stays) - 1, -1).tolist()
        self.places = {c: moved[at] for c, at in self.places.items() if moved[at] >= 0}
        self._hold(self.ids[np.repeat(stays, self.sizes)], self.sizes[stays], np.zeros(int(stays.sum()), bool))


def chunk_words(chunk: str) -> list[str]:
    """Words of a space and a chunk; the two usual kinds need no pattern."""
    if chunk.isalpha():
        return [" " + chunk]
    if chunk[-1:] in (".", ",") and chunk[:-1].isalpha():
        return [" " + chunk[:-1], chunk[-1]]
    return WORDS.findall(" " + chunk)


class Chunks(dict):
    """Packed ids of the text from one word-starting space to the next, remembered."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> bytes:
        packed = pack_words(self.vocabulary, WORDS.findall(" " + chunk))
        if len(chunk) < LONG:
            if len(self) >= CACHED:
                self.clear()
            self[chunk] = packed
        return packed


def pack_words(vocabulary: Vocabulary, words: Iterable[str]) -> bytes:
    known, out = vocabulary.words, []
    for word in words:
        packed = known.get(word)
        if packed is None:
            data = word.encode()
            if len(data) < LONG:
                packed = b"".join(map(vocabulary.packed.__getitem__, vocabulary.encode_word(data)))
                if len(known) >= CACHED:
                    known.clear()
                known[word] = packed
            else:
                stream = WordStream(vocabulary)
                packed = b"".join([*stream.feed(data), *stream.finish()])
        out.append(packed)
    return b"".join(out)


class WordStream:
    """Encodes one word of any length; at most a window of its bytes is held."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int | None = None):
        self.vocabulary = vocabulary
        self.lookahead = vocabulary.lookahead if lookahead is None else lookahead
        self.held = b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        """Packed ids that no later byte can change."""
        window = 4 * self.lookahead + 64
        view = memoryview(data)
        while view:
            taken = view[: max(1, window - len(self.held))]
            view = view[len(taken) :]
            self.held += bytes(taken)
            if len(self.held) >= window:
                ids, stable, end = self.vocabulary.encode_word(self.held), 0, 0
                for i in ids:
                    size = len(self.vocabulary.pieces[i])
                    if end + size > len(self.held) - self.lookahead:
                        break
                    end += size
                    stable += 1
                self.held = self.held[end:]
                yield np.array(ids[:stable], "<u4").tobytes()

    def finish(self) -> Iterator[bytes]:
        if self.held:
            yield np.array(self.vocabulary.encode_word(self.held), "<u4").tobytes()
            self.held = b""


class Encoder:
    """Text in pieces of any size to packed little-endian 32-bit ids; the pieces' borders do not show in the result."""

    def __init__(self, vocabulary: Vocabulary, limit: int = 1 << 16):
        self.vocabulary, self.limit = vocabulary, max(limit, 16)
        self.held = ""
        self.run: tuple[str, WordStream] | None = None
        longest = max(map(len, vocabulary.special), default=1)
        self.longest, self.keep = longest, BEYOND + longest - 1
        names = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None

    def feed(self, text: str) -> Iterator[bytes]:
        for at in range(0, len(text), self.limit):
            self.held += text[at : at + self.limit]
            yield from self._specials(final=False)

    def finish(self) -> Iterator[bytes]:
        yield from self._specials(final=True)

    def _specials(self, final: bool) -> Iterator[bytes]:
        while self.special and (found := self.special.search(self.held)):
            if not final and found.end() > len(self.held) - self.longest + len(found[0]):
                break  # a longer token may begin here
            rest, self.held = self.held[found.end() :], self.held[: found.start()]
            yield from self._plain(len(self.held), final=True)
            yield np.array([self.vocabulary.special[found[0]]], "<u4").tobytes()
            self.held = rest
        yield from self._plain(len(self.held) - (0 if final else min(self.keep, len(self.held))), final)

    def _plain(self, usable: int, final: bool) -> Iterator[bytes]:
        """Encode what no later character can change; ``usable`` characters hold no part of a special token."""
        if self.run and (yield from self._go_on(usable, final)):
            return
        if final:
            yield self._pack(self.held)
            self.held = ""
            return
        usable = max(0, len(self.held) - self.keep)
        cut = self.held.rfind(" ", 0, usable)
        while cut > 0 and self.held[cut + 1].isspace():
            cut = self.held.rfind(" ", 0, cut)
        if cut > 0:
            yield self._pack(self.held[:cut])
            self.held = self.held[cut:]
        elif len(self.held) >= self.limit:
            yield from self._start_run(usable)

    def _start_run(self, usable: int) -> Iterator[bytes]:
        done, words = 0, []
        for word in WORDS.finditer(self.held):
            if word.end() >= usable:
                break
            words.append(word[0])
            done = word.end()
        yield pack_words(self.vocabulary, words)
        self.held = self.held[done:]
        usable -= done
        if usable > self.limit // 2:
            last = self.held[usable - 1]
            kind = next(k for k, run in RUNS.items() if run.match(last).end())
            usable -= kind == "space"
            self.run = (kind, stream := WordStream(self.vocabulary))
            yield from stream.feed(self.held[:usable].encode())
            self.held = self.held[usable:]

    def _go_on(self, usable: int, final: bool) -> Iterator[bytes]:
        """Feed the open word; True if it goes on beyond what is held."""
        kind, stream = self.run
        end = RUNS[kind].match(self.held).end()
        ended = end < len(self.held) or final
        taken = end if ended else min(end, usable)
        if kind == "space" and taken and not (final and end == len(self.held)):
            taken -= 1
        if not ended or taken < end and end >= usable and not final:
            yield from stream.feed(self.held[: min(taken, usable)].encode())
            self.held = self.held[min(taken, usable) :]
            return True
        yield from stream.feed(self.held[:taken].encode())
        yield from stream.finish()
        self.held, self.run = self.held[taken:], None
        return False

    def _pack(self, text: str) -> bytes:
        if not text:
            return b""
        chunks = CUT.split(text) if UNSURE.search(text) else text.split(" ")
        head = pack_words(self.vocabulary, WORDS.findall(chunks[0])) if chunks[0] else b""
        return head + b"".join(map(self.vocabulary.chunks.__getitem__, chunks[1:]))


class Decoder:
    """Ids to text; bytes of an unfinished character wait for the next ids, broken ones become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.piece = vocabulary.pieces.__getitem__
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.machine.decode(b"".join(map(self.piece, ids)))

    def finish(self) -> str:
        return self.machine.decode(b"", final=True)


_KNOWN: dict[str, Vocabulary] = {}


def vocabulary_of(text: str) -> Vocabulary:
    """One per worker and file content, with what it remembers."""
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _KNOWN:
        _KNOWN[key] = Vocabulary(text)
    return _KNOWN[key]


def vocabulary_text(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_stream(vocabulary: Vocabulary, text: str) -> Iterator[np.ndarray]:
    encoder = Encoder(vocabulary)
    for source in (encoder.feed(text), encoder.finish()):
        for packed in source:
            yield np.frombuffer(packed, "<u4")


def encode(vocabulary: Vocabulary, text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, "<u4"), *encode_stream(vocabulary, text)])


def _pieces(ids: np.ndarray, step: int = 1 << 16) -> Iterator[np.ndarray]:
    return (ids[at : at + step] for at in range(0, len(ids), step))


def decode(vocabulary: Vocabulary, ids: np.ndarray, step: int = 1 << 16) -> Iterator[str]:
    decoder = Decoder(vocabulary)
    for part in _pieces(ids, step):
        yield decoder.feed(part.tolist())
    yield decoder.finish()


def _shared(spark: SparkSession, path: str | None):
    # The file's size is fixed by the vocabulary (about 1.5 MB), not by the data.
    return spark.sparkContext.broadcast(vocabulary_text(path or default_path()))


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``docs`` with the token ids of ``text`` in ``ids`` (array of int; of a null text: empty).

    Added tokens of the file found in a text become their ids, as the tokenizers library does by default. Bytes
    that are not UTF-8 count as U+FFFD. An existing column named ``ids`` is replaced.
    """
    shared = _shared(docs.sparkSession, path)

    def some(texts: list[str]) -> list[tuple]:
        return [(ids.astype("<i4"),) for ids in vocabulary_of(shared.value).encode_texts(texts)]

    return docs.withColumn(ids, per_texts(some, ["ids"], [pa.list_(pa.int32())], "ids array<int>")(raw(text))["ids"])


def decode_documents(docs: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All columns of ``docs`` with the text of ``ids`` in ``text`` (null ids: empty; null elements are left out)."""
    shared = _shared(docs.sparkSession, path)

    def run(rows: pa.Array) -> pa.Array:
        vocabulary = vocabulary_of(shared.value)
        plain = (np.array([i for i in (row.as_py() or []) if i is not None], "<u4") for row in rows)
        return pa.array(["".join(decode(vocabulary, one)) for one in plain], pa.string())

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return docs.withColumn(text, F.arrow_udf(run, "string").asNondeterministic()(F.col(ids)))


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode every text and decode the ids again; one row per row of ``docs``.

    Columns: ``doc_id, n_tokens, ids_sha256`` (of the ids as little-endian unsigned 32-bit integers) and ``decoded_sha256``
    (of the decoded text). Texts over ``STREAMED`` characters run piece by piece in both directions, so ids and decoded text are
    never whole beside the text. The ids of other texts are whole: their words are looked up and merged together with those of
    other texts, except in texts with double or final spaces or an added token, which pass the streaming encoder. A null or empty text has no tokens and the digests of nothing. Other columns are not read; repeated
    rows and null ids are kept as they are.
    """
    shared = _shared(docs.sparkSession, path)

    def digests(vocabulary: Vocabulary, parts: Iterable[np.ndarray]) -> tuple:
        decoder, of_ids, of_text, n = Decoder(vocabulary), hashlib.sha256(), hashlib.sha256(), 0
        for ids in parts:
            of_ids.update(ids.astype("<u4").tobytes())
            n += len(ids)
            of_text.update(decoder.feed(ids.tolist()).encode())
        of_text.update(decoder.finish().encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    def some(texts: list[str]) -> list[tuple]:
        vocabulary = vocabulary_of(shared.value)
        short = [t for t in texts if len(t) <= STREAMED]
        encoded = iter(vocabulary.encode_texts(short))
        return [digests(vocabulary, _pieces(next(encoded)) if len(t) <= STREAMED else encode_stream(vocabulary, t)) for t in texts]

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    digest = per_texts(some, names, [pa.int64(), pa.string(), pa.string()], "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return docs.select("doc_id", digest(raw()).alias("_digest")).select("doc_id", "_digest.*")

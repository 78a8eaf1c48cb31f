"""BPE encoding and decoding as streaming transducers of bounded lookahead.

Merges are made in the order of the list. What follows a prefix can change its
merges only through a chain: a merge takes the token before the end of what is
settled, a later merge takes the token before that, and so on, each one later in
the list and each with a right part that begins with the token taken before. The
longest such chain, in bytes, is found from the merge list alone and is the
sufficient lookahead (320 bytes for the 50,000 merges used here). So tokens that
end this far before the last byte read are stable and are emitted; only a window
of bytes is held. Words are cut off by a transducer over the characters, which
holds a block of them; a run of letters, digits, signs or blanks of any length
passes through both in constant memory. Decoding maps ids to bytes and bytes to
text by a state machine that carries an unfinished character.

Ids and decoded text equal those of the tokenizers library for byte-level files:
its special tokens are found in the text first, and its character classes are
asked of the library itself, since Unicode versions differ.

Defined results: a null or empty text has no ids and decodes to empty text;
texts and words of any length are read whole; white space and line breaks are
tokens like any other; repeated rows get equal ids; ties do not occur, since
every merge has its own place in the list; an empty table gives an empty result;
columns of any name stay, since columns are added under names of the caller's
choice. Decoding skips ids that the vocabulary lacks, and bytes that are no
UTF-8 become U+FFFD, as in the library; null ids decode to empty text.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public vocabulary by name (or a path).
VOCABULARY = "byte_bpe_50k.json"
#: Characters read at a time; a run without a place to cut is streamed from this length on.
BLOCK = 1 << 16
#: Words whose ids a task remembers at most, and the longest of them in characters.
REMEMBERED, SHORT = 500_000, 64
#: Bytes gathered beyond the lookahead before a window is merged; words up to so many bytes are merged by plain scans.
WINDOW, SCANNED = 4_096, 32

#: What stands for an id in packed form: little-endian, unsigned, 32 bits.
PACKED = np.dtype("<u4")


def _byte_names() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, the others from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in printable else next(others)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """Bytes after a token that can change it: the longest chain of merges, see the head of the module.

    Every part must be a single byte or the result of an earlier merge, and no result may come from two merges.
    """
    reach: dict[str, int] = {}  # longest chain that ends in taking this token
    first: dict[str, str] = {}  # left part of each result
    longest = 0
    for left, right in merges:
        if any(len(part) > 1 and part not in first for part in (left, right)) or left + right in first:
            raise ValueError(f"not a proper merge list at {left!r} {right!r}")
        begin, before = right, reach.get(right, 0)
        while begin in first:
            begin = first[begin]
            before = max(before, reach.get(begin, 0))
        reach[left] = max(reach.get(left, 0), len(left) + before)
        longest = max(longest, reach[left])
        first[left + right] = left
    return longest


def _char_classes(pre_tokenizer) -> dict[str, str]:
    """Letters, numbers and blanks as the insides of regular character classes, by the library's own cuts."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    ranges: dict[str, list[str]] = {"letter": [], "number": [], "blank": []}

    def pieces(text: str) -> int:
        return len(pre_tokenizer.pre_tokenize_str(text))

    for name, (low, high) in pre_tokenizer.pre_tokenize_str("".join(map(chr, points))):
        low += low == 32  # a blank goes with the signs after it
        run = points[low:high]
        if not run:
            continue
        char = chr(run[0])
        if pieces("a" + char) == 1:
            kind = "letter"
        elif pieces("1" + char) == 1:
            kind = "number"
        elif pieces("!" + char) == 1:
            continue
        else:
            kind = "blank"
        ranges[kind].append(f"\\U{run[0]:08x}-\\U{run[-1]:08x}")
    ranges["blank"].append("\\x20")
    return {kind: "".join(found) for kind, found in ranges.items()}


class Vocabulary:
    """Merges, ids and patterns of a tokenizer file, with the ids of words met before (their number is bounded)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, names = content["model"], _byte_names()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = model["vocab"]
        self.lookahead = sufficient_lookahead(merges)
        self.bytes = [ids[name] for name in names]
        self.rank = {(ids[u], ids[v]): rank for rank, (u, v) in enumerate(merges)}
        self.made = [ids[u + v] for u, v in merges]
        special = {token["content"]: token["id"] for token in content["added_tokens"]}
        if any(token[k] for token in content["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("special tokens that take their surroundings are not supported")
        byte_of = {name: b for b, name in enumerate(names)}
        self.text = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in {**ids, **special}.items()}
        self.longest = max(map(len, self.text.values()))
        self.special = {text: PACKED.type(i).tobytes() for text, i in special.items()}
        self.specials = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")

        kind = _char_classes(Tokenizer.from_file(path).pre_tokenizer)
        letter, number, blank = kind["letter"], kind["number"], kind["blank"]
        sign = f"[^{letter}{number}{blank}]"
        self.words = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{letter}]+| ?[{number}]+| ?{sign}+|[{blank}]+(?![^{blank}])|[{blank}]+")
        self.cut = re.compile(f"[^{blank}](?=[{blank}])")
        self.runs = {name: re.compile(f"{inside}*") for name, inside in (("letter", f"[{letter}]"), ("number", f"[{number}]"), ("blank", f"[{blank}]"), ("sign", sign))}
        self.known: dict[str, bytes] = {}

    def kind(self, char: str) -> str:
        return next(name for name, run in self.runs.items() if run.match(char).end())

    def word(self, word: str) -> bytes:
        """Packed ids of a word."""
        found = self.known.get(word)
        if found is None:
            found = np.array(self.merged(word.encode()), PACKED).tobytes()
            if len(word) <= SHORT:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = found
        return found

    def merged(self, text: bytes) -> list[int]:
        """All merges of a piece of bounded length."""
        ids = [self.bytes[b] for b in text]
        return self._scanned(ids) if len(ids) <= SCANNED else self._linked(ids)

    def _scanned(self, ids: list[int]) -> list[int]:
        rank, none = self.rank, len(self.made)
        ranks = [rank.get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            at = ranks.index(least)
            ids[at : at + 2] = [self.made[least]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank.get((ids[at - 1], ids[at]), none)
            if at < len(ranks):
                ranks[at] = rank.get((ids[at], ids[at + 1]), none)
        return ids

    def _linked(self, ids: list[int]) -> list[int]:
        """The next merge from a heap, of equal ones the leftmost; tokens linked to their neighbours."""
        rank, end = self.rank, len(ids)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        waiting = [(rank[pair], at) for at, pair in enumerate(zip(ids, ids[1:], strict=False)) if pair in rank]
        heapq.heapify(waiting)
        while waiting:
            least, at = heapq.heappop(waiting)
            nxt = after[at]
            if ids[at] < 0 or nxt >= end or rank.get((ids[at], ids[nxt])) != least:
                continue  # one of them is gone
            ids[at], ids[nxt] = self.made[least], -1
            after[at] = nxt = after[nxt]
            if nxt < end:
                before[nxt] = at
                if (r := rank.get((ids[at], ids[nxt]))) is not None:
                    heapq.heappush(waiting, (r, at))
            if (prev := before[at]) >= 0 and (r := rank.get((ids[prev], ids[at]))) is not None:
                heapq.heappush(waiting, (r, prev))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def vocabulary(name: str) -> Vocabulary:
    """Found on each machine by its public name, or by a path."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Vocabulary(name)


class Merger:
    """Bytes of one word of any length in, stable ids out."""

    def __init__(self, voc: Vocabulary):
        self.voc, self.held = voc, b""
        self.window = max(WINDOW, voc.longest)
        self.last: tuple[bytes, tuple[bytes, int]] = (b"", (b"", 0))

    def feed(self, text: bytes) -> Iterator[bytes]:
        step, at = self.voc.lookahead + self.window, 0
        while at < len(text):
            take = step - len(self.held)
            self.held += text[at : at + take]
            at += take
            if len(self.held) == step:
                ids, used = self._stable(self.held)
                self.held = self.held[used:]
                yield ids

    def _stable(self, window: bytes) -> tuple[bytes, int]:
        if self.last[0] != window:  # a run of one character gives the same window again
            ids, used, n = self.voc.merged(window), 0, 0
            for i in ids:
                if used + len(self.voc.text[i]) > self.window:
                    break
                used += len(self.voc.text[i])
                n += 1
            self.last = window, (np.array(ids[:n], PACKED).tobytes(), used)
        return self.last[1]

    def close(self) -> bytes:
        ids, self.held = np.array(self.voc.merged(self.held), PACKED).tobytes(), b""
        return ids


class Encoder:
    """Characters of one text in, packed ids out, as soon as nothing that follows can change them."""

    def __init__(self, voc: Vocabulary, specials: bool = True):
        self.voc, self.unread, self.tail = voc, "", ""
        self.specials = specials  # else their strings are ordinary text
        self.merger: Merger | None = None  # for a run that goes on
        self.run = ""

    def feed(self, text: str) -> Iterator[bytes]:
        if not self.specials:
            yield from self._feed(text)
            return
        text, at = self.unread + text, 0
        for found in self.voc.specials.finditer(text):
            yield from self._feed(text[at : found.start()])
            yield from self._end()
            yield self.voc.special[found.group()]
            at = found.end()
        begun = max((n for s in self.voc.special for n in range(1, len(s)) if text.endswith(s[:n], at)), default=0)
        self.unread = text[len(text) - begun :]
        yield from self._feed(text[at : len(text) - begun])

    def close(self) -> Iterator[bytes]:
        yield from self._feed(self.unread)
        yield from self._end()
        self.unread = ""

    def _words(self, text: str) -> bytes:
        return b"".join(map(self.voc.word, self.voc.words.findall(text)))

    def _feed(self, text: str) -> Iterator[bytes]:
        while text:
            if self.merger is not None:
                text = yield from self._go_on(text)
                continue
            text, self.tail = self.tail + text, ""
            cut = _last_cut(self.voc, text)
            if cut:
                yield self._words(text[:cut])
                self.tail = text[cut:]
                text = ""
            else:
                self.tail, text = text, ""
            if len(self.tail) > BLOCK:
                text = yield from self._long_tail()

    def _long_tail(self) -> Iterator[bytes]:
        """Blanks and then no blank: all words but the last are sure, or the last two, which may become one."""
        found = list(self.voc.words.finditer(self.tail))
        sure = found[-1].start()
        if len(found) > 1 and found[-2].group() == "'" and len(found[-1].group()) == 1:
            sure = found[-2].start()
        text, self.tail = self.tail[sure:], ""
        yield b"".join(self.voc.word(word.group()) for word in found if word.start() < sure)
        if len(text) <= BLOCK:
            self.tail = text
            return ""
        self.merger = Merger(self.voc)
        self.run = self.voc.kind(text[-1])
        if text[0] == " " and self.run != "blank":
            yield from self.merger.feed(b" ")
            text = text[1:]
        return text

    def _go_on(self, text: str) -> Iterator[bytes]:
        """The run takes what is its own; the last blank of a run is held, since it may go with what follows."""
        end = self.voc.runs[self.run].match(text).end()
        own, rest = self.tail + text[:end], text[end:]
        self.tail = own[-1:] if self.run == "blank" else ""
        yield from self.merger.feed(own[: len(own) - len(self.tail)].encode())
        if rest:
            yield self.merger.close()
            self.merger = None
        return rest

    def _end(self) -> Iterator[bytes]:
        if self.merger is not None:
            yield from self.merger.feed(self.tail.encode())
            yield self.merger.close()
            self.merger = None
        else:
            yield self._words(self.tail)
        self.tail = ""


def _last_cut(voc: Vocabulary, text: str) -> int:
    """The last place between a character that is no blank and a blank; words never reach over it."""
    for size in (256, len(text)):
        low, cut = max(0, len(text) - size), 0
        for found in voc.cut.finditer(text, low):
            cut = found.end()
        if cut or not low:
            return cut
    return 0


def encode(voc: Vocabulary, text: str, specials: bool = True) -> Iterator[bytes]:
    """Packed ids of a text, block by block."""
    encoder = Encoder(voc, specials)
    for at in range(0, len(text), BLOCK):
        yield from encoder.feed(text[at : at + BLOCK])
    yield from encoder.close()


class Decoder:
    """Packed ids in, text out; an unfinished character waits for its next byte."""

    def __init__(self, voc: Vocabulary):
        self.bytes, self.state = voc.text, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: bytes) -> str:
        return self.state.decode(b"".join([self.bytes.get(i, b"") for i in array("I", np.frombuffer(ids, PACKED).astype(np.uint32).tobytes())]))

    def close(self) -> str:
        return self.state.decode(b"", True)


def decode(voc: Vocabulary, ids: bytes) -> Iterator[str]:
    decoder, step = Decoder(voc), PACKED.itemsize * BLOCK
    for at in range(0, len(ids), step):
        yield decoder.feed(ids[at : at + step])
    yield decoder.close()


def token_ids(text: Column, vocabulary_name: str = VOCABULARY) -> Column:
    """Ids of each text, packed as little-endian unsigned 32-bit integers."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        voc = vocabulary(vocabulary_name)
        return pa.array([b"".join(encode(voc, t or "")) for t in texts.cast(pa.large_string()).to_pylist()], pa.binary())

    return of(text.cast("string"))


def decoded_text(ids: Column, vocabulary_name: str = VOCABULARY) -> Column:
    """The text of packed ids."""

    @F.arrow_udf("string")
    def of(packed: pa.Array) -> pa.Array:
        voc = vocabulary(vocabulary_name)
        return pa.array(["".join(decode(voc, ids or b"")) for ids in packed.cast(pa.large_binary()).to_pylist()], pa.string())

    return of(ids)


def id_list(ids: Column) -> Column:
    """Packed ids as an array of long."""

    @F.arrow_udf("array<long>")
    def of(packed: pa.Array) -> pa.Array:
        rows = [np.frombuffer(ids or b"", PACKED).astype(np.int64) for ids in packed.to_pylist()]
        return pa.array(rows, pa.list_(pa.int64()))

    return of(ids)


def round_trip(text: Column, vocabulary_name: str = VOCABULARY) -> Column:
    """Struct of each text's packed ids and the text that they decode to; each text is encoded once."""

    @F.arrow_udf("struct<ids:binary,decoded:string>")
    def of(texts: pa.Array) -> pa.Array:
        voc, ids, decoded = vocabulary(vocabulary_name), [], []
        for t in texts.cast(pa.large_string()).to_pylist():
            ids.append(b"".join(encode(voc, t or "")))
            decoded.append("".join(decode(voc, ids[-1])))
        return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(decoded, pa.string())], ["ids", "decoded"])

    return of(text.cast("string"))


def with_round_trip(docs: DataFrame, name: str = "bpe", text_column: str = "text", vocabulary_name: str = VOCABULARY) -> DataFrame:
    """``docs`` and a struct column ``name`` with the packed ids of the text and the text that they decode to."""
    return docs.withColumn(name, round_trip(F.col(text_column), vocabulary_name))

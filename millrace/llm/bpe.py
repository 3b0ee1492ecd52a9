"""Byte-pair encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

The vocabulary file names its merges in order of rank. All token occurrences in
a word are found in one Aho-Corasick pass, which gives the longest token at
each place. The encoder takes it if it may stand beside the token before it;
else it tries the next shorter one, and goes back where none is left. Two tokens
may stand side by side if no merge across their seam would have come before the
merges that made them (``_Words.seam_holds``); the answers fill a table of pairs.
A place found to be a dead end is never entered again, so the work is linear in
the word. The result is what the merges give, in exact terms.

Words repeat, so each Python worker keeps a bounded table of words it has
encoded; what a task does never depends on what the table holds.

Cases: null text counts as empty and has no tokens; the special tokens' strings
in a text become those tokens; white space belongs to no token; rows are
independent, so repeated rows give repeated results; other columns are ignored
unless named in ``keep``.
"""

from __future__ import annotations

import json
import re
import string
from array import array
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, normalizers, pre_tokenizers

from .common import documents, prepare, session, utf8_list

#: What a worker remembers before it starts a table anew: pieces between white space, and words within them.
MEMORY_PIECES, MEMORY_WORDS = 500_000, 800_000
#: Answers about pairs of tokens.
MEMORY_PAIRS = 300_000
#: A comma or stop beside anything but white space, ASCII letters and digits, or letters of U+00C0 to U+00FF.
NEAR = rb"[\x09-\x0d A-Za-z0-9]", rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
SIGNS = re.compile(rb"[.,](?:(?<!%b[.,])(?<!%b[.,])|(?!%b|%b|\Z))" % (*NEAR, *NEAR))
#: UTF-8 of letters from U+0300 on; below, no letter composes with another.
FAR = re.compile(rb"[\xcc-\xff]")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is printable Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Pairs(dict):
    """Which tokens may stand side by side; at most ``MEMORY_PAIRS`` answers."""

    def __init__(self, holds):
        self.holds = holds

    def __missing__(self, pair: tuple[int, int]) -> bool:
        if len(self) >= MEMORY_PAIRS:
            self.clear()
        made = self[pair] = self.holds(*pair)
        return made


class _Words:
    """Encodes words (byte sequences) with one vocabulary.

    A word is written as one character per byte; its last byte is moved up by
    256, since the vocabulary knows bytes at the end of a word apart.
    """

    def __init__(self, model: dict):
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.lifted = 256 if end else 0
        spelled: dict[int, str] = {}
        for b, letter in enumerate(letters):
            spelled[vocab[letter]] = chr(b)
            if end:
                spelled[vocab[letter + end]] = chr(b + 256)
        self.joined: dict[tuple[int, int], int] = {}  # the token that two tokens merge to
        self.parts: dict[int, tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b, made = vocab[left], vocab[right], vocab[left + right]
            self.joined[a, b], self.parts[made] = made, (a, b)
            spelled[made] = spelled[a] + spelled[b]
        if list(self.parts) != sorted(self.parts):
            raise ValueError("token ids must follow the ranks of the merges")
        ids = {s: t for t, s in spelled.items()}
        self.size = {t: len(s) for t, s in spelled.items()}
        self.shorter = {}  # the longest token that is a proper prefix
        for t, s in spelled.items():
            self.shorter[t] = next((ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in ids), None)
        self.find = ahocorasick.Automaton()
        for t, s in spelled.items():
            self.find.add_word(s, t)
        self.find.make_automaton()
        self.pairs = Pairs(self.seam_holds)

    def seam_holds(self, left: int, right: int) -> bool:
        """Whether merging leaves a seam between these two tokens.

        Their merges are undone, latest first. If at some point the tokens at the
        seam have a merge that ranks before all that was undone, it would have
        come first and closed the seam. Among equal ranks the leftmost goes first.
        """
        parts, before = self.parts, float("inf")
        a, b = left, right
        while True:
            over = self.joined.get((a, b))
            if over is not None and over < before:
                return False
            if a not in parts and b not in parts:
                return True
            if a in parts and (a > b or b not in parts):
                before, a = a, parts[a][1]
            else:
                before, b = b + 1, parts[b][0]

    def encode(self, word: bytes) -> list[int]:
        s = word[:-1].decode("latin-1") + chr(word[-1] + self.lifted)
        longest = [0] * len(s)
        size, shorter, pairs = self.size, self.shorter, self.pairs
        for end, t in self.find.iter(s):
            longest[end + 1 - size[t]] = t  # later matches from a place are longer
        out: list[int] = []
        dead: set[int] = set()
        at, t = 0, longest[0]
        while True:
            end = at + size[t]
            if end not in dead:
                if out:
                    fits = pairs[out[-1], t]
                else:
                    fits = True
                if fits:
                    out.append(t)
                    if end == len(s):
                        return out
                    at, t = end, longest[end]
                    continue
            t = shorter[t]
            while t is None:
                dead.add(at)
                t = out.pop()
                at -= size[t]
                t = shorter[t]


class Memory(dict):
    """Packed ids by white-space separated piece; at most ``most`` pieces."""

    def __init__(self, make, most: int):
        self.make, self.most = make, most

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        made = self[piece] = self.make(piece)
        return made


class Codec:
    """Encoder and decoder of one vocabulary file. Ids fit 16 bits or else take 32.

    With ``library`` the tokenizers library encodes each new word, else ``_Words`` does.
    """

    def __init__(self, path: str, library: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"] or ()}
        steps = spec["pre_tokenizer"]["pretokenizers"]
        pattern = next(x["pattern"]["Regex"] for x in steps if x["type"] == "Split")
        # runs of letters and runs of other signs are words of their own: short cuts for plain pieces
        self.plain = r"|[\p{L}]+|" in pattern and r"[^\s\p{L}\p{N}]+" in pattern
        self.pattern, self.near = pattern, regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.mark = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.leads = {x.lower().encode()[:2] for x in self.special}
        self.encode_word = library_words(path) if library else _Words(spec["model"]).encode
        self.kind = np.dtype("<u2" if max(*vocab.values(), *self.special.values(), 0) < 65536 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.nfc, self.lower = normalizers.NFC().normalize_str, normalizers.Lowercase().normalize_str
        self.seen: dict[str, bytes] = {}
        self.memory = Memory(self._piece, MEMORY_PIECES)
        # the offset table: token t's text is table[offset[t] : offset[t + 1]], a blank included
        texts = [b""] * (max(*vocab.values(), *self.special.values(), 0) + 1)
        for token, t in [*vocab.items(), *self.special.items()]:
            texts[t] = token.encode() + b" "
        self.table = np.frombuffer(b"".join(texts), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(x) for x in texts])])

    def _word(self, word: str) -> bytes:
        packed = self.seen.get(word)
        if packed is None:
            if len(self.seen) >= MEMORY_WORDS:
                self.seen.clear()
            packed = self.seen[word] = array(self.code, self.encode_word(word.encode())).tobytes()
        return packed

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if self.plain and not FAR.search(piece):
            core = text.rstrip(string.punctuation)
            low = core.lower()
            if low.isalpha():
                return self._word(low) + self._word(text[len(core) :]) if len(core) < len(text) else self._word(low)
        out = []
        for part in self.mark.split(text) if self.mark and "<" in text else [text]:
            if part in self.special:
                out.append(array(self.code, [self.special[part]]).tobytes())
            else:
                part = self._normal(part)
                out += map(self._word, (self.near if max(part, default="") < "\u0300" else self.far).findall(part))
        return b"".join(out)

    @cached_property
    def far(self) -> re.Pattern:
        """The pattern with the library's own letters, digits and white space: their Unicode version may differ from Python's from U+0300 on."""
        pattern = self.pattern
        for name in (r"\p{L}", r"\p{N}", r"\s"):
            held = library_class(name)
            pattern = pattern.replace(f"[{name}]", f"[{held}]").replace(name, held)
        return re.compile(pattern)

    def _normal(self, part: str) -> str:
        """NFC, then lower case letter by letter (a final sigma stays a sigma)."""
        return part.lower() if max(part, default="") < "\u0300" else self.lower(self.nfc(part))

    def encode(self, text: bytes) -> np.ndarray:
        """The ids of a UTF-8 text. bytes.split() cuts at the six ASCII white-space characters, which no token holds."""
        if self.plain and (text.isascii() or not FAR.search(text)) and not SIGNS.search(text):
            # commas and stops are words of their own here, so more pieces are alike
            low = text.lower()
            if not any(x in low for x in self.leads):  # special tokens are matched in their own case
                text = low.replace(b",", b" , ").replace(b".", b" . ")
        return np.frombuffer(b"".join(map(self.memory.__getitem__, text.split())), self.kind)

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens with a blank between them, by gathering from the offset table."""
        if not len(ids):
            return b""
        ids = ids.astype(np.int64)
        start = self.offset[ids]
        size = self.offset[ids + 1] - start
        ends = np.cumsum(size)
        at = np.repeat(start - (ends - size), size)
        at += np.arange(ends[-1])
        return self.table[at].tobytes()[:-1]


@lru_cache(maxsize=4)
def library_class(name: str) -> str:
    """What the library's patterns take for a class, as ranges of a character class. Planes 4 to 13, 15 and 16 hold no letter, digit or white space."""
    every = "".join(chr(c) for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)))
    found = pre_tokenizers.Split(Regex(name + "+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in found)


def library_words(path: str):
    """The tokenizers library's model as an encoder of words, which are normalised and split already."""
    model, letters = Tokenizer.from_file(path).model, byte_letters()
    return lambda word: [t.id for t in model.tokenize("".join([letters[b] for b in word]))]


@lru_cache(maxsize=2)
def codec(path: str, library: bool = False) -> Codec:
    return Codec(path, library)


def _ids_array(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple = ("doc_id",), decoded: bool = False) -> DataFrame:
    """``keep``, ids array<int> and, if asked for, decoded string: the decoded ids."""
    path = path or vocabulary_path()
    prepare(session(docs))
    kept = docs.select(*keep, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", ids array<int>" + ", decoded string" * decoded

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids = [c.encode(x) for x in utf8_list(batch.column(batch.num_columns - 1))]
            columns = batch.columns[:-1] + [_ids_array(ids)]
            if decoded:
                columns.append(pa.array([c.decode(x) for x in ids], pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "ids"] + ["decoded"] * decoded)

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, path: str | None = None, ids: str = "ids", keep: tuple = ("doc_id",)) -> DataFrame:
    """``keep`` and decoded string. A null list of ids decodes to the empty text."""
    path = path or vocabulary_path()
    prepare(session(coded))
    kept = coded.select(*keep, F.coalesce(F.col(ids).cast("array<int>"), F.expr("cast(array() as array<int>)")).alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", decoded string"

    def run(batches):
        c = codec(path)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            ends = ends - ends[0]
            texts = [c.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(texts, pa.binary()).cast(pa.string())], [*batch.schema.names[:-1], "decoded"])

    return kept.mapInArrow(run, schema)


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    coded = encode(docs, path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op9_bpe(spark, sf_dir) -> DataFrame:
    return token_digests(documents(spark, sf_dir))

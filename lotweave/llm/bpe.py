"""BPE encoding and decoding (operator 1).

The encoder backtracks: an Aho-Corasick pass finds the longest token at each place of a word, a candidate is kept if BPE
itself would leave it next to its predecessor (pair compatibility), and else a shorter token is tried. No place of a word
is tried twice, so a word takes linear time and gets the exact merges. The decoder cuts each token's bytes out of one
buffer through an offset table.

Defined cases: a null text counts as empty and gives no tokens; an empty text gives no tokens and decodes to ''; repeated
rows each give a row; special tokens' strings inside a text become their ids, as the vocabulary file asks for; long texts
are handled whole. Other columns are carried or ignored, never read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotweave.llm.common import documents, importable, map_texts

#: Words whose tokens a worker remembers before it starts afresh (a bound on memory only).
REMEMBERED = 1 << 18
LONGEST = 64

# Fixed value: the white space of \s in the vocabulary's patterns.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

END = "\uffff"  # stands for the end of a word inside token strings


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


def members_of(kind: str) -> str:
    """The inside of a character class with all code points of a general category (L: letters, N: numbers).

    The tokenizers library is asked, since its tables may be of another Unicode version than Python's.
    """
    from tokenizers import Regex, pre_tokenizers

    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    split = pre_tokenizers.Split(Regex(rf"[^\p{{{kind}}}]+"), "removed")
    runs: list[list[int]] = []
    for run, _ in split.pre_tokenize_str(every):
        for c in map(ord, run):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def lowered_apart() -> dict[int, str]:
    """Characters that the library lowers otherwise than Python, for the same reason."""
    from tokenizers import normalizers

    lower = normalizers.Lowercase().normalize_str
    every = (chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    return {ord(c): got for c in every if (got := lower(c)) != c.lower()}


def word_pattern(letter: str, number: str) -> re.Pattern:
    """What counts as a word: an English clitic, letters, one number, or a run of anything else that isn't white space."""
    clitics = "|".join(f"'{x}" for x in ("s", "t", "re", "ve", "m", "ll", "d"))
    return re.compile(f"{clitics}|[{letter}]+|[{number}]|[^{WHITE}{letter}{number}]+")


class Known:
    """What a worker remembers: ids of words (as byte characters) and of chunks of text, apart, since one may read like the other."""

    def __init__(self):
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    @staticmethod
    def keep(where: dict[str, bytes], name: str, ids: bytes) -> None:
        if len(where) >= REMEMBERED:
            where.clear()
        where[name] = ids


class WordBPE:
    """A BPE vocabulary with word ends, read from a tokenizers JSON file. Made once on the driver; workers get a copy."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {a + b for a, b in merges}
        self.letter, self.number, self.apart = members_of("L"), members_of("N"), lowered_apart()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids: dict[str, int] = model["vocab"]
        form: dict[str, str] = {}
        for t in ids:
            if t not in made:
                form[t] = t[: -len(suffix)] + END if len(t) > len(suffix) and t.endswith(suffix) else t
        for a, b in merges:
            form[a + b] = form[a] + form[b]
        words = {form[t]: i for t, i in ids.items()}
        #: By id: the order in which BPE makes a token (0: never, as a single symbol), and the two tokens it is made of.
        n = max([*ids.values(), *self.special.values()]) + 1
        self.order, self.left, self.right = [0] * n, list(range(n)), list(range(n))
        self.pairs: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges, 1):
            i = ids[a + b]
            self.pairs[ids[a], ids[b]] = k
            self.order[i], self.left[i], self.right[i] = k, ids[a], ids[b]
        strings = [b""] * n
        for t, i in [*ids.items(), *self.special.items()]:
            strings[i] = t.encode()
        self.buffer = b"".join(strings)
        self.offsets = np.cumsum([0, *map(len, strings)])
        #: Token string, with END for the suffix -> id; without tokens whose halves BPE would not bring together.
        self.words = {t: i for t, i in words.items() if not self.order[i] or self.meets(i)}

    def meets(self, i: int) -> bool:
        """Whether the halves of token i stay apart but for the merge that makes it."""
        k = self.pairs.pop((self.left[i], self.right[i]))
        apart = self.keeps_apart(self.left[i], self.right[i])
        self.pairs[self.left[i], self.right[i]] = k
        self.compatible.clear()
        return apart

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("automaton", "shorter", "finder", "splitter", "to_chars", "compatible", "lowered")}

    @cached_property
    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for t, i in self.words.items():
            found.add_word(t, (i, len(t)))
        found.make_automaton()
        return found

    @cached_property
    def shorter(self) -> dict[int, tuple[int, int]]:
        """For each token the next shorter one that begins it, with its length."""
        out = {}
        for t, i in self.words.items():
            for k in range(len(t) - 1, 0, -1):
                if (j := self.words.get(t[:k])) is not None:
                    out[i] = (j, k)
                    break
        return out

    @cached_property
    def finder(self):
        return word_pattern(self.letter, self.number).findall

    @cached_property
    def splitter(self):
        return re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True)))

    @cached_property
    def lowered(self):
        """Finds a character that the library lowers otherwise than Python."""
        return re.compile(f"[{''.join(map(chr, self.apart))}]" if self.apart else "(?!)").search

    @cached_property
    def to_chars(self) -> dict[int, str]:
        return dict(enumerate(byte_chars()))

    @cached_property
    def compatible(self) -> dict[tuple[int, int], bool]:
        return {}

    def keeps_apart(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b as they are when b follows a.

        Undo the merges of both sides from the latest back. At each step the two tokens at the border would have joined if
        they have a merge of their own that comes before the merge just undone on either side.
        """
        if (known := self.compatible.get((a, b))) is not None:
            return known
        if len(self.compatible) > 1 << 20:
            self.compatible.clear()
        x, y, order = a, b, self.order
        till_x = till_y = 1 << 60  # the merge that ends x, and the one that ends y
        while True:
            k = self.pairs.get((x, y))
            if k is not None and k < till_x and k <= till_y:  # of equal merges, the leftmost happens first
                apart = False
                break
            if order[x] == 0 and order[y] == 0:
                apart = True
                break
            if order[x] >= order[y]:
                till_x, x = order[x], self.right[x]
            else:
                till_y, y = order[y], self.left[y]
        self.compatible[a, b] = apart
        return apart

    def encode_word(self, chars: str) -> list[int]:
        """Token ids of one word, given as byte characters and END."""
        n = len(chars)
        best: list = [None] * n
        for end, (i, size) in self.automaton.iter(chars):
            best[end - size + 1] = (i, size)  # ends come in order, so the longest is the last
        out: list[tuple[int, int]] = []
        dead = [False] * (n + 1)
        at, token = 0, best[0]
        while True:
            if token is None:
                dead[at] = True
                if not out:
                    raise ValueError(f"the vocabulary has no tokens for {chars!r}")
                i, size = out.pop()
                at, token = at - size, self.shorter.get(i)
                continue
            i, size = token
            if not dead[at + size] and (not out or self.keeps_apart(out[-1][0], i)):
                out.append(token)
                at += size
                if at == n:
                    return [i for i, _ in out]
                token = best[at]
            else:
                token = self.shorter.get(i)

    def chunk(self, chunk: str, known: Known) -> bytes:
        """Packed token ids of text without white space."""
        out, words = [], known.words
        for w in self.finder(chunk):
            chars = (w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.to_chars)) + END
            got = words.get(chars)
            if got is None:
                got = array("I", self.encode_word(chars)).tobytes()
                if len(chars) <= LONGEST:
                    known.keep(words, chars, got)
            out.append(got)
        return b"".join(out)

    def clean(self, text: str) -> list[str]:
        """What lies between white space, after composing and lower-casing each character."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ").lower()  # no final form: characters are lowered one by one
            if self.lowered(text):
                text = text.translate(self.apart)
        else:
            text = text.lower()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return [x for x in re.split(f"[{WHITE}]+", text) if x]
        return text.split()

    def packed(self, text: str, known: Known) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        out, chunks = [], known.chunks
        for k, part in enumerate(self.splitter.split(text)) if "<|" in text else ((0, text),):
            if not part:
                continue
            if k and part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
                continue
            for chunk in self.clean(part):
                got = chunks.get(chunk)
                if got is None:
                    got = self.chunk(chunk, known)
                    if len(chunk) <= LONGEST:
                        known.keep(chunks, chunk, got)
                out.append(got)
        return b"".join(out)

    @cached_property
    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens' bytes, each followed by a blank, and where each begins."""
        offsets = self.offsets + np.arange(len(self.offsets))
        buffer = b" ".join([self.buffer[a:b] for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)] + [b""])
        return np.frombuffer(buffer, np.uint8), offsets

    def decode(self, packed: bytes) -> bytes:
        """The text of ids, tokens joined by blanks, special ones kept: one gather through the offset table."""
        ids = np.frombuffer(packed, "<u4").astype(np.int64)
        if not len(ids):
            return b""
        buffer, offsets = self.table
        size = offsets[ids + 1] - offsets[ids]
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(offsets[ids] - ends + size, size)
        return buffer[at[:-1]].tobytes()


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """(key, ids, n_tokens, decoded): ids are packed as little-endian unsigned 32-bit integers; ids_array() unpacks them."""
    model = df.sparkSession.sparkContext.broadcast(WordBPE(path))  # as large as the vocabulary file
    kind = df.schema[key].dataType.simpleString()

    def work(keys: pa.Array, texts: pa.Array):
        bpe, known = model.value, _known
        ids = [bpe.packed(t or "", known) for t in texts.to_pylist()]
        columns = [keys, pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
        if decoded:
            columns.append(pa.array([bpe.decode(x).decode() for x in ids], pa.string()))
        yield pa.RecordBatch.from_arrays(columns, names=[key, "ids", "n_tokens", "decoded"][: len(columns)])

    return map_texts(df, key, text, work, f"`{key}` {kind}, ids binary, n_tokens bigint" + ", decoded string" * decoded)


_known = Known()


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) from packed ids; null ids give an empty text."""
    importable(df.sparkSession)
    model = df.sparkSession.sparkContext.broadcast(WordBPE(path))
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.value.decode(x or b"").decode() for x in part.column(1).to_pylist()], pa.string())], names=[key, "decoded"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(run, f"`{key}` {kind}, decoded string")


def ids_array(packed: Column) -> Column:
    """Packed ids as an array of integers, by built-in functions."""
    h = F.hex(packed)
    one = lambda k: F.conv(F.concat(*[F.substring(h, k * 8 + F.lit(p), F.lit(2)) for p in (7, 5, 3, 1)]), 16, 10).cast("int")
    return F.when(F.length(packed) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), (F.length(packed) / 4).cast("int") - 1), one))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text, as digests."""
    out = encode(documents(spark, sf_dir), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE_SQL: dict[str, str] = {}
